"""Raw crawl payloads → reviews / offers → profile, catalogue, enrichment."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reviewlake.operators import catalog as cat
from reviewlake.operators import dashboard as dash
from reviewlake.operators import ingest as ing
from reviewlake.operators.review_profile import review_profile
from reviewlake.sources import pages as pg


def review_page(pid, offset, results):
    return (json.dumps({"Results": results}),
            f"https://api.example.com/data/reviews.json?Filter=ProductId%3A{pid}&offset={offset}")


def result(cid, pid, rating, locale="en_US", **ctx):
    order = list(ctx)
    return {"CID": cid, "ProductId": pid, "Rating": rating, "ContentLocale": locale,
            "IsFeatured": False, "IsRecommended": rating >= 4, "IsSyndicated": False,
            "LastModeratedTime": "2024-01-02T03:04:05", "ReviewText": f"text {cid}",
            "ContextDataValuesOrder": order,
            "ContextDataValues": {k: {"Value": v} for k, v in ctx.items()}}


def product_page(pid, brand, name, skus, cats=("Makeup", "Face", "Foundation")):
    tree = {"page": {"product": {
        "regularChildSkus": [{"skuId": s, "listPrice": p, "size": "30 mL",
                              "skuImages": {"imageUrl": f"/img/{s}.jpg?x=1"},
                              "targetUrl": f"/product/{name.lower()}-{pid}?skuId={s}"}
                             for s, p in skus],
        "productDetails": {"displayName": name, "shortDescription": "<b>Nice</b> stuff",
                           "brand": {"displayName": brand}, "lovesCount": 10,
                           "rating": 4.5, "reviews": 250},
        "parentCategory": {"displayName": cats[2], "parentCategory": {
            "displayName": cats[1], "parentCategory": {"displayName": cats[0]}}}}}}
    return f'<html><script id="linkStore" type="text/json">{json.dumps(tree)}</script></html>'


def test_payloads_to_enriched_profile(spark):
    pages = spark.createDataFrame([
        review_page("P1", 0, [result("a", "P1", 5, age="18to24", skinTone="fair"),
                              result("b", "P1", 1, locale="en_CA", age="18to24")]),
        review_page("P1", 100, [result("a", "P1", 5)]),            # same review again
        review_page("P2", 0, [result("c", "P2", 4, skinType="dry")]),
        review_page("P3", 0, []),
    ], "body string, url string")
    reviews = pg.parse_review_pages(pages)
    reviews = ing.first_seen(reviews, "CID", ["Date", "url"])
    prof = {r.prod_id: r for r in review_profile(reviews).collect()}
    assert set(prof) == {"P1", "P2"}
    assert prof["P1"]["age__18to24"] == 2 and prof["P1"]["country__en_CA"] == 1
    assert prof["P1"]["recommended__Recomended"] == 1 and prof["P2"]["skin_type__dry"] == 1

    html = spark.createDataFrame([
        (product_page("P1", "Acme", "Glow", [("s1", "$20.00"), ("s2", "$25.00")]),),
        (product_page("P2", "Acme", "Matte", [("s3", "$1,200.00")]),),
    ], "html string")
    offers = pg.parse_product_pages(html).withColumn("date", F.col("update"))
    catalog = cat.build_catalog(offers)
    got = {r.prod_id: r for r in catalog.collect()}
    assert got["P1"].price == 25.0 and got["P1"].category1 == "Makeup"
    assert got["P1"].short_desc == ",Nice, stuff" and got["P1"].sku_image.endswith(".jpg")
    assert got["P2"].price is None                       # "$1,200.00" does not parse
    assert cat.price_rejects(offers).count() == 1

    enriched = dash.enrich(review_profile(reviews), catalog)
    assert sorted(r.prod_id for r in enriched.collect()) == ["P1", "P2"]
    kpi = dash.brand_kpi(catalog).first()
    assert kpi.n_items == 2 and kpi.avg_rating == 4.5


def test_frontier_from_offers_and_stored_pages(spark):
    offers = spark.createDataFrame(
        [("/product/x-P1?skuId=1", 250), ("/product/x-P1?skuId=2", 99),
         ("/product/y-P2?skuId=3", 100)], "targetUrl string, reviews long")
    stored = spark.createDataFrame(
        [("https://api.example.com/data/reviews.json?Filter=ProductId%3AP1&offset=0",)],
        "url string")
    plan = ing.page_plan(offers, page_size=100)
    todo = sorted((r.prod_id, r.offset) for r in
                  ing.frontier(plan, ing.fetched_pages(stored)).collect())
    assert todo == [("P1", 100), ("P2", 0)]


def test_recommendations_with_string_ids(spark):
    from reviewlake.operators import recommend as rec
    docs = spark.createDataFrame(
        [("P1", "Lipstick", "matte red lipstick long lasting"),
         ("P2", "Lipstick", "glossy red lipstick"),
         ("P3", "Lipstick", "nude shade balm"),
         ("P9", "Serum", "vitamin c serum")],
        "prod_id string, category string, description string")
    out = {(r.prod_id, r.rank): (r.reco_id, r.sim) for r in rec.recommend(docs).collect()}
    assert out[("P1", 1)][0] == "P2" and out[("P1", 2)] == ("P3", 0.0)
    assert ("P9", 1) not in out        # alone in its category


def test_hash_split_on_string_ids(spark):
    from reviewlake.operators import sentiment as sm
    df = spark.createDataFrame([(f"c{i}", i % 2) for i in range(200)], "CID string, label int")
    a, b = sm.split(df, "CID", by_hash=True)
    assert a.count() + b.count() == 200 and 100 < a.count() < 200
    a2, _ = sm.split(df.repartition(7), "CID", by_hash=True)
    assert sorted(r.CID for r in a.collect()) == sorted(r.CID for r in a2.collect())
