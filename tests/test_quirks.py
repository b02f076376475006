"""One toy-frame test per semantic decision."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.functions import expr as X
from reviewlake.functions import text as tx
from reviewlake.operators import catalog as cat
from reviewlake.operators import dashboard as dash
from reviewlake.operators import ingest as ing
from reviewlake.operators import recommend as rec
from reviewlake.operators import sentiment as sm
from reviewlake.operators.review_profile import review_profile
from reviewlake.operators.traits import Trait, trait_counts, trait_pivot
from reviewlake.sources import pages as pg


def offer(**kw):
    base = dict(skuId="1", listPrice="$10.00", targetUrl="/p/x-P1?skuId=1",
                skuImages={"imageUrl": "/i/1.jpg?x=1"}, size="S", name="n", brand="b",
                shortDesc="<b>d</b>", Category1="c1", Category2="c2", Category3="c3",
                lovesCount=1, reviews=1, rating=1.0, date=None, update=None)
    base.update(kw)
    return base


def offers_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.OFFER.fields) for r in rows],
                                 schemas.OFFER)


def test_q1_null_group_key_is_dropped(spark):
    df = offers_df(spark, [offer(), offer(skuId="2", targetUrl="/p/y-P2", size=None)])
    out = cat.build_catalog(df).collect()
    assert [r.prod_id for r in out] == ["P1"]


def test_q2_keep_last_group_in_key_order(spark):
    df = offers_df(spark, [offer(name="a"), offer(skuId="2", name="b", reviews=7)])
    out = cat.build_catalog(df).collect()
    assert len(out) == 1 and out[0].name == "b" and out[0].reviews == 7


def test_q3_q4_nan_and_variant(spark):
    df = offers_df(spark, [offer(rating=float("nan")), offer(skuId="2", rating=2.0)])
    r = cat.catalog_rollup(df).collect()[0]
    assert r.rating == 2.0 and r.variant == 2


def test_q5_q6_sparse_and_null_traits(spark):
    df = spark.createDataFrame([("p1", "x"), ("p1", None), ("p2", None)], "k string, t string")
    wide = trait_counts(df, "k", [Trait("f", "t", ["x", "y"])])
    got = {r.k: (r.f__x, r.f__y) for r in wide.collect()}
    assert got == {"p1": (1, None), "p2": (None, None)}
    piv = trait_pivot(df, "k", "t", ["x", "y"])
    assert piv.columns == ["k", "x", "y"]
    assert {r.k: (r.x, r.y) for r in piv.collect()} == got


def test_q7_q8_column_names_never_collide(spark):
    t1 = Trait("eye", "e", ["Grey", "grey"])
    names = [t1.out_name(v) for v in t1.values]
    assert len({n.lower() for n in names}) == 2
    a, b = Trait("hair_color", "a", ["x"]), Trait("hair_condition", "b", ["x"])
    assert a.out_name("x") != b.out_name("x")
    df = spark.createDataFrame([("p", "Grey", "x", "x")], "k string, e string, a string, b string")
    out = trait_counts(df, "k", [t1, a, b]).collect()[0].asDict()
    assert out[names[0]] == 1 and out[names[1]] is None


def test_q9_regex_id(spark):
    df = spark.createDataFrame([("a?Filter=ProductId%3AP12&x",), ("no id",), (None,)], "u string")
    got = [r.p for r in df.select(X.product_id_from_api_url("u").alias("p")).collect()]
    assert got == ["P12", None, None]


def test_q12_products_without_text_leave_the_inner_profile(spark):
    schema = schemas.REVIEW
    rows = [("c1", "P1", "en_US", True, 5, True, None, "t", "good", False,
             "x?ProductId%3AP1", {"age": "18to24"}),
            ("c2", "P2", "en_CA", False, 1, False, None, "t", None, False,
             "x?ProductId%3AP2", {})]
    rv = spark.createDataFrame(rows, schema)
    pred = rv.where(F.col("ReviewText").isNotNull()).select(
        F.lit("P1").alias("prod_id"), F.lit(1.0).alias("prediction"))
    sent = sm.sentiment_counts(pred, "prod_id")
    inner = review_profile(rv, sent, "inner").collect()
    left = review_profile(rv, sent, "left").collect()
    assert [r.prod_id for r in inner] == ["P1"]
    assert sorted(r.prod_id for r in left) == ["P1", "P2"]
    assert inner[0]["age__18to24"] == 1 and inner[0]["featured__Featured"] == 1


def test_q13_one_class_keeps_both_columns(spark):
    pred = spark.createDataFrame([("p", 1.0), ("p", 1.0)], "ProdID string, prediction double")
    r = sm.sentiment_counts(pred).collect()[0].asDict()
    assert r == {"ProdID": "p", "sentiment__BadSentiment": None, "sentiment__GoodSentiment": 2}


def test_q15_duplicates_no_self_ties_by_id_zero_fill(spark):
    rows = [(1, "c", "red lipstick matte finish"), (2, "c", "red lipstick matte finish"),
            (3, "c", "red lipstick matte finish"), (4, "c", "blue shampoo bottle"),
            (5, "c", "")]
    docs = spark.createDataFrame(rows, "prod_id long, category string, description string")
    out = rec.recommend(docs, k=10, block_size=2).orderBy("prod_id", "rank").collect()
    by = {}
    for r in out:
        by.setdefault(r.prod_id, []).append((r.reco_id, r.sim))
    assert all(p not in [x for x, _ in v] for p, v in by.items())
    assert [x for x, _ in by[1]] == [2, 3, 4, 5]
    assert by[1][0][1] == pytest.approx(1.0) and by[1][2][1] == 0.0
    assert [x for x, _ in by[5]] == [1, 2, 3, 4]


def test_q19_page_tails(spark):
    df = spark.createDataFrame([(0,), (99,), (100,), (250,)], "r long")
    got = [r.o for r in df.select(X.page_offsets("r", 100).alias("o")).collect()]
    assert got == [[], [], [0], [0, 100]]
    tail = [r.o for r in df.select(X.page_offsets("r", 100, True).alias("o")).collect()]
    assert tail == [[], [0], [0], [0, 100, 200]]


def test_q21_one_null_id_kept(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 3, "c")],
                               "CID string, t int, v string")
    out = ing.first_seen(df, "CID", ["t"]).collect()
    assert sorted((r.CID or "", r.v) for r in out) == [("", "a"), ("x", "c")]


def _obs(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    return spark.createDataFrame(
        [(1, t[0], 7, "A", 1.0), (2, t[1], 7, "B", 2.0), (3, t[2], 7, "A", 3.0)],
        "obs_id long, ts timestamp_ntz, sku_id long, price string, attrs double")


def test_q22_price_a_b_a(spark):
    obs = _obs(spark)
    compat = sorted((r.price, r.first_seen.day, r.updated.day)
                    for r in ing.price_history_compat(obs).collect())
    assert compat == [("A", 1, 1), ("A", 2, 3)]
    clean = sorted((r.price, r.first_seen.day, r.last_seen.day, r.n_obs, r.attrs)
                   for r in ing.price_history(obs).collect())
    assert clean == [("A", 1, 3, 2, 3.0), ("B", 2, 2, 1, 2.0)]


def test_q23_missing_category_levels(spark):
    def page(levels):
        cat_tree = None
        for name in reversed(levels):
            cat_tree = {"displayName": name, **({"parentCategory": cat_tree} if cat_tree else {})}
        tree = {"page": {"product": {
            "currentSku": {"skuId": "s1", "listPrice": "$1.00", "targetUrl": "/p/a-P9"},
            "productDetails": {"displayName": "n", "brand": {"displayName": "b"},
                               "lovesCount": 3, "rating": 4.5, "reviews": 10},
            "parentCategory": cat_tree}}}
        return f'<script id="linkStore" type="x">{json.dumps(tree)}</script>'
    # levels listed leaf first: leaf, parent, grandparent
    html = [(page(["leaf"]),), (page(["leaf", "mid"]),), (page(["leaf", "mid", "root"]),)]
    df = spark.createDataFrame(html, "html string")
    out = pg.parse_product_pages(df, seen_at=F.lit(None).cast("timestamp")).collect()
    got = {(r.Category1, r.Category2, r.Category3) for r in out}
    assert got == {(None, None, "leaf"), (None, "mid", "leaf"), ("root", "mid", "leaf")}
    assert out[0].skuId == "s1" and out[0].brand == "b"


def test_q24_half_even(spark):
    df = spark.createDataFrame([("b", "x", 0.1, 1), ("b", "y", 0.15, 1)],
                               "brand string, name string, rating double, loves_count long")
    assert dash.brand_kpi(df).collect()[0].avg_rating == 0.12


def test_q28_money(spark):
    df = spark.createDataFrame([("$12.00",), ("$1,200.00",), (None,)], "p string")
    assert [r.v for r in df.select(X.parse_money("p").alias("v")).collect()] == [12.0, None, None]


def test_q29_q30_unicode_and_contractions(spark):
    df = spark.createDataFrame([("é!a_b",), ("I don't know the café",)], "t string")
    got = [r.c for r in df.select(tx.clean_description("t").alias("c")).collect()]
    assert got == ["éa_b", "dont know café"]


def test_q33_sentiment_tokens_keep_punctuation_and_empties(spark):
    df = spark.createDataFrame([("Good,  bad ",)], "t string")
    assert df.select(tx.sentiment_tokens("t").alias("x")).first().x == ["good,", "", "bad"]


def test_q35_context_key_does_not_override(spark):
    page = {"Results": [{"CID": "c", "ProductId": "P1", "Rating": 5,
                         "ContextDataValuesOrder": ["Rating", "age"],
                         "ContextDataValues": {"Rating": {"Value": "x"},
                                               "age": {"Value": "18to24"}}}]}
    df = spark.createDataFrame([(json.dumps(page), "u")], "body string, url string")
    r = pg.parse_review_pages(df).collect()[0]
    assert r.Rating == 5 and r.attributes == {"Rating": "x", "age": "18to24"}
    empty = spark.createDataFrame([("{}", "u")], "body string, url string")
    assert pg.parse_review_pages(empty).count() == 0


def test_sitemap_and_links(spark):
    xml = "<urlset><url><loc>https://a/x-1</loc></url><url><loc> https://a/y-2 </loc></url></urlset>"
    df = spark.createDataFrame([(xml,)], "xml string")
    assert [r.url for r in pg.sitemap_urls(df).collect()] == ["https://a/x-1", "https://a/y-2"]
    assert [r.url for r in pg.sitemap_urls(df, contains=["y-"]).collect()] == ["https://a/y-2"]
