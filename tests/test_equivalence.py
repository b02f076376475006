"""Equivalent forms give equal tables."""

from __future__ import annotations

from reviewlake.plans import QUERIES

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_single_pass_profile_equals_join_chain(spark):
    assert rows(QUERIES["profile"](spark, D)) == rows(QUERIES["profile_join_chain"](spark, D))


def test_stream_equals_batch(spark):
    a = QUERIES["price_history_stream"](spark, D)
    b = QUERIES["price_history"](spark, D)
    assert rows(a) == rows(b.select(a.columns))
    s = QUERIES["ingest_dedupe_stream"](spark, D)
    t = QUERIES["ingest_dedupe"](spark, D)
    assert rows(s) == rows(t.select(s.columns))


def test_compat_stream_equals_compat_batch(spark):
    s = QUERIES["price_history_compat_stream"](spark, D).drop("rec")
    b = QUERIES["price_history_compat"](spark, D)
    assert rows(s) == rows(b.select(s.columns))


def test_wide_recommendations_are_a_pivot_of_long(spark):
    wide = {r.prod_id: r for r in QUERIES["reco_wide"](spark, D).collect()}
    for r in QUERIES["recommend_top10"](spark, D).collect():
        assert wide[r.prod_id][f"reco{r.rank - 1}"] == r.reco_id


def test_recommendation_properties(spark):
    out = QUERIES["recommend_top10"](spark, D).collect()
    by = {}
    for r in out:
        assert r.prod_id != r.reco_id and 0.0 <= r.sim <= 1.0 + 1e-9
        by.setdefault(r.prod_id, []).append(r)
    for recs in by.values():
        recs.sort(key=lambda r: r.rank)
        assert [r.rank for r in recs] == list(range(1, len(recs) + 1))
        assert all(a.sim >= b.sim for a, b in zip(recs, recs[1:]))


def test_catalog_unique_and_counts_bounded(spark):
    cat = QUERIES["catalog_dedupe"](spark, D)
    assert cat.count() == cat.select("prod_id").distinct().count()
    prof = QUERIES["profile"](spark, D)
    from pyspark.sql import functions as F
    rv = QUERIES["load_reviews"](spark, D).groupBy(F.col("ProdID").alias("prod_id")).count()
    fam = [c for c in prof.columns if c.startswith("flag__")]
    j = prof.join(rv, "prod_id").select(
        sum(F.coalesce(F.col(c), F.lit(0)) for c in fam).alias("s"), "count")
    assert all(r.s <= r["count"] for r in j.collect())


def test_catalog_maxima_equal_the_rollups_and_move_rows_once(spark):
    import random
    from datetime import datetime

    from reviewlake import schemas
    from reviewlake.operators import catalog as cat
    r = random.Random(5)

    def offer():
        name = r.choice(["a", "b", None])
        return ("s", r.choice(["$1.00", "$2,000.00", "$3.50", None]),
                r.choice(["/p/x-P1?k=1", "/p/x-P1", "/p/y-P2?k=2", "/p/z-P3", None]),
                (r.choice(["/i.jpg?1", "/i.jpg?2", "/j.jpg", None]),) if r.random() < 0.95 else None,
                r.choice(["1", "2"]), name, r.choice(["B", "C"]), r.choice(["<p>x</p>", "<b>y</b>"]), "c", "d", "e",
                r.choice([None, 1, 7]), r.choice([None, 2, 9]), r.choice([None, float("nan"), 0.5, 3.0]),
                datetime(2020, 1, 1), datetime(2020, 1, 1))
    rows = [offer() for _ in range(400)]
    names = ["skuId", "listPrice", "targetUrl", "skuImages", "size", "name", "brand", "shortDesc", "Category1",
             "Category2", "Category3", "lovesCount", "reviews", "rating", "date", "update"]
    types = [next(f for f in schemas.OFFER.fields if f.name == n) for n in names]
    offers = spark.createDataFrame(rows, type(schemas.OFFER)(types)).repartition(6)
    whole = cat.build_catalog(offers).collect()
    assert len(whole) == 3
    for metrics in ([], ["price"], ["reviews", "loves_count"], ["rating", "price", "reviews"]):
        got = cat.catalog_maxima(offers, metrics)
        keep = [k for k in cat.GROUP_KEYS] + metrics
        assert got.columns == keep
        assert sorted(map(str, got.collect())) == sorted(str(w.__class__(**{k: w[k] for k in keep})) for w in whole)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    from reviewlake.plans.registry import QUERIES
    plan = QUERIES["brand_scatter_corr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2       # products, then brands: no rollup on nine keys
