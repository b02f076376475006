"""Stored tables: partition merges, bucketed ids, replays, what a batch reads and writes."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from reviewlake import build
from reviewlake.operators import ingest as ing
from reviewlake.operators.traits import Trait, trait_counts
from reviewlake.streaming import stores

DAY = dt.datetime(2024, 1, 1)
OBS = "obs_id long, ts timestamp, sku_id long, price string, attrs double"


def obs(spark, rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=i), sku, price, float(i)) for i, sku, price in rows], OBS)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_touches_the_partitions_of_its_keys_and_a_replay_none(spark, tmp_path):
    path = str(tmp_path / "history")
    first = obs(spark, [(i, i % 40, "ab"[i % 2]) for i in range(200)])
    second = obs(spark, [(500, 3, "a"), (501, 3, "c"), (502, 77, "a")])
    merge = lambda rows, n: stores.merge_partitions(rows, n, path, "sku_id", ing.merge_price_history, 16)
    assert merge(first, 0) == sorted({r[0] for r in first.select(stores.part_of("sku_id", 16)).collect()})
    before = files(path)
    touched = merge(second, 1)
    after = files(path)
    assert touched == sorted({r[0] for r in second.select(stores.part_of("sku_id", 16)).collect()})
    changed = {f for f in before if after.get(f) != before[f]} | (after.keys() - before.keys())
    assert changed and all(any(f"_part={p}/" in f for p in touched) for f in changed)
    rows = sorted(stores.read_merged(spark, path).collect())
    assert rows == sorted(ing.price_history(first.union(second)).collect())
    # Replays: of the last batch, of an earlier one, and of one that a crash left half done.
    assert merge(second, 1) == [] and merge(first, 0) == []
    assert files(path) == after
    assert sorted(stores.read_merged(spark, path).collect()) == rows
    half = obs(spark, [(600, 3, "a"), (601, 5, "a")])
    one = half.where("sku_id = 3")
    merge(one, 2)
    merge(half, 2)
    got = {(r.sku_id, r.price): r.n_obs for r in stores.read_merged(spark, path).collect()}
    want = {(r.sku_id, r.price): r.n_obs
            for r in ing.price_history(first.union(second).union(half)).collect()}
    assert got == want


def test_stored_rows_of_other_partitions_are_not_read(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = obs(spark, [(i, i % 40, "a") for i in range(80)])
    stores.merge_partitions(rows, 0, path, "sku_id", ing.merge_price_history, 16)
    p = plan(stores.read_merged(spark, path, [3, 5]))
    assert "PartitionFilters: [" in p and "_part" in p[p.index("PartitionFilters"):p.index("PushedFilters")]


def test_seen_ids_join_in_their_buckets(spark, tmp_path):
    schema = "cid string, n int"
    rows = [(f"k{i % 300}" if i % 50 else None, i) for i in range(400)]
    frame = spark.createDataFrame(rows, schema)
    seen = stores.SeenIds(spark, str(tmp_path / "ids"), str(tmp_path / "rows"), buckets=8)
    batches = [frame.where("n < 150"), frame.where("n between 150 and 310"), frame.where("n > 310")]
    for k, b in enumerate(batches):
        seen.insert(b, k, "cid", ["n"])
    want = sorted((r.cid or "", r.n) for r in ing.first_seen(frame, "cid", ["n"]).collect())
    assert sorted((r.cid or "", r.n) for r in seen.rows(frame.schema).collect()) == want
    # Run again after a crash: the same rows in place.
    seen.insert(batches[1], 1, "cid", ["n"])
    assert sorted((r.cid or "", r.n) for r in seen.rows(frame.schema).collect()) == want
    # A new session finds the buckets by the path.
    spark.sql(f"DROP TABLE {seen.table}")
    seen = stores.SeenIds(spark, str(tmp_path / "ids"), str(tmp_path / "rows"), buckets=8)
    large = seen.unseen(frame, 9, "cid", ["n"])
    assert large.isEmpty()
    p = plan(large)
    stored = p[p.rindex("Sort ["):]
    assert "Bucketed: true" in stored and "Exchange" not in stored and "Broadcast" not in p
    few = plan(seen.unseen(spark.createDataFrame([("k1", 0), ("new", 1)], schema), 9, "cid", ["n"]))
    assert "out of 8" in few and "SelectedBucketsCount: 8 out of 8" not in few


def test_profile_updates_equal_the_one_shot(spark, tmp_path):
    traits = [Trait("flag", "t", ["a", "b"]), Trait("odd", "o", [True, False])]
    df = spark.range(900).select((F.col("id") % 37).cast("string").alias("p"), "id",
                                 F.when(F.col("id") % 5 > 0, F.element_at(F.array(F.lit("a"), F.lit("b")),
                                        (F.col("id") % 2 + 1).cast("int"))).alias("t"),
                                 (F.col("id") % 2 == 1).alias("o"))
    out = str(tmp_path)
    for k in range(3):
        build.update_profile(df.where(F.floor(F.col("id") / 300) == k), k, out, "p", traits, parts=4)
    build.update_profile(df.where("id >= 600"), 2, out, "p", traits, parts=4)
    assert sorted(stores.read_merged(spark, f"{out}/profile").collect()) == sorted(
        trait_counts(df, "p", traits).collect())


def test_ranges_expand_to_the_frontier(spark):
    from reviewlake.plans import QUERIES
    from reviewlake.plans.ingest import PAGE
    d = "/root/testdata/sf0.001"
    pages = ing.expand_ranges(QUERIES["frontier_ranges"](spark, d), PAGE)
    want = QUERIES["frontier"](spark, d)
    assert sorted(pages.collect()) == sorted(want.select(pages.columns).collect())
    offers = spark.createDataFrame([("/x-P1?a", 250), ("/x-P1?a", 90), ("/x-P2", 99), ("/x-P3", 300), (None, 200)],
                                   "targetUrl string, reviews int")
    fetched = spark.createDataFrame([("P1", 0), ("P3", 100), ("P3", 150), ("P3", 900), ("P9", 0), (None, None)],
                                    "prod_id string, offset int")
    for tail, want in ((False, [(None, 0, 100, 2), ("P1", 100, 100, 1), ("P3", 0, 0, 1), ("P3", 200, 200, 1)]),
                       (True, [(None, 0, 100, 2), ("P1", 100, 200, 2), ("P2", 0, 0, 1), ("P3", 0, 0, 1), ("P3", 200, 200, 1)])):
        got = ing.frontier_ranges(offers, fetched, include_tail=tail)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=lambda r: (r[0] or "", r[1])) == want
        plan_ = ing.page_plan(offers, include_tail=tail)
        assert sorted(map(str, ing.expand_ranges(got).select("prod_id", "offset", "priority").collect())) == sorted(
            map(str, ing.frontier(plan_, fetched).select("prod_id", "offset", "priority").collect()))


def test_open_attributes(spark):
    from reviewlake.sources import pages as pg
    rows = [(1, '{"a": 1, "b": "x y", "c.d": null, "e": {"f": [1, 2]}}'), (2, '[1, 2]'), (3, "no json"), (4, None),
            (5, '{}'), (6, '{"a": 1.5, "g": true}'), (7, '"text"')]
    df = spark.createDataFrame(rows, "key_of long, props string")
    got = {(r.key_of, r.key): r.value for r in pg.open_attributes(df, "props").collect()}
    assert got == {(1, "a"): "1", (1, "b"): "x y", (1, "c.d"): None, (1, "e"): '{"f":[1,2]}',
                   (6, "a"): "1.5", (6, "g"): "true"}
