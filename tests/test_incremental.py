"""Stored tables and later batches: merges, streams over several triggers, replays."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.operators import ingest as ing
from reviewlake.streaming import jobs

DAY = dt.datetime(2024, 1, 1)
OBS = "obs_id long, ts timestamp, sku_id long, price string, attrs double"


def obs(i, day, sku, price):
    return (i, DAY + dt.timedelta(days=day), sku, price, float(i))


def landed(spark, tmp_path, batches, schema=OBS):
    """One file per batch, in order; a stream that takes one file per trigger."""
    folder = str(tmp_path / f"in-{uuid.uuid4().hex}")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)     # the source orders files by their time
    return jobs.read_landed(spark, folder, "*.parquet", spark.read.parquet(folder).schema, 1)


def run(q):
    q.awaitTermination()
    assert q.exception() is None


BATCHES = [
    [obs(1, 1, 1, "a"), obs(2, 1, 2, "a"), obs(3, 1, 1, "a")],
    [obs(4, 10, 1, "a"), obs(5, 10, 3, "a")],       # known again ten days later
    [obs(6, 2, 4, "a"), obs(7, 3, 2, "b")],         # late, never stored
]


def test_first_seen_stream_over_batches_with_a_late_row(spark, tmp_path):
    stream = landed(spark, tmp_path, BATCHES)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(jobs.insert_first_seen(stream, out, check, "sku_id", ["ts", "obs_id"]))
    got = {r.sku_id: r.obs_id for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 2: 2, 3: 5, 4: 6}
    assert {r.batch_id for r in spark.read.parquet(out).collect()} == {0, 1, 2}


def test_a_replayed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    import pathlib
    stream = landed(spark, tmp_path, BATCHES)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(jobs.insert_first_seen(stream, out, check, "sku_id", ["ts", "obs_id"]))
    before = sorted(spark.read.parquet(out).collect())
    # A crash after the write and before the commit: the last commit is missing.
    for name in ("2", ".2.crc"):
        (pathlib.Path(check) / "commits" / name).unlink(missing_ok=True)
    run(jobs.insert_first_seen(stream, out, check, "sku_id", ["ts", "obs_id"]))
    assert sorted(spark.read.parquet(out).collect()) == before


def test_insert_unseen_keeps_one_null_id(spark):
    schema = "cid string, n int"
    stored = spark.createDataFrame([("a", 1), (None, 2)], schema)
    batch = spark.createDataFrame([("a", 3), (None, 4), ("b", 6), ("b", 5)], schema)
    assert [(r.cid, r.n) for r in ing.insert_unseen(stored, batch, "cid", ["n"]).collect()] == [("b", 5)]
    one = ing.insert_unseen(stored.where("n = 1"), batch, "cid", ["n"]).collect()
    assert sorted(r.n for r in one) == [4, 5]


def test_merge_equals_one_shot_in_three_batches(spark):
    rows = [obs(i, i % 17, i % 5, "abc"[i * i % 3]) for i in range(200)]
    rows.sort(key=lambda r: (r[1], r[0]))
    frame = lambda part: spark.createDataFrame(part, OBS)
    history = ing.price_history(frame(rows[:70]))
    for a, b in ((70, 140), (140, 200)):
        history = ing.merge_price_history(history, frame(rows[a:b]))
    assert sorted(history.collect()) == sorted(ing.price_history(frame(rows)).collect())


def records(df):
    return sorted((r.sku_id, r.price, r.first_seen, r.updated, r.attrs) for r in df.collect())


def by_rule(rows):
    """The store's rule, with the whole list of records."""
    stored = {}
    for i, ts, sku, price, attrs in sorted(rows, key=lambda r: (r[1], r[0])):
        own = stored.setdefault(sku, [])
        if any(x[0] == price for x in own):
            last = max(range(len(own)), key=lambda k: (own[k][2], k))
            own[last] = (price, own[last][1], ts, attrs)
        else:
            own.append((price, ts, ts, attrs))
    return sorted((s, *x) for s, own in stored.items() for x in own)


ABA = [obs(i, i, i % 2, p) for i, p in enumerate("ababcabcadbacdeabcbaddeabc")]


def test_compat_fold_follows_the_rule_and_keeps_types(spark):
    df = spark.createDataFrame(ABA, OBS)
    got = ing.price_history_compat(df)
    assert records(got) == by_rule(ABA)
    types = dict(got.dtypes)
    assert types["first_seen"] == types["updated"] == "timestamp"
    deep = df.withColumn("price", F.lit(1.5).cast("decimal(9,2)")).withColumn(
        "attrs", F.struct("attrs", F.array("obs_id").alias("x")))
    out = ing.price_history_compat(deep)
    assert dict(out.dtypes)["price"] == "decimal(9,2)" and out.count() == 2
    assert ing.price_history_compat(df.limit(0)).isEmpty()


def test_compat_fold_time_grows_with_the_rows(spark):
    def seconds(n):
        fold, t = ing.SkuFold(), time.perf_counter()
        for i in range(n):
            fold.add("ab"[i % 2], i, ())
        return time.perf_counter() - t
    seconds(1000)
    assert seconds(80_000) < 12 * max(seconds(20_000), 1e-3)
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("obs_id"), F.timestamp_seconds("id").alias("ts"),
                               F.lit(1).cast("long").alias("sku_id"),
                               F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("price"),
                               F.col("id").cast("double").alias("attrs"))
    rows = [(r.obs_id, r.ts, r.sku_id, r.price, r.attrs) for r in df.collect()]
    fold, want = ing.SkuFold(), []
    for r in rows:
        final = fold.add(r[3], r[1], (r[4],))
        want += [(1, *final)] if final else []
    assert records(ing.price_history_compat(df)) == sorted([*want, (1, *fold.current)])


def test_compat_stream_over_batches_emits_changed_records(spark, tmp_path):
    stream = landed(spark, tmp_path, [ABA[:9], ABA[9:18], ABA[18:]])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(jobs.write_change_log(jobs.price_history_compat_stream(stream), out, check, rocksdb=True))
    log = spark.read.parquet(out)
    assert log.select("batch_id").distinct().count() == 3
    assert records(jobs.latest_from_change_log(spark, out, ["sku_id", "rec"])) == by_rule(ABA)
    per_batch = {(r.batch_id, r.sku_id): r.n for r in
                 log.groupBy("batch_id", "sku_id").agg(F.count("*").alias("n")).collect()}
    total = log.groupBy("sku_id").agg(F.max("rec").alias("last")).collect()
    assert all(per_batch[2, r.sku_id] <= r.last + 1 for r in total)


def test_compat_stream_takes_null_prices(spark, tmp_path):
    rows = [obs(i, i, i % 2, p) for i, p in enumerate(["a", None, "b", None, None, "a", "b", "c", "a", None, None, "c"])]
    stream = landed(spark, tmp_path, [rows[:5], rows[5:8], rows[8:]])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(jobs.write_change_log(jobs.price_history_compat_stream(stream), out, check, rocksdb=True))
    got = jobs.latest_from_change_log(spark, out, ["sku_id", "rec"])
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(((r.sku_id, r.price, r.first_seen, r.updated, r.attrs) for r in got.collect()), key=key) \
        == sorted(by_rule_with_nulls(rows), key=key)


def by_rule_with_nulls(rows):
    named = [(*r[:3], r[3] or "null", r[4]) for r in rows]
    return [(s, None if p == "null" else p, *x) for s, p, *x in by_rule(named)]


def test_compat_stream_writes_only_the_entries_that_a_trigger_changes(spark, tmp_path):
    n, triggers = 20_000, 10
    folder = str(tmp_path / "in")
    frame = spark.range(n).select(F.col("id").alias("obs_id"), F.timestamp_seconds("id").alias("ts"),
                                  F.lit(1).cast("long").alias("sku_id"), F.col("id").cast("string").alias("price"),
                                  F.lit(0.5).alias("attrs"))
    for k in range(triggers):
        frame.where(F.floor(F.col("obs_id") * triggers / n) == k).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = jobs.read_landed(spark, folder, "*.parquet", frame.schema, 1)
    q = jobs.write_change_log(jobs.price_history_compat_stream(stream), str(tmp_path / "out"),
                              str(tmp_path / "check"), rocksdb=True)
    run(q)
    written = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows]
    assert len(written) == triggers and max(written) <= n / triggers + 5
    log = spark.read.parquet(str(tmp_path / "out"))
    # A record leaves when the next one comes: its own trigger's records, and the one before.
    assert log.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= n / triggers + 1
    assert jobs.latest_from_change_log(spark, str(tmp_path / "out"), ["sku_id", "rec"]).count() == n


def test_checkpoint_folder_rule(spark):
    from reviewlake.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (conf or spark.sparkContext.getCheckpointDir()
                      or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work")


def test_flat_reviews_become_the_attribute_map(spark, tmp_path):
    from reviewlake import schemas
    from reviewlake.sources.tables import read_reviews
    flat = spark.createDataFrame([("c1", 5, "18to24", None), ("c2", 1, None, None)],
                                 "CID string, Rating int, age string, eyeColor string")
    flat.write.parquet(str(tmp_path / "flat"))
    got = {r.CID: r.attributes for r in read_reviews(spark, str(tmp_path / "flat")).collect()}
    assert got == {"c1": {"age": "18to24"}, "c2": {}}
    nested = spark.createDataFrame([("c3", {"age": "over54"})], "CID string, attributes map<string,string>")
    nested.write.parquet(str(tmp_path / "nested"))
    back = read_reviews(spark, str(tmp_path / "nested"))
    assert back.columns == [f.name for f in schemas.REVIEW.fields]
    assert back.first().attributes == {"age": "over54"}


def test_unicode_white_space_separates_words(spark):
    import re

    from reviewlake.functions import text as tx
    texts = ["red lipstick　matte", "a b\u0085c\x1cd", "don't  stop now!", " \t", "", "é!a_b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in df.orderBy("i").select(tx.clean_tokens("t", None).alias("c")).collect()]
    want = [[w for w in re.split(r"\s+", re.sub(r"[^\w\s]", "", t.lower())) if w] for t in texts]
    assert got == want
    from pyspark.ml.feature import Tokenizer
    ml = Tokenizer(inputCol="t", outputCol="w").transform(df).orderBy("i").collect()
    own = df.orderBy("i").select(tx.sentiment_tokens("t").alias("w")).collect()
    assert [r.w for r in own] == [r.w for r in ml]


def test_bad_payloads_do_not_stop_a_crawl(spark):
    from reviewlake.sources import pages as pg
    body = ('{"Results":[{"CID":"1","LastModeratedTime":"no date","ContextDataValuesOrder":["age","age",null,"x"],'
            '"ContextDataValues":{"age":{"Value":"18to24"}}}]}')
    df = spark.createDataFrame([("u", body), ("v", "{"), ("w", None)], "url string, body string")
    got = pg.parse_review_pages(df).collect()
    assert [(r.CID, r.Date, r.attributes) for r in got] == [("1", None, {"age": "18to24", "x": None})]
    pages = spark.createDataFrame([("<html></html>",), ('<script id="linkStore">{"page":{"product":{}}}</script>',)],
                                  "html string")
    offers = pg.parse_product_pages(pages)
    assert offers.isEmpty() and {"date", "update"} <= set(offers.columns)


def test_pickers_are_sorted_and_rank_matches(spark):
    from reviewlake.operators import dashboard as dash
    cat = spark.createDataFrame([("b", "z"), ("a", "y"), ("b", "c"), ("a", None), (None, "q")],
                                T.StructType([T.StructField("brand", T.StringType()),
                                              T.StructField("name", T.StringType())]))
    assert [r.brand for r in dash.brand_list(cat).collect()] == ["a", "b"]
    assert [(r.brand, r.name) for r in dash.brand_products(cat.where("brand is not null")).collect()] == [
        ("a", "y"), ("b", "c"), ("b", "z")]
    rv = spark.createDataFrame([("p", "en_CA")] * 2 + [("p", "en_US")] * 3 + [("p", "xx")],
                               "prod_id string, loc string")
    got = dash.country_counts(rv, "prod_id", "loc", {"en_CA": "Canada", "en_US": "USA"}).orderBy("rank").collect()
    assert [(r.country, r.n, r.rank) for r in got] == [("USA", 3, 1), ("Canada", 2, 2), ("xx", 1, 3)]


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    from reviewlake.streaming import stores
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = spark.range(0, 60000, 1, 8).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    path = str(tmp_path / "t")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500000")
        stores.merge_partitions(rows, 0, path, "k", lambda stored, new: new, parts=1)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "t" / "_part=0").glob("*.parquet"))) > 1
    assert stores.read_merged(spark, path).exceptAll(rows).isEmpty() and stores.read_merged(spark, path).count() == 60000
