"""Queries: the streaming jobs, run over the landed events file (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import ingest as ing
from reviewlake.plans import standins
from reviewlake.plans.ingest import COMPAT_SQL, INGEST_DEDUPE_SQL, PRICE_HISTORY_SQL
from reviewlake.plans.registry import query
from reviewlake.sources.tables import read_table
from reviewlake.streaming import jobs, stores


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Streaming price observations read from the landed ``events`` file."""
    schema = read_table(spark, d, "events").schema
    ev = jobs.read_landed(spark, d, "events.parquet", schema)
    return ev.select(F.col("event_id").alias("obs_id"), "ts", F.col("user_id").alias("sku_id"),
                     F.col("event_type").alias("price"), F.col("value").alias("attrs"))


@query("ingest_dedupe_stream", INGEST_DEDUPE_SQL)
def ingest_dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """Reviews inserted by the streaming first-seen rule, whole rows."""
    obs = _observations(spark, d)
    rows = obs.select(F.concat_ws(":", F.col("sku_id").cast("string"), "price")
                      .alias("review_id"), "obs_id", "ts", "sku_id", "price", "attrs")
    return jobs.run_to_table(spark, rows, "ingest_dedupe", keys=["review_id"],
                             first_by=["ts", "obs_id"])


@query("price_history_stream", """
SELECT user_id AS sku_id, event_type AS price, min(ts) AS first_seen, max(ts) AS last_seen,
       count(*) AS n_obs, max({'t': ts, 'b': event_id, 'a': value}).a AS attrs
FROM events GROUP BY ALL
""")
def price_history_stream(spark: SparkSession, d: str) -> DataFrame:
    """Clean price history maintained by a stateful streaming aggregate."""
    upd = jobs.price_history_updates(_observations(spark, d))
    return jobs.run_to_table(spark, upd, "price_history", mode="update",
                             keys=["sku_id", "price"])


@query("price_history_compat_stream", COMPAT_SQL)
def price_history_compat_stream(spark: SparkSession, d: str) -> DataFrame:
    """Exact store-upsert fold kept as per-SKU streaming state."""
    recs = jobs.price_history_compat_stream(_observations(spark, d))
    return jobs.run_to_table(spark, recs, "price_history_compat", mode="update",
                             keys=["sku_id", "rec"], rocksdb=True).drop("rec")


UPSERT_TRIGGERS = 10


@query("price_history_upsert", PRICE_HISTORY_SQL)
def price_history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Ten files of observations, one per trigger, merged into the touched partitions of the
    stored history."""
    out, checkpoint = jobs.scratch_paths(spark, "price_history_upsert")
    landed = f"{out}/landed"
    obs = standins.price_observations(spark, d).drop("props")
    obs.repartitionByRange(UPSERT_TRIGGERS, "ts").write.parquet(landed)
    stream = jobs.read_landed(spark, landed, "*.parquet", obs.schema, files_per_trigger=1)
    q = stores.merge_stream(stream, f"{out}/history", checkpoint, "sku_id", ing.merge_price_history, parts=8)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stores.read_merged(spark, f"{out}/history")
