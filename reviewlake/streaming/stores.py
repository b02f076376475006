"""Stored tables that a batch or a trigger merges into, touching only what it concerns.

* ``merge_partitions`` — a table partitioned by a hash of its key. A batch is merged
  into the partitions of its own keys, which are written anew by dynamic partition
  overwrite; the other partitions' files stay as they are. Every row carries the last
  batch applied to its partition, so a batch that is run again after a crash finds
  its partitions done, or does those that are left.
* ``SeenIds`` — the ids ever stored, in a table bucketed by id. A batch is dealt by the
  same buckets and joins them in place: the stored ids are never shuffled. A batch of
  no more ids than there are buckets reads the buckets of its own ids only.

What reaches the driver is numbers of partitions or ids of one batch, at most as
many as there are partitions or buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.ingest import first_seen

PARTS = 64
BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# -- partitioned by a hash of the key ------------------------------------------

def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def read_merged(spark: SparkSession, path: str, parts: Sequence[int] | None = None) -> DataFrame:
    """The stored rows, of some partitions if asked for, without the technical columns."""
    rows = spark.read.parquet(path)
    if parts is not None:
        rows = rows.where(F.col("_part").isin(list(parts)))
    return rows.drop("_part", "_applied")


def open_parts(batch: DataFrame, batch_id: int, path: str, key: str, parts: int) -> list[int]:
    """Partitions of the batch's keys in the table at ``path`` to which the batch is not applied yet."""
    spark = batch.sparkSession
    touched = {r[0] for r in batch.select(part_of(key, parts)).distinct().collect()}
    if touched and exists(spark, path):
        done = (spark.read.parquet(path).where(F.col("_part").isin(list(touched))).groupBy("_part")
                .agg(F.max("_applied").alias("a")).where(F.col("a") >= batch_id))
        touched -= {r["_part"] for r in done.collect()}
    return sorted(touched)


def overwrite_parts(rows: DataFrame, batch_id: int, path: str, key: str, parts: int) -> None:
    """Write the rows' partitions anew; the files of the others stay. A task writes the rows of a
    partition, or some of them if they are many (AQE's advisory partition size)."""
    (rows.withColumns({"_part": part_of(key, parts), "_applied": F.lit(batch_id).cast("long")})
     .hint("rebalance", F.col("_part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_part").parquet(path))


def merge_partitions(batch: DataFrame, batch_id: int, path: str, key: str,
                     merge: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Merge ``batch`` into the table at ``path``; the partitions that were written.

    ``merge(stored, rows)`` gives what the touched partitions shall hold, from what they
    hold (None if the table is not there yet) and the batch's rows for them.
    ``batch_id`` must rise from batch to batch.
    """
    spark = batch.sparkSession
    touched = open_parts(batch, batch_id, path, key, parts)
    if touched:
        stored = read_merged(spark, path, touched) if exists(spark, path) else None
        overwrite_parts(merge(stored, batch.where(part_of(key, parts).isin(touched))), batch_id, path, key, parts)
    return touched


def derive_partitions(batch: DataFrame, batch_id: int, source: str, path: str, key: str,
                      derive: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Derive the partitions of the batch's keys in the table at ``path`` anew from the same
    partitions of the table at ``source``, which the batch was merged into before."""
    touched = open_parts(batch, batch_id, path, key, parts)
    if touched:
        overwrite_parts(derive(read_merged(batch.sparkSession, source, touched)), batch_id, path, key, parts)
    return touched


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str,
                 merge: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = PARTS):
    """Merge every micro-batch into the table at ``path`` (start the query)."""
    return (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, n: merge_partitions(batch, n, path, key, merge, parts) and None)
            .trigger(availableNow=True).start())


# -- bucketed by the key -------------------------------------------------------

def seen_key(key: str) -> Column:
    """The id as text that is never null: a null id meets a stored null id."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


class SeenIds:
    """The ids stored so far, as a bucketed table at ``path``; ``rows_path`` takes the rows."""

    def __init__(self, spark: SparkSession, path: str, rows_path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.rows_path, self.buckets = spark, rows_path, buckets
        self.table = f"seen_{hashlib.md5(path.encode()).hexdigest()}"
        # The files tell their buckets by name, so another session finds them by the path.
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (seen_key STRING, batch_id BIGINT) USING parquet "
                  f"CLUSTERED BY (seen_key) INTO {buckets} BUCKETS LOCATION '{path}'")

    def unseen(self, batch: DataFrame, batch_id: int, key: str, order: Sequence[str]) -> DataFrame:
        """The first row per id of ``batch``, by ``order``, of ids that no earlier batch stored."""
        first = first_seen(batch, key, order).withColumn("seen_key", seen_key(key))
        stored = self.spark.table(self.table).where(F.col("batch_id") < batch_id)
        some = first.select("seen_key").limit(self.buckets + 1).collect()
        if len(some) <= self.buckets:
            stored = stored.where(F.col("seen_key").isin([r.seen_key for r in some]))
        return (first.repartition(self.buckets, "seen_key")
                .join(stored.select("seen_key").hint("merge"), "seen_key", "left_anti").drop("seen_key"))

    def insert(self, batch: DataFrame, batch_id: int, key: str, order: Sequence[str]) -> None:
        """Store the unseen rows, then their ids. A batch run again writes the same rows once
        more in place, and ids that are there twice change nothing."""
        folder = f"{self.rows_path}/batch_id={batch_id}"
        self.unseen(batch, batch_id, key, order).write.mode("overwrite").parquet(folder)
        ids = self.spark.read.schema(batch.schema).parquet(folder).select(
            seen_key(key).alias("seen_key"), F.lit(batch_id).cast("long").alias("batch_id"))
        (ids.repartition(self.buckets, "seen_key").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "seen_key").saveAsTable(self.table))

    def rows(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.rows_path).drop("batch_id")
