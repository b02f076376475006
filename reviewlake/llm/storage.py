"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Buckets that Spark allows a table to have at most (``spark.sql.sources.bucketing.maxBuckets``).
#: Beyond it a bucket holds several keys or blocks, one after the other.
MAX_BUCKETS = 100_000
#: A table whose size is known beforehand has files of about so many bytes.
FILE_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse (in tests
    the session's checkpoint folder)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return folder.rstrip("/")


def written(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs the tasks that
    read it, not the steps before it. ``most``: how many bytes it has at most, where that is
    known; a small table is then not a file per shuffle partition (on a local disk Hadoop
    starts some six processes per file), but one per core, or one per ``FILE_BYTES``.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most // FILE_BYTES)))
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of the same columns, one per round, in one folder of the shared folder: all of
    them are one scan, however many rounds there were."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.schema, self.n = None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round; its own rows, read back."""
        self.schema, path = df.schema, f"{self.folder}/round={self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame | None:
        """The rows of all rounds; None before the first."""
        return self.spark.read.schema(self.schema).parquet(self.folder).drop("round") if self.n else None


def written_by(df: DataFrame, key: str, parts: int, tag: str) -> DataFrame:
    """Like ``written``, dealt by a key into ``parts`` buckets, so that what needs the
    rows of a key together reads them without another shuffle."""
    name, parts = f"llm_{tag}_{uuid.uuid4().hex}", min(parts, MAX_BUCKETS)
    (df.repartition(parts, key).write.format("parquet").option("compression", "zstd")
       .option("path", f"{shared_folder(df.sparkSession)}/{name}").bucketBy(parts, key).saveAsTable(name))
    return df.sparkSession.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
