"""File sources and sinks for the domain tables.

Every reader declares its schema and returns a lazy DataFrame; callers
select columns so only those reach the Parquet ``ReadSchema``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake import schemas
from reviewlake.constants import ATTRIBUTE_KEYS


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One Parquet table of a data folder, optionally projected. How a scan is
    cut into tasks is left to the session's file-split settings and AQE."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _nan_free(df: DataFrame) -> DataFrame:
    """NaN → null in every double column (aggregates then skip them)."""
    return df.select(*[
        F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def read_offers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Offer observations; store ids are not part of the schema."""
    return _nan_free(spark.read.schema(schemas.OFFER).format(fmt).load(path))


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reviews with their context-attribute map.

    Landed reviews hold the attributes as a map, or flat, as columns of their
    own; flat ones are gathered into the map (absent attributes are not in it).
    """
    schema = T.StructType([*schemas.REVIEW.fields,
                           *(T.StructField(k, T.StringType()) for k in ATTRIBUTE_KEYS)])
    df = spark.read.schema(schema).format(fmt).load(path)
    flat = F.map_filter(F.create_map(*[x for k in ATTRIBUTE_KEYS for x in (F.lit(k), F.col(k))]),
                        lambda _, v: v.isNotNull())
    attributes = F.coalesce(F.col("attributes"), flat)
    return _nan_free(df.withColumn("attributes", attributes).drop(*ATTRIBUTE_KEYS))


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> None:
    """Distributed write; nothing is collected to the driver."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
