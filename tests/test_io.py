"""Sources and sinks: distributed writes round-trip; labels map."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import expr as X
from reviewlake.plans import QUERIES
from reviewlake.sources import tables

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_catalog_and_profile_round_trip(spark, tmp_path):
    cat = QUERIES["catalog_dedupe"](spark, D)
    prof = QUERIES["profile"](spark, D)
    for fmt in ("parquet", "json"):
        tables.write_dataset(cat, str(tmp_path / f"catalog.{fmt}"), fmt)
        back = tables.read_dataset(spark, str(tmp_path / f"catalog.{fmt}"), fmt, cat.schema)
        assert rows(back) == rows(cat)
    tables.write_dataset(prof, str(tmp_path / "profile"), "parquet", partition_by=None)
    assert rows(spark.read.parquet(str(tmp_path / "profile"))) == rows(prof)


def test_offer_reader_declared_schema_and_nan(spark, tmp_path):
    off = QUERIES["load_offers"](spark, D).limit(5)
    src = off.select(*[c for c in off.columns if c != "imageUrl"],
                     F.struct(F.col("imageUrl")).alias("skuImages"),
                     F.when(F.lit(True), F.lit(float("nan"))).alias("rating2"))
    src = src.drop("rating").withColumnRenamed("rating2", "rating")
    tables.write_dataset(src, str(tmp_path / "offers"))
    back = tables.read_offers(spark, str(tmp_path / "offers"))
    assert back.schema.fieldNames()[:3] == ["skuId", "listPrice", "targetUrl"]
    assert back.where(F.col("rating").isNotNull()).count() == 0


def test_locale_labels(spark):
    df = spark.createDataFrame([("en_US",), ("en_CA",), ("fr_FR",)], "l string")
    got = [r.c for r in df.select(X.map_label("l", {"en_US": "United State",
                                                     "en_CA": "Canada"}).alias("c")).collect()]
    assert got == ["United State", "Canada", "fr_FR"]


def test_materialized_tables_are_released(spark):
    from reviewlake.operators.tfidf import materialize, release_materialized
    release_materialized(spark)
    df = materialize(spark.range(10))
    assert df.count() == 10
    assert release_materialized(spark) == 1
    assert release_materialized(spark) == 0


def test_sitemap_files_with_the_xml_source(spark, tmp_path):
    from reviewlake.sources import pages as pg
    xml = ('<?xml version="1.0" encoding="UTF-8"?>\n<urlset>'
           '<url><loc>https://shop.example.com/product/a-P1</loc><lastmod>2024-01-01</lastmod></url>'
           '<url><loc> https://shop.example.com/product/b-P2 </loc></url></urlset>')
    (tmp_path / "sitemap.xml").write_text(xml)
    got = pg.read_sitemap(spark, str(tmp_path / "sitemap.xml")).collect()
    assert [r.url for r in got] == ["https://shop.example.com/product/a-P1",
                                    "https://shop.example.com/product/b-P2"]
    only = pg.read_sitemap(spark, str(tmp_path / "sitemap.xml"), contains=["b-"]).collect()
    assert [r.url for r in only] == ["https://shop.example.com/product/b-P2"]
