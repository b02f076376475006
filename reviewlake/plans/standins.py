"""The driver's test tables, read as the domain tables they stand in for.

Mapping (see FIXTURES.md):

* offers   — lineitem ⋈ part: one SKU observation per line item.
* reviews  — lineitem ⋈ orders ⋈ customer ⋈ nation: one review per line item,
  reviewer traits from the order and the customer.
* texts    — documents ⟕ labels: review text per product (product = source),
  rating 5 / 1 from the quality label.
* descriptions — documents: product = doc_id, category = source, description
  = the whole text.
* price observations — events: SKU = user_id, price = event_type.
* crawled pages — pages.

Every derived column is a Spark expression over the table, so the work grows
with the tables; the DuckDB oracle (``plans.oracle``) rebuilds the same
columns with the same rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.traits import Trait
from reviewlake.sources.tables import read_table

# Trait families of the stand-in reviews (declared values, sorted).
STANDIN_TRAITS = [
    Trait("flag", "l_returnflag", ["A", "N", "R"]),
    Trait("line", "l_linestatus", ["F", "O"]),
    Trait("status", "o_orderstatus", ["F", "O", "P"]),
    Trait("priority", "o_orderpriority",
          ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    Trait("segment", "c_mktsegment",
          ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
]
TRAIT_BY_FAMILY = {t.family: t for t in STANDIN_TRAITS}

# Root category (p_type) → trait family shown for the product.
STANDIN_CATEGORY_FAMILY = {"ECONOMY": "flag", "LARGE": "status", "MEDIUM": "priority"}
STANDIN_OTHER_FAMILY = "line"

# Review page size of the stand-in API (reviews per offer are 1..50 here).
STANDIN_PAGE_SIZE = 10


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Raw offer observations in the crawler's shape."""
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_linenumber",
                                            "l_quantity", "l_extendedprice",
                                            "l_discount", "l_tax", "l_shipdate"])
    part = read_table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type",
                                          "p_size"])
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return j.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("skuId"),
        F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
         .alias("listPrice"),
        F.concat(F.lit("/product/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                 F.lit("-P"), F.col("p_partkey").cast("string"),
                 F.lit("?skuId="), F.col("l_suppkey").cast("string")).alias("targetUrl"),
        F.struct(F.concat(F.lit("/images/s"), F.col("l_suppkey").cast("string"),
                          F.lit(".jpg?pid="), F.col("l_linenumber").cast("string"))
                 .alias("imageUrl")).alias("skuImages"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("<p><b>"), F.col("p_type"), F.lit("</b> "), F.col("p_name"),
                 F.lit("</p>")).alias("shortDesc"),
        F.col("p_type").alias("Category1"),
        F.substring_index("p_name", " ", 1).alias("Category2"),
        F.substring_index("p_name", " ", -1).alias("Category3"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("lovesCount"),
        F.col("l_quantity").cast("bigint").alias("reviews"),
        F.col("l_discount").alias("rating"),
        F.col("l_shipdate").alias("date"),
        F.col("l_shipdate").alias("update"),
    )


def in_batches(rows: DataFrame, column: str, cuts: Sequence[str]) -> list[DataFrame]:
    """The rows in batches by ascending ``column``, cut at the given moments; nulls come first."""
    at = [F.lit(c).cast(rows.schema[column].dataType) for c in cuts]
    col = F.col(column)
    return [rows.where((col >= a) & (col < b)) if a is not None and b is not None else
            rows.where(col.isNull() | (col < b)) if a is None else rows.where(col >= a)
            for a, b in zip([None, *at], [*at, None], strict=True)]


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """One review per line item; traits from the order and the customer."""
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber",
                                            "l_quantity", "l_returnflag",
                                            "l_linestatus", "l_shipdate"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_orderpriority"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    # Orders meet their customers first: line items, many times as many, are dealt once.
    of = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "inner"))
    j = li.join(of, li.l_orderkey == F.col("o_orderkey"), "inner")
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("CID"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ProdID"),
        _review_url().alias("url"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("Rating"),
        F.col("n_name").alias("ContentLocale"),
        F.col("l_shipdate").alias("Date"),
        "l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment",
    )


def _review_url(partkey: str = "l_partkey", line: str = "l_linenumber"):
    return F.concat(F.lit("https://api.example.com/data/reviews.json?Filter=ProductId%3AP"),
                    F.col(partkey).cast("string"),
                    F.lit(f"&Limit={STANDIN_PAGE_SIZE}&offset="),
                    ((F.col(line) - 1) * STANDIN_PAGE_SIZE).cast("string"))


def review_pages(spark: SparkSession, d: str) -> DataFrame:
    """The stored reviews' page URLs: line items only (every line item has its
    order, so the trait joins of ``reviews`` would not change this set)."""
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_linenumber"])
    return li.select(_review_url().alias("url"))


def review_texts(spark: SparkSession, d: str) -> DataFrame:
    """Review text per product (product = document source)."""
    docs = read_table(spark, d, "documents", ["doc_id", "text", "source"])
    lab = read_table(spark, d, "labels", ["doc_id", "quality"])
    j = docs.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("ProdID"),
        F.col("text").alias("ReviewText"),
        F.when(F.col("quality") == 1, F.lit(5)).when(F.col("quality") == 0, F.lit(1))
         .cast("int").alias("Rating"),
    )


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Products to recommend from: whole document text as the description."""
    docs = read_table(spark, d, "documents", ["doc_id", "text", "source"])
    return docs.select(F.col("doc_id").alias("prod_id"), F.col("source").alias("category"),
                       F.col("text").alias("description"))


def price_observations(spark: SparkSession, d: str) -> DataFrame:
    """Offer price observations: SKU = user, price = event type."""
    ev = read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type",
                                          "value", "props"])
    return ev.select(F.col("event_id").alias("obs_id"),
                     "ts",
                     F.col("user_id").alias("sku_id"),
                     F.col("event_type").alias("price"),
                     F.col("value").alias("attrs"), "props")
