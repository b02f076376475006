"""Offer observations → product catalogue.

``catalog_rollup`` groups SKU observations on nine descriptive keys and keeps
the maxima of the numeric fields plus the group size (``variant``).
``catalog_dedupe`` keeps one row per product: the group that sorts last in
ascending key order. It is a ``max(struct(keys…))`` aggregate rather than a
window, so it aggregates partially before the shuffle and a product with very
many groups never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.expr import (nan_to_null, parse_money, product_id_from_url,
                                       strip_query, strip_tags)

GROUP_KEYS = ["prod_id", "name", "short_desc", "brand", "category1", "category2",
              "category3", "size", "sku_image"]
METRICS = ["reviews", "variant", "rating", "price", "loves_count"]
# An offer's columns that the keys come from: a key is null where its column is.
KEY_SOURCES = ["targetUrl", "name", "shortDesc", "brand", "Category1", "Category2",
               "Category3", "size", "skuImages.imageUrl"]


def normalize_offers(offers: DataFrame, strict_price: bool = False) -> DataFrame:
    """Offer observations with parsed keys: product id, price, image, text."""
    return offers.select(
        product_id_from_url("targetUrl").alias("prod_id"),
        F.col("name"),
        strip_tags("shortDesc").alias("short_desc"),
        F.col("brand"),
        F.col("Category1").alias("category1"),
        F.col("Category2").alias("category2"),
        F.col("Category3").alias("category3"),
        F.col("size"),
        strip_query(F.col("skuImages.imageUrl")).alias("sku_image"),
        F.col("reviews").cast("bigint").alias("reviews"),
        nan_to_null(F.col("rating").cast("double")).alias("rating"),
        nan_to_null(parse_money("listPrice", strict=strict_price)).alias("price"),
        F.col("lovesCount").cast("bigint").alias("loves_count"),
    )


def with_keys(offers: DataFrame) -> DataFrame:
    """The offers of which no key is null. Told by the raw columns, so that the keys are
    parsed once per row and not a second time for this filter."""
    return offers.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEY_SOURCES]))


def catalog_rollup(offers: DataFrame, strict_price: bool = False) -> DataFrame:
    """One row per distinct nine-key group; rows with any null key are dropped."""
    o = normalize_offers(with_keys(offers), strict_price)
    return o.groupBy(*GROUP_KEYS).agg(
        F.max("reviews").alias("reviews"),
        F.count(F.lit(1)).alias("variant"),
        F.max("rating").alias("rating"),
        F.max("price").alias("price"),
        F.max("loves_count").alias("loves_count"),
    )


def merge_rollup(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A stored rollup with that of a later batch: maxima of maxima, sums of sizes."""
    both = batch if stored is None else stored.select(batch.columns).unionByName(batch)
    return both.groupBy(*GROUP_KEYS).agg(
        *[(F.sum(m) if m == "variant" else F.max(m)).alias(m) for m in METRICS])


def catalog_dedupe(rollup: DataFrame) -> DataFrame:
    """Keep, per product, the group that is last in ascending key order."""
    rest = [k for k in GROUP_KEYS if k != "prod_id"]
    best = F.max(F.struct(*rest, *METRICS)).alias("best")
    return rollup.groupBy("prod_id").agg(best).select(
        "prod_id", *[F.col(f"best.{c}").alias(c) for c in rest + METRICS])


def build_catalog(offers: DataFrame, strict_price: bool = False) -> DataFrame:
    """Rollup then dedupe: unique on ``prod_id``."""
    return catalog_dedupe(catalog_rollup(offers, strict_price))


def catalog_maxima(offers: DataFrame, metrics: Sequence[str], strict_price: bool = False) -> DataFrame:
    """The catalogue with some of its maxima (all metrics but ``variant``, which is a count).

    The greatest (other keys, metric) of a product holds its last group and that group's
    maximum, nulls being least. So products are aggregated at once, partially before the
    only shuffle, which moves no rows of groups.
    """
    rest = [k for k in GROUP_KEYS if k != "prod_id"]
    o = normalize_offers(with_keys(offers), strict_price).select("prod_id", F.struct(*rest).alias("keys"), *metrics)
    best = [F.max("keys").alias("keys")] if not metrics else [F.max(F.struct("keys", m)).alias(m) for m in metrics]
    keys = f"{metrics[0]}.keys" if metrics else "keys"
    return o.groupBy("prod_id").agg(*best).select(
        "prod_id", *[F.col(f"{keys}.{c}").alias(c) for c in rest], *[F.col(f"{m}.{m}").alias(m) for m in metrics])


def price_rejects(offers: DataFrame) -> DataFrame:
    """Offers whose list price did not parse (count them, or show them)."""
    return offers.where(F.col("listPrice").isNotNull()
                        & parse_money("listPrice").isNull())
