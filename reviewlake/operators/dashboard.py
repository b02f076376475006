"""The tables behind the brand and product dashboards, for all brands and
products at once (a dashboard filters the result; it does not recompute it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.expr import image_url, map_label, mean_half_even, round_half_even
from reviewlake.operators.traits import ranked


def enrich(profile: DataFrame, catalog: DataFrame, key: str = "prod_id",
           how: str = "inner") -> DataFrame:
    """Profile joined to the catalogue.

    ``inner`` equals the surveyed left join followed by dropping rows without
    a product name; ``left`` keeps profiles of products not in the catalogue.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    return profile.join(catalog, key, how)


def brand_kpi(catalog: DataFrame) -> DataFrame:
    """Per brand: distinct product names, mean rating and mean loves (2 dp,
    half-even)."""
    return catalog.groupBy("brand").agg(
        F.count_distinct("name").alias("n_items"),
        mean_half_even("rating", 2).alias("avg_rating"),
        mean_half_even("loves_count", 2).alias("avg_loves"),
    )


def brand_category_mix(catalog: DataFrame) -> DataFrame:
    """Products per (brand, root category) and their share of the brand."""
    mix = catalog.groupBy("brand", "category1").agg(F.count(F.lit(1)).alias("n"))
    return mix.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("brand")))


def brand_price_hist(catalog: DataFrame) -> DataFrame:
    """One price per (brand, product name): the row with the lowest product id,
    sorted by price within the brand (a distributed range sort; no per-brand
    window, so a brand with most of the catalogue is not one task)."""
    first = catalog.groupBy("brand", "name").agg(
        F.min_by("price", "prod_id").alias("price"))
    return first.orderBy("brand", F.asc_nulls_last("price"), "name")


def brand_scatter(catalog: DataFrame) -> DataFrame:
    """Reviews against loves, one point per product."""
    return catalog.select("brand", "prod_id", "reviews", "loves_count")


def brand_scatter_corr(catalog: DataFrame) -> DataFrame:
    """Per brand: points in the scatter and the reviews–loves correlation."""
    return catalog.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.round(F.corr(F.col("reviews").cast("double"), F.col("loves_count").cast("double")),
                9).alias("corr_reviews_loves"))


def brand_list(catalog: DataFrame) -> DataFrame:
    """Distinct brands, sorted."""
    return catalog.select("brand").where(F.col("brand").isNotNull()).distinct().orderBy("brand")


def brand_products(catalog: DataFrame) -> DataFrame:
    """Distinct product names per brand (the product picker), sorted by a range sort."""
    return (catalog.select("brand", "name").where(F.col("name").isNotNull()).distinct()
            .orderBy("brand", "name"))


def default_product(catalog: DataFrame) -> DataFrame:
    """Per brand the first product name in sort order (the picker's default)."""
    return catalog.groupBy("brand").agg(F.min("name").alias("name"))


def product_card(catalog: DataFrame, base_url: str = "https://shop.example.com",
                 width: int = 200) -> DataFrame:
    """Card fields per (brand, name); the first match is the lowest product id."""
    best = F.min(F.struct("prod_id", "sku_image", "price", "category1", "category2",
                          "category3", "reviews", "rating", "loves_count")).alias("r")
    c = catalog.groupBy("brand", "name").agg(best)
    return c.select(
        "brand", "name", F.col("r.prod_id").alias("prod_id"),
        image_url(F.col("r.sku_image"), base_url, width).alias("image"),
        round_half_even("r.price", 3).alias("price"),
        F.col("r.category1").alias("category1"),
        F.col("r.category2").alias("category2"),
        F.col("r.category3").alias("category3"),
        F.col("r.reviews").cast("bigint").alias("reviews"),
        round_half_even("r.rating", 2).alias("rating"),
        F.col("r.loves_count").cast("bigint").alias("loves_count"),
    )


def country_counts(reviews: DataFrame, key: str, locale: str,
                   labels: dict[str, str] | None = None) -> DataFrame:
    """Reviews per (product, country), country labelled from the locale; ``rank``
    orders a product's countries by reviews, descending."""
    country = map_label(locale, labels) if labels else F.col(locale)
    counts = (reviews.where(F.col(key).isNotNull())
              .groupBy(F.col(key), country.alias("country")).agg(F.count(F.lit(1)).alias("n")))
    return ranked(counts, key, "n", "country")
