"""Queries: offers → catalogue, enrichment and the dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.build import update_catalog
from reviewlake.functions import expr as X
from reviewlake.operators import catalog as cat
from reviewlake.operators import dashboard as dash
from reviewlake.plans import sql, standins
from reviewlake.plans.profile import PROFILE_SQL, profile
from reviewlake.plans.registry import query
from reviewlake.sources.tables import read_table
from reviewlake.streaming.jobs import scratch_paths
from reviewlake.streaming.stores import read_merged

OFFER_COLUMNS = ["skuId", "listPrice", "targetUrl", "size", "name", "brand", "shortDesc",
                 "Category1", "Category2", "Category3", "lovesCount", "reviews", "rating",
                 "date", "update"]


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return cat.build_catalog(standins.offers(spark, d))


def maxima(spark: SparkSession, d: str, *metrics: str) -> DataFrame:
    """The catalogue with the metrics that a dashboard reads (not the group sizes)."""
    return cat.catalog_maxima(standins.offers(spark, d), metrics)


@query("load_offers", f"SELECT * FROM ({sql.OFFERS})")
def load_offers(spark: SparkSession, d: str) -> DataFrame:
    o = standins.offers(spark, d)
    return o.select(*OFFER_COLUMNS, F.col("skuImages.imageUrl").alias("imageUrl"))


@query("catalog_rollup", sql.CATALOG_ROLLUP)
def catalog_rollup(spark: SparkSession, d: str) -> DataFrame:
    return cat.catalog_rollup(standins.offers(spark, d))


query("catalog_dedupe", sql.CATALOG)(catalog)


@query("merge_catalog", sql.CATALOG)
def merge_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after three batches of offers, each merged into the stored rollup and
    catalogue of the products that it concerns: the one-shot table."""
    offers = standins.offers(spark, d)
    out, _ = scratch_paths(spark, "merge_catalog")
    for n, rows in enumerate(standins.in_batches(offers, "date", MERGE_DATES)):
        update_catalog(rows, n, out, parts=8)
    return read_merged(spark, f"{out}/catalog")


MERGE_DATES = ("1994-06-01", "1996-06-01")


@query("price_rejects", f"""
SELECT brand, count(*) AS n_rejected FROM (
  SELECT brand, TRY_CAST(replace(p, '$', '') AS DOUBLE) AS price, p FROM (
    SELECT brand, CASE WHEN CAST(substr(listPrice, 2) AS DECIMAL(18,2)) >= 50000
                       THEN printf('$%,.2f', CAST(substr(listPrice, 2) AS DOUBLE)) ELSE listPrice END AS p
    FROM ({sql.OFFERS}))) WHERE p IS NOT NULL AND price IS NULL GROUP BY brand
""")
def price_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Offers per brand whose price does not parse: large prices are shown here with a
    thousands separator."""
    o = standins.offers(spark, d)
    value = F.substring("listPrice", 2, 30).cast("decimal(18,2)")
    shown = F.when(value >= 50000, F.format_string("$%,.2f", value.cast("double"))).otherwise(F.col("listPrice"))
    return (cat.price_rejects(o.withColumn("listPrice", shown)).groupBy("brand")
            .agg(F.count(F.lit(1)).alias("n_rejected")))


@query("price_parse", """
SELECT p_partkey, p_retailprice,
       TRY_CAST(replace(printf('$%.2f', p_retailprice), '$', '') AS DOUBLE) AS price,
       TRY_CAST(replace(printf('$%,.2f', p_retailprice), '$', '') AS DOUBLE) AS price_grouped
FROM part
""")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    """Money strings → double; thousands separators do not parse (null)."""
    p = read_table(spark, d, "part", ["p_partkey", "p_retailprice"])
    return p.select("p_partkey", "p_retailprice",
                    X.parse_money(F.format_string("$%.2f", "p_retailprice")).alias("price"),
                    X.parse_money(F.format_string("$%,.2f", "p_retailprice"))
                    .alias("price_grouped"))


ENRICH_SQL = f"""
WITH p AS ({PROFILE_SQL}), c AS ({sql.CATALOG})
SELECT * FROM p JOIN c USING (prod_id)
"""


@query("enrich", ENRICH_SQL)
def enrich(spark: SparkSession, d: str) -> DataFrame:
    """Profile ⋈ catalogue: the table the product dashboard reads."""
    return dash.enrich(profile(spark, d), catalog(spark, d), "prod_id", "inner")


@query("enrich_left", f"""
WITH p AS ({PROFILE_SQL}), c AS ({sql.CATALOG})
SELECT * FROM p LEFT JOIN c USING (prod_id)
""")
def enrich_left(spark: SparkSession, d: str) -> DataFrame:
    return dash.enrich(profile(spark, d), catalog(spark, d), "prod_id", "left")


@query("brand_kpi", f"""
SELECT brand, count(DISTINCT name) AS n_items,
       {sql.mean_half_even('rating')} AS avg_rating,
       {sql.mean_half_even('loves_count')} AS avg_loves
FROM ({sql.CATALOG}) GROUP BY brand
""")
def brand_kpi(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_kpi(maxima(spark, d, "rating", "loves_count"))


@query("brand_category_mix", f"""
WITH m AS (SELECT brand, category1, count(*) AS n FROM ({sql.CATALOG}) GROUP BY ALL)
SELECT brand, category1, n, n / sum(n) OVER (PARTITION BY brand) AS share FROM m
""")
def brand_category_mix(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_category_mix(maxima(spark, d))


@query("brand_price_hist", f"""
SELECT brand, name, arg_min(price, prod_id) AS price
FROM ({sql.CATALOG}) GROUP BY ALL
""")
def brand_price_hist(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_price_hist(maxima(spark, d, "price"))


@query("brand_scatter", f"SELECT brand, prod_id, reviews, loves_count FROM ({sql.CATALOG})")
def brand_scatter(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_scatter(maxima(spark, d, "reviews", "loves_count"))


@query("brand_scatter_corr", f"""
SELECT brand, count(*) AS n_points,
       round(corr(CAST(reviews AS DOUBLE), CAST(loves_count AS DOUBLE)), 9) AS corr_reviews_loves
FROM ({sql.CATALOG}) GROUP BY brand
""")
def brand_scatter_corr(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_scatter_corr(maxima(spark, d, "reviews", "loves_count"))


@query("brand_list", f"SELECT DISTINCT brand FROM ({sql.CATALOG}) WHERE brand IS NOT NULL")
def brand_list(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_list(maxima(spark, d))


@query("brand_products",
       f"SELECT DISTINCT brand, name FROM ({sql.CATALOG}) WHERE name IS NOT NULL")
def brand_products(spark: SparkSession, d: str) -> DataFrame:
    return dash.brand_products(maxima(spark, d))


@query("default_product", f"SELECT brand, min(name) AS name FROM ({sql.CATALOG}) GROUP BY brand")
def default_product(spark: SparkSession, d: str) -> DataFrame:
    return dash.default_product(maxima(spark, d))


@query("product_card", f"""
SELECT brand, name, prod_id, 'https://shop.example.com' || sku_image || '?imwidth=200' AS image,
       round_even(price, 3) AS price, category1, category2, category3, reviews,
       round_even(rating, 2) AS rating, loves_count
FROM (SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY prod_id) AS rn
      FROM ({sql.CATALOG})) WHERE rn = 1
""")
def product_card(spark: SparkSession, d: str) -> DataFrame:
    return dash.product_card(catalog(spark, d))


# Shown names of some of the stand-in locales (nation names); others keep theirs.
COUNTRY_LABELS = {"UNITED STATES": "United States", "CANADA": "Canada", "FRANCE": "France"}


@query("country_counts", f"""
WITH c AS (SELECT ProdID AS prod_id, CASE ContentLocale
             {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_LABELS.items())}
             ELSE ContentLocale END AS country, count(*) AS n
           FROM ({sql.REVIEWS}) WHERE ProdID IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY prod_id ORDER BY n DESC, country) AS INTEGER) AS rank
FROM c
""")
def country_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled countries of each product's reviews, most reviews first."""
    rv = standins.reviews(spark, d).withColumnRenamed("ProdID", "prod_id")
    return dash.country_counts(rv, "prod_id", "ContentLocale", COUNTRY_LABELS)
