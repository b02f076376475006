"""Queries: reviewer-trait profiles (pivot, single pass, join chain, long form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.build import update_profile
from reviewlake.operators import sentiment as sm
from reviewlake.operators import traits as tr
from reviewlake.operators.catalog import build_catalog
from reviewlake.plans import sql, standins
from reviewlake.plans.registry import query
from reviewlake.sources.tables import read_table
from reviewlake.streaming.jobs import scratch_paths
from reviewlake.streaming.stores import read_merged

TRAITS = standins.STANDIN_TRAITS


def tr_values(family: str) -> list:
    return list(standins.TRAIT_BY_FAMILY[family].values)


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return standins.reviews(spark, d).withColumnRenamed("ProdID", "prod_id")


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Wide profile of all trait families, one aggregate."""
    return tr.trait_counts(_reviews(spark, d), "prod_id", TRAITS)


PROFILE_SQL = f"""
SELECT ProdID AS prod_id,
       {sql.trait_count_columns(TRAITS)}
FROM ({sql.REVIEWS}) WHERE ProdID IS NOT NULL GROUP BY ProdID
"""

query("profile", PROFILE_SQL)(profile)


@query("profile_join_chain", PROFILE_SQL)
def profile_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Same table, built as one pivot per family joined on the product."""
    return tr.profile_join_chain(_reviews(spark, d), "prod_id", TRAITS)


@query("merge_profile", PROFILE_SQL)
def merge_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile after three batches of reviews, each merged into the stored counts of the
    products that it concerns: the one-shot table."""
    out, _ = scratch_paths(spark, "merge_profile")
    for n, rows in enumerate(standins.in_batches(_reviews(spark, d), "Date", ("1994-06-01", "1996-06-01"))):
        update_profile(rows, n, out, "prod_id", TRAITS, parts=8)
    return read_merged(spark, f"{out}/profile")


@query("load_reviews", f"SELECT CID, ProdID, url, Rating, ContentLocale, Date FROM ({sql.REVIEWS})")
def load_reviews(spark: SparkSession, d: str) -> DataFrame:
    return standins.reviews(spark, d).select("CID", "ProdID", "url", "Rating",
                                             "ContentLocale", "Date")


@query("trait_pivot", """
SELECT 'P' || CAST(l_partkey AS VARCHAR) AS prod_id,
       nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS A,
       nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS N,
       nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS R
FROM lineitem GROUP BY l_partkey
""")
def trait_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Pivot: one count column per declared return flag."""
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_returnflag"])
    li = li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("prod_id"),
                   "l_returnflag")
    return tr.trait_pivot(li, "prod_id", "l_returnflag", tr_values("flag"))


def _family_query(t: tr.Trait):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return tr.trait_counts(_reviews(spark, d), "prod_id", [t])
    run.__name__ = f"trait_pivot_{t.family}"
    run.__doc__ = f"Counts per product for the declared values of {t.column}."
    sql_text = (f"SELECT ProdID AS prod_id,\n       {sql.trait_count_columns([t])}\n"
                f"FROM ({sql.REVIEWS}) WHERE ProdID IS NOT NULL GROUP BY ProdID")
    return query(f"trait_pivot_{t.family}", sql_text)(run)


for _t in TRAITS:
    _family_query(_t)


TRAIT_LONG_SQL = f"""
WITH p AS ({PROFILE_SQL})
{sql.trait_long_rows(TRAITS, 'p', 'prod_id')}
"""


@query("trait_long", TRAIT_LONG_SQL)
def trait_long(spark: SparkSession, d: str) -> DataFrame:
    return tr.trait_long(profile(spark, d), "prod_id", TRAITS)


@query("trait_share", f"""
WITH l AS ({TRAIT_LONG_SQL})
SELECT prod_id, family, value, n,
       n / sum(n) OVER (PARTITION BY prod_id, family) AS share
FROM l
""")
def trait_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of each value within its family, per product (the pie charts)."""
    return tr.trait_share(trait_long(spark, d), "prod_id")


@query("category_trait", f"""
WITH l AS ({TRAIT_LONG_SQL}),
c AS ({sql.CATALOG}),
f AS (SELECT prod_id, CASE category1
        {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in standins.STANDIN_CATEGORY_FAMILY.items())}
        ELSE '{standins.STANDIN_OTHER_FAMILY}' END AS family FROM c)
SELECT l.prod_id, l.family, l.value, l.n,
       CAST(row_number() OVER (PARTITION BY l.prod_id ORDER BY l.n DESC, l.value ASC)
            AS INTEGER) AS rank
FROM l JOIN f ON l.prod_id = f.prod_id AND l.family = f.family
WHERE l.n > 0
""")
def category_trait(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the family the product's root category selects, zeros dropped."""
    catalog = build_catalog(standins.offers(spark, d))
    return tr.category_traits(trait_long(spark, d), catalog, "prod_id", "category1",
                              standins.STANDIN_CATEGORY_FAMILY,
                              standins.STANDIN_OTHER_FAMILY)


# Review texts keyed like the catalogue: the document's id is a product id.
PRODUCT_SENTIMENT_SQL = f"""
SELECT 'P' || CAST(review_id AS VARCHAR) AS prod_id,
       nullif(count(*) FILTER (WHERE Rating = 1), 0) AS sentiment__BadSentiment,
       nullif(count(*) FILTER (WHERE Rating = 5), 0) AS sentiment__GoodSentiment
FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL GROUP BY 1
"""


def _profile_sentiment(spark: SparkSession, d: str, how: str) -> DataFrame:
    texts = sm.with_text(standins.review_texts(spark, d)).select(
        F.concat(F.lit("P"), F.col("review_id").cast("string")).alias("prod_id"),
        sm.rating_label().cast("double").alias("prediction"))
    return profile(spark, d).join(tr.trait_counts(texts, "prod_id", [sm.SENTIMENT]), "prod_id", how)


@query("profile_sentiment", f"SELECT * FROM ({PROFILE_SQL}) JOIN ({PRODUCT_SENTIMENT_SQL}) USING (prod_id)")
def profile_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Profile joined to the sentiment counts; products without scored text go."""
    return _profile_sentiment(spark, d, "inner")


@query("profile_sentiment_left",
       f"SELECT * FROM ({PROFILE_SQL}) LEFT JOIN ({PRODUCT_SENTIMENT_SQL}) USING (prod_id)")
def profile_sentiment_left(spark: SparkSession, d: str) -> DataFrame:
    """The same, keeping products without scored text."""
    return _profile_sentiment(spark, d, "left")
