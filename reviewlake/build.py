"""The batch build: landed offers and reviews → the published datasets.

    python -m reviewlake.build <offers> <reviews> <out> [format]

Writes ``catalog``, ``sentiment``, ``profile``, ``enriched`` and
``recommendations`` under ``out``. Every step is a distributed job; nothing
is collected to the driver.

``update_catalog`` and ``update_profile`` take a later batch into stored tables
instead: the mergeable partial aggregates (rollup, trait counts) are stored, and
only partitions that hold a product of the batch are read and written.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import catalog as cat
from reviewlake.operators import dashboard as dash
from reviewlake.operators import recommend as rec
from reviewlake.operators import sentiment as sm
from reviewlake.operators import traits as tr
from reviewlake.operators.review_profile import review_facts, review_profile
from reviewlake.sources.tables import read_offers, read_reviews, write_dataset
from reviewlake.streaming.stores import PARTS, derive_partitions, merge_partitions


def build(spark: SparkSession, offers: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """All published tables from offer observations and reviews."""
    catalog = cat.build_catalog(offers)
    facts = review_facts(reviews)
    model = sm.fit(sm.training_set(facts, key="prod_id", review_id="CID"),
                   review_id="CID", by_hash_split=True, evaluate=False)
    sentiment = sm.sentiment_counts(sm.predict(model.model, facts, key="prod_id"), "prod_id")
    profile = review_profile(reviews, sentiment, how="inner")
    enriched = dash.enrich(profile, catalog, how="inner")
    descriptions = enriched.select("prod_id", F.col("category3").alias("category"),
                                   F.col("short_desc").alias("description"))
    recos = rec.recommend(descriptions)
    return {"catalog": catalog, "sentiment": sentiment, "profile": profile,
            "enriched": enriched, "recommendations": recos}


def update_catalog(offers: DataFrame, batch_id: int, out: str, parts: int = PARTS) -> list[int]:
    """Take a batch of offers into ``out/catalog_rollup`` and ``out/catalog``; the partitions written."""
    rollup = cat.catalog_rollup(offers)
    merge_partitions(rollup, batch_id, f"{out}/catalog_rollup", "prod_id", cat.merge_rollup, parts)
    return derive_partitions(rollup, batch_id, f"{out}/catalog_rollup", f"{out}/catalog", "prod_id",
                             cat.catalog_dedupe, parts)


def update_profile(facts: DataFrame, batch_id: int, out: str, key: str, traits: Sequence[tr.Trait],
                   parts: int = PARTS) -> list[int]:
    """Take a batch of review facts into ``out/profile``; the partitions written."""
    return merge_partitions(tr.trait_counts(facts, key, traits), batch_id, f"{out}/profile", key,
                            lambda stored, rows: tr.merge_trait_counts(stored, rows, key), parts)


def run(spark: SparkSession, offers_path: str, reviews_path: str, out: str,
        fmt: str = "parquet") -> dict[str, str]:
    """Read the landed files, build, write each table; returns the paths."""
    tables = build(spark, read_offers(spark, offers_path, fmt), read_reviews(spark, reviews_path, fmt))
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out.rstrip('/')}/{name}"
        write_dataset(df, paths[name], fmt)
    return paths


if __name__ == "__main__":
    from reviewlake.session import local_session
    args = sys.argv[1:]
    if len(args) < 3:
        raise SystemExit(__doc__)
    run(local_session(), *args)
