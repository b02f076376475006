"""Incremental crawl state as batch jobs: review dedupe, price history and the
page frontier. Streaming versions live in ``reviewlake.streaming``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, MutableSet, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.constants import REVIEW_PAGE_SIZE
from reviewlake.functions.expr import (page_offsets, product_id_from_api_url,
                                       product_id_from_url, review_api_url)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- X1: keep the first review per id ---------------------------------------

def _order_key(order: Sequence[str]):
    return F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])


def first_seen(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the first by ``order`` (arrival), later ones dropped.

    ``min_by(row, order)`` aggregates partially before the shuffle, so one
    hot id costs one row per map task; the row may hold any type (maps too),
    only ``order`` is compared — give it a unique tiebreak. Null ids form one
    group, so a single null-id row is kept, as the store's lookup did.
    """
    best = F.min_by(F.struct(*rows.columns), _order_key(order)).alias("row")
    return rows.groupBy(F.col(key).alias("__k")).agg(best).select("row.*")


# --- X2: price history ------------------------------------------------------

def price_history(obs: DataFrame, sku: str = "sku_id", price: str = "price",
                  ts: str = "ts", tiebreak: str = "obs_id",
                  attrs: Sequence[str] = ("attrs",)) -> DataFrame:
    """Clean history: one record per (SKU, price) with first and last
    sighting, count, and the attributes of the latest sighting."""
    latest = F.max_by(F.struct(*[F.col(a) for a in attrs]), _order_key([ts, tiebreak]))
    return obs.groupBy(sku, price).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("n_obs"), latest.alias("__l"),
    ).select(sku, price, "first_seen", "last_seen", "n_obs",
             *[F.col(f"__l.{a}").alias(a) for a in attrs])


def insert_unseen(stored: DataFrame, batch: DataFrame, key: str,
                  order: Sequence[str]) -> DataFrame:
    """The rows of ``batch`` to insert: the first per ``key`` whose key is not
    stored yet. A null key meets a stored null key, so one null-id row is ever
    kept. Only the stored keys are read."""
    known = stored.select(F.col(key).alias("__known")).distinct()
    return first_seen(batch, key, order).join(
        known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")


def merge_price_history(stored: DataFrame | None, batch: DataFrame, sku: str = "sku_id",
                        price: str = "price", ts: str = "ts", tiebreak: str = "obs_id",
                        attrs: Sequence[str] = ("attrs",)) -> DataFrame:
    """The stored (SKU, price) records updated with a batch of observations.

    ``stored`` has the columns of ``price_history``; known pairs get their
    last sighting, count and attributes, new pairs are added. Of equal last
    sightings the batch's counts as the later one.
    """
    new = price_history(batch, sku, price, ts, tiebreak, attrs)
    if stored is None:
        return new
    both = (stored.select(new.columns).withColumn("__new", F.lit(0))
            .unionByName(new.withColumn("__new", F.lit(1))))
    latest = F.max_by(F.struct(*[F.col(a) for a in attrs]), _order_key(["last_seen", "__new"]))
    return both.groupBy(sku, price).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("n_obs").alias("n_obs"), latest.alias("__l"),
    ).select(sku, price, "first_seen", "last_seen", "n_obs",
             *[F.col(f"__l.{a}").alias(a) for a in attrs])


def latest_record(obs: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """Latest row per key by (ts, tiebreak); partial-aggregated ``max_by``."""
    best = F.max_by(F.struct(*obs.columns), _order_key([ts, tiebreak])).alias("row")
    return obs.groupBy(F.col(key).alias("__k")).agg(best).select("row.*")


def keep_last(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the last in ascending ``order`` (``max_by``, the
    mirror of ``first_seen``)."""
    best = F.max_by(F.struct(*rows.columns), _order_key(order)).alias("row")
    return rows.groupBy(F.col(key).alias("__k")).agg(best).select("row.*")


class SkuFold:
    """The store's upsert rule for one SKU, observation by observation.

    A new price inserts a record; a known price rewrites the record that was
    updated last, which then takes this price. In processing order that is
    always the newest record and the older ones never change again, so the
    state is the set of the older records' prices and the newest record; a
    record is final once the next one is inserted.
    """

    def __init__(self, frozen: MutableSet | None = None, current: tuple | None = None, number: int = -1) -> None:
        self.frozen, self.current, self.number = set() if frozen is None else frozen, current, number

    def add(self, price, ts, attrs: tuple) -> tuple | None:
        """Apply one observation; the record that became final by it, if any."""
        cur = self.current
        if cur is not None and (price == cur[0] or price in self.frozen):
            self.current = (price, cur[1], ts, *attrs)
            return None
        if cur is not None:
            self.frozen.add(cur[0])
        self.current, self.number = (price, ts, ts, *attrs), self.number + 1
        return cur


def price_history_compat(obs: DataFrame, sku: str = "sku_id", price: str = "price",
                         ts: str = "ts", tiebreak: str = "obs_id",
                         attrs: Sequence[str] = ("attrs",)) -> DataFrame:
    """The store's exact upsert fold (A→B→A rewrites B to A).

    The rule is sequential per SKU: rows are hash-partitioned on the SKU,
    sorted within partitions (the sort spills) and streamed through in Arrow
    batches. A task holds one SKU's older prices and newest record; records
    leave as soon as they are final. Column types are the input's.
    """
    attrs = list(attrs)
    fields = {f.name: f.dataType for f in obs.schema.fields}
    schema = T.StructType([T.StructField(n, t) for n, t in [
        (sku, fields[sku]), (price, fields[price]), ("first_seen", fields[ts]),
        ("updated", fields[ts]), *[(a, fields[a]) for a in attrs]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out, arrow = None, None, [], None

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=pa.schema(arrow))
            out.clear()
            return made

        for batch in batches:
            if arrow is None:
                types = [batch.schema.field(i).type for i in (0, 1, 2, 2, *range(4, 4 + len(attrs)))]
                arrow = [pa.field(f.name, t) for f, t in zip(schema.fields, types, strict=True)]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if fold is None or row[0] != key:
                    if fold is not None:
                        out.append((key, *fold.current))
                    key, fold = row[0], SkuFold()
                final = fold.add(row[1], row[2], row[4:])
                if final is not None:
                    out.append((key, *final))
            if len(out) > 10_000:
                yield flush()
        if fold is not None:
            out.append((key, *fold.current))
            yield flush()

    ordered = (obs.select(sku, price, ts, tiebreak, *attrs).repartition(F.col(sku))
               .sortWithinPartitions(sku, ts, tiebreak))
    return ordered.mapInArrow(run, schema)


# --- X3: review pages still to fetch ----------------------------------------

def page_plan(offers: DataFrame, page_size: int = REVIEW_PAGE_SIZE,
              include_tail: bool = False, url: str = "targetUrl",
              reviews: str = "reviews", with_request: bool = True) -> DataFrame:
    """(product, offset) pages to fetch for every distinct (product, reviews).

    Overlapping plans from differing review counts collapse in the distinct.
    ``priority`` is the product's greatest review count, the crawl's order.
    """
    pr = offers.select(product_id_from_url(url).alias("prod_id"),
                       F.col(reviews).cast("bigint").alias("reviews")).distinct()
    plan = (pr.select("prod_id", "reviews", F.explode(page_offsets("reviews", page_size, include_tail))
                      .alias("offset")).groupBy("prod_id", "offset")
            .agg(F.max("reviews").alias("priority")))
    if with_request:
        plan = plan.withColumn("request_url", review_api_url("prod_id", "offset",
                                                             page_size=page_size))
    return plan


def fetched_pages(reviews: DataFrame, url: str = "url") -> DataFrame:
    """(product, offset) of the pages already stored, read from review URLs.

    URLs without a product or offset give null keys, which match no planned
    page in the anti join; they need no filter of their own.
    """
    u = F.col(url)
    return reviews.select(
        product_id_from_api_url(url).alias("prod_id"),
        F.regexp_extract(u, r"[?&]offset=(\d+)", 1).try_cast("int").alias("offset"),
    ).distinct()


def frontier(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """Planned pages minus fetched pages, keyed on (product, offset); no
    credential is part of the key."""
    return plan.join(fetched, ["prod_id", "offset"], "left_anti")


def frontier_ranges(offers: DataFrame, fetched: DataFrame, page_size: int = REVIEW_PAGE_SIZE,
                    include_tail: bool = False, url: str = "targetUrl",
                    reviews: str = "reviews") -> DataFrame:
    """(prod_id, first_offset, last_offset, n_pages, priority): the missing pages of each product
    as ranges, without a row per planned page.

    A product's plan is the interval of its greatest review count, which holds those of
    smaller counts. Its fetched pages cut the interval; what lies between one and the
    next is missing.
    """
    r = F.col(reviews).cast("bigint")
    pages = F.ceil(r / page_size) if include_tail else F.floor(r / page_size)
    plan = (offers.select(product_id_from_url(url).alias("prod_id"), r.alias("priority"), pages.alias("n"))
            .groupBy("prod_id").agg(F.max("priority").alias("priority"), F.max("n").alias("n")).where("n > 0"))
    page = (F.col("offset") / page_size).cast("bigint")
    done = (fetched.where(F.col("offset") % page_size == 0).select("prod_id", page.alias("page")).distinct()
            .join(plan, "prod_id").where("page BETWEEN 0 AND n - 1"))
    marks = plan.withColumn("page", F.lit(-1).cast("bigint")).unionByName(done)
    following = F.lead("page").over(Window.partitionBy("prod_id").orderBy("page"))
    gaps = marks.select("prod_id", "priority", (F.col("page") + 1).alias("first"),
                        (F.coalesce(following, F.col("n")) - 1).alias("last")).where("first <= last")
    return gaps.select("prod_id", (F.col("first") * page_size).cast("int").alias("first_offset"),
                       (F.col("last") * page_size).cast("int").alias("last_offset"),
                       (F.col("last") - F.col("first") + 1).alias("n_pages"), "priority")


def expand_ranges(ranges: DataFrame, page_size: int = REVIEW_PAGE_SIZE) -> DataFrame:
    """The pages of missing ranges, with their requests: the rows of ``frontier``."""
    offsets = F.sequence("first_offset", "last_offset", F.lit(page_size))
    return (ranges.select("prod_id", F.explode(offsets).alias("offset"), "priority")
            .withColumn("request_url", review_api_url("prod_id", "offset", page_size=page_size)))
