"""Scalar column expressions.

Every function takes and returns a ``Column`` built from ``pyspark.sql.functions``
only, so it stays inside whole-stage codegen. No Python UDF anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.constants import API_PRODUCT_ID_PATTERN, REVIEW_PAGE_SIZE


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def product_id_from_url(url: Column | str, sep: str = "-") -> Column:
    """Last ``sep``-separated part of a product URL, cut at the query string.

    ``/p/red-lip-P123?skuId=4`` → ``P123``. Null URL → null.
    """
    return F.substring_index(F.substring_index(_c(url), sep, -1), "?", 1)


def product_id_from_api_url(url: Column | str,
                            pattern: str = API_PRODUCT_ID_PATTERN) -> Column:
    """Regex capture group 1 of ``pattern``; no match → null (not ``''``)."""
    return F.nullif(F.regexp_extract(_c(url), pattern, 1), F.lit(""))


def parse_money(text: Column | str, strict: bool = False) -> Column:
    """``"$12.00"`` → 12.0. Text that is not a plain number (``"$1,200.00"``)
    gives null, or raises when ``strict``."""
    body = F.replace(_c(text), F.lit("$"), F.lit(""))
    return body.cast("double") if strict else body.try_cast("double")


def strip_query(url: Column | str) -> Column:
    """URL without its query string."""
    return F.substring_index(_c(url), "?", 1)


def strip_tags(html: Column | str, replacement: str = ",") -> Column:
    """Replace every HTML tag by ``replacement`` (default a comma)."""
    return F.regexp_replace(_c(html), r"<[^>]*>", replacement)


def image_url(path: Column | str, base: str = "https://shop.example.com",
              width: int = 200) -> Column:
    """Absolute image URL with a width parameter."""
    return F.concat(F.lit(base), _c(path), F.lit(f"?imwidth={width}"))


def round_half_even(x: Column | str, digits: int = 2) -> Column:
    """Banker's rounding, as the dashboards' numeric rounding does."""
    return F.bround(_c(x), digits)


def mean_half_even(x: Column | str, digits: int = 2) -> Column:
    """Aggregate: mean rounded half-even, computed in decimal so a mean that
    sits exactly on a tie (0.125) rounds the same on every engine."""
    exact = F.avg(_c(x).cast("decimal(30,10)"))
    return F.bround(exact, digits).cast("double")


def page_floor(reviews: Column | str, page_size: int = REVIEW_PAGE_SIZE) -> Column:
    """Largest multiple of ``page_size`` not above ``reviews``, as int."""
    r = _c(reviews)
    return (r - F.pmod(r, F.lit(page_size))).cast("int")


def page_offsets(reviews: Column | str, page_size: int = REVIEW_PAGE_SIZE,
                 include_tail: bool = False) -> Column:
    """Array of page offsets ``0, n, 2n, …`` to fetch for ``reviews`` reviews.

    The default reproduces the crawler: offsets stop below
    ``reviews - reviews % n``, so the last, partial page is never planned and
    fewer than ``n`` reviews plan nothing (0 → none, 99 → none, 100 → 0,
    250 → 0, 100). ``include_tail`` plans every page that holds a review
    (250 → 0, 100, 200). The sequence is guarded: ``sequence(0, -n, n)``
    would raise.
    """
    r = _c(reviews)
    stop = (page_floor(r - F.lit(1), page_size) if include_tail
            else page_floor(r, page_size) - F.lit(page_size))
    return F.when(stop >= 0, F.sequence(F.lit(0), stop.cast("int"), F.lit(page_size))) \
        .otherwise(F.array().cast("array<int>"))


def review_api_url(prod_id: Column | str, offset: Column | str,
                   base: str = "https://api.example.com/data/reviews.json",
                   page_size: int = REVIEW_PAGE_SIZE) -> Column:
    """Request URL for one page of a product's reviews; no credential in it."""
    return F.format_string(
        f"{base}?Filter=contentlocale%%3Aen*&Filter=ProductId%%3A%s"
        f"&Sort=SubmissionTime%%3Adesc&Limit={page_size}&offset=%d",
        _c(prod_id), _c(offset).cast("int"))


def map_label(col: Column | str, labels: Mapping[str, str]) -> Column:
    """Replace values by labels (e.g. locale code → country); others kept."""
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(col)), _c(col))


def nan_to_null(x: Column | str) -> Column:
    """NaN → null so max/avg skip it like the in-memory frame did."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)
