"""Reviewer-trait profiles: per product, how many reviews carry each trait value.

The surveyed job builds ten pivots and joins them on the product id. Here the
same table is one grouped aggregate with one conditional count per declared
value: one scan, one shuffle on the product key, partial aggregation before
the shuffle (so a product holding a third of all reviews still sends one row
per map task). ``profile_join_chain`` keeps the pivot-and-join form for
equivalence checks.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trait:
    """A reviewer trait: the review column and its declared values.

    ``labels`` renames values in the output (``true`` → ``Recomended``).
    Output columns are ``<family>__<label>`` so equal values of two families
    (hair colour ``gray`` and eye colour ``gray``) never collide.
    """

    family: str
    column: str
    values: Sequence[object]
    labels: Mapping[object, str] = field(default_factory=dict)

    def label(self, value: object) -> str:
        return str(self.labels.get(value, value))

    def out_name(self, value: object) -> str:
        """``<family>__<label>``; labels equal up to case (``Grey``/``grey``)
        get their position appended, as Spark resolves names ignoring case."""
        name = column_name(self.family, self.label(value))
        clash = [v for v in self.values
                 if column_name(self.family, self.label(v)).lower() == name.lower()]
        if len(clash) > 1:
            name = f"{name}_{list(self.values).index(value)}"
        return name


def column_name(family: str, label: str) -> str:
    return f"{family}__{re.sub(r'[^0-9A-Za-z_]', '_', label)}"


def _count_value(col: Column, value: object) -> Column:
    # A cell without rows is null, not 0, as in a pivot.
    return F.nullif(F.count_if(col == F.lit(value)), F.lit(0))


def _known(traits: Sequence[Trait], column: str) -> list:
    """The values declared for a column, by any of the traits."""
    return list(dict.fromkeys(v for t in traits if t.column == column for v in t.values))


def _digit(columns: Sequence[str], traits: Sequence[Trait], column: str) -> tuple[int, int]:
    """A column's place value in the code, and its number of digits (0: no declared value)."""
    sizes = [len(_known(traits, c)) + 1 for c in columns]
    n = list(columns).index(column)
    return prod(sizes[:n]), sizes[n]


def _code(columns: Sequence[str], traits: Sequence[Trait]) -> Column | None:
    """One number for a row's declared values; None if there are too many for exact division."""
    scale, size = _digit(columns, traits, columns[-1])
    if scale * size >= 2 ** 31:
        return None
    parts = []
    for c in columns:
        first = F.coalesce(*[F.when(F.col(c) == F.lit(v), F.lit(n + 1))
                             for n, v in enumerate(_known(traits, c))], F.lit(0))
        parts.append(first * F.lit(_digit(columns, traits, c)[0]))
    return reduce(lambda a, b: a + b, parts).cast("int")


def trait_counts(reviews: DataFrame, key: str, traits: Sequence[Trait]) -> DataFrame:
    """Wide profile in one pass: ``key`` + one bigint column per trait value.

    Rows with a null key are excluded (the join chain drops them too); null
    trait values are counted nowhere, the product row stays.
    """
    rows = reviews.where(F.col(key).isNotNull())
    columns = list(dict.fromkeys(t.column for t in traits))
    code = _code(columns, traits)
    if code is None:
        return rows.groupBy(key).agg(*[_count_value(F.col(t.column), v).alias(t.out_name(v))
                                       for t in traits for v in t.values])
    # Counts by (key, code) are dealt by key: a key has one row per combination of its values
    # at most, so no key is hot, and a narrow one, not one with all the counts.
    coded = (rows.select(key, code.alias("_code")).groupBy(key, "_code").agg(F.count(F.lit(1)).alias("_n"))
             .repartition(F.col(key)))
    aggs = []
    for t in traits:
        scale, size = _digit(columns, traits, t.column)
        at = F.pmod(F.floor(F.col("_code") / scale), F.lit(size))
        known = _known(traits, t.column)
        aggs += [F.nullif(F.sum(F.when(at == known.index(v) + 1, F.col("_n")).otherwise(0)), F.lit(0)).alias(t.out_name(v))
                 for v in t.values]
    return coded.groupBy(key).agg(*aggs)


def merge_trait_counts(stored: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """A stored wide profile with that of a later batch: counts add up, 0 stays null."""
    if stored is None:
        return batch
    both = stored.select(batch.columns).unionByName(batch)
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in batch.columns if c != key])


def trait_pivot(reviews: DataFrame, key: str, column: str,
                values: Sequence[object]) -> DataFrame:
    """One pivot: ``key`` + one count column per declared value of ``column``.

    The values are part of the call, so the columns do not depend on the data
    and no job has to find them; other values and nulls are counted nowhere,
    the product row stays.
    """
    return reviews.groupBy(key).pivot(column, list(values)).count()


def profile_join_chain(reviews: DataFrame, key: str, traits: Sequence[Trait]) -> DataFrame:
    """The surveyed form: one pivot per trait, inner-joined on ``key``."""
    parts = []
    for t in traits:
        p = trait_pivot(reviews, key, t.column, t.values)
        parts.append(p.select(key, *[F.col(f"`{v}`").alias(t.out_name(v)) for v in t.values]))
    return reduce(lambda a, b: a.join(b, key, "inner"), parts)


def trait_long(profile: DataFrame, key: str, traits: Sequence[Trait],
               families: Sequence[str] | None = None) -> DataFrame:
    """Wide → long: ``(key, family, value, n)`` for every declared value.

    Zero cells stay as null ``n``, exactly as they are in the wide table.
    """
    chosen = [t for t in traits if families is None or t.family in families]
    stack = F.explode(F.array(*[
        F.struct(F.lit(t.family).alias("family"), F.lit(t.label(v)).alias("value"),
                 F.col(t.out_name(v)).cast("bigint").alias("n"))
        for t in chosen for v in t.values]))
    return profile.select(key, stack.alias("t")).select(key, "t.family", "t.value", "t.n")


def trait_share(long: DataFrame, key: str) -> DataFrame:
    """Adds ``share`` = n / sum(n) within (product, family), as a pie shows it."""
    w = Window.partitionBy(key, "family")
    return long.withColumn("share", F.col("n") / F.sum("n").over(w))


def ranked(rows: DataFrame, key: str, count: str, label: str) -> DataFrame:
    """Adds ``rank`` within ``key``: counts descending, nulls last, ties by label."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(count), F.asc(label))
    return rows.withColumn("rank", F.row_number().over(w))


def category_traits(long: DataFrame, products: DataFrame, key: str,
                    category: str, family_by_category: Mapping[str, str],
                    other_family: str) -> DataFrame:
    """Per product, the bars of the family its root category selects.

    Zero and null counts are dropped; ``rank`` orders bars by count desc
    (ties by value). ``products`` supplies ``key`` and ``category``.
    """
    m = F.create_map(*[x for k, v in family_by_category.items() for x in (F.lit(k), F.lit(v))])
    chosen = products.select(
        key, F.coalesce(F.element_at(m, F.col(category)), F.lit(other_family)).alias("family"))
    bars = long.where(F.col("n") > 0).join(chosen, [key, "family"], "inner")
    return ranked(bars, key, "n", "value")
