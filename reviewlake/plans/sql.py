"""DuckDB twins of the stand-in tables (see ``plans.standins``).

Plain SQL text, used only by the oracle check: each is a SELECT that can be
placed in a WITH clause.
"""

from __future__ import annotations

from collections.abc import Sequence

from reviewlake.operators.traits import Trait

OFFERS = """
SELECT CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS skuId,
       '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS listPrice,
       '/product/' || replace(p_name, ' ', '-') || '-P' || CAST(p_partkey AS VARCHAR)
         || '?skuId=' || CAST(l_suppkey AS VARCHAR) AS targetUrl,
       '/images/s' || CAST(l_suppkey AS VARCHAR) || '.jpg?pid='
         || CAST(l_linenumber AS VARCHAR) AS imageUrl,
       CAST(p_size AS VARCHAR) AS size, p_name AS name, p_brand AS brand,
       '<p><b>' || p_type || '</b> ' || p_name || '</p>' AS shortDesc,
       p_type AS Category1, split_part(p_name, ' ', 1) AS Category2,
       string_split(p_name, ' ')[-1] AS Category3,
       CAST(round(l_tax * 100) AS BIGINT) AS lovesCount,
       CAST(l_quantity AS BIGINT) AS reviews, l_discount AS rating,
       l_shipdate AS date, l_shipdate AS update
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# Offers with parsed keys (the catalogue's input).
NORMALIZED_OFFERS = f"""
SELECT split_part(string_split(targetUrl, '-')[-1], '?', 1) AS prod_id, name,
       regexp_replace(shortDesc, '<[^>]*>', ',', 'g') AS short_desc, brand,
       Category1 AS category1, Category2 AS category2, Category3 AS category3, size,
       split_part(imageUrl, '?', 1) AS sku_image, reviews, rating,
       TRY_CAST(replace(listPrice, '$', '') AS DOUBLE) AS price,
       lovesCount AS loves_count
FROM ({OFFERS})
"""

CATALOG_ROLLUP = f"""
SELECT prod_id, name, short_desc, brand, category1, category2, category3, size,
       sku_image, max(reviews) AS reviews, count(*) AS variant, max(rating) AS rating,
       max(price) AS price, max(loves_count) AS loves_count
FROM ({NORMALIZED_OFFERS})
WHERE prod_id IS NOT NULL AND name IS NOT NULL AND short_desc IS NOT NULL
  AND brand IS NOT NULL AND category1 IS NOT NULL AND category2 IS NOT NULL
  AND category3 IS NOT NULL AND size IS NOT NULL AND sku_image IS NOT NULL
GROUP BY ALL
"""

CATALOG = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY prod_id ORDER BY name DESC, short_desc DESC,
           brand DESC, category1 DESC, category2 DESC, category3 DESC, size DESC,
           sku_image DESC) AS rn
  FROM ({CATALOG_ROLLUP})) WHERE rn = 1
"""

REVIEWS = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS CID,
       'P' || CAST(l_partkey AS VARCHAR) AS ProdID,
       'https://api.example.com/data/reviews.json?Filter=ProductId%3AP'
         || CAST(l_partkey AS VARCHAR) || '&Limit=10&offset='
         || CAST((l_linenumber - 1) * 10 AS VARCHAR) AS url,
       CAST(ceil(l_quantity / 10) AS INTEGER) AS Rating,
       n_name AS ContentLocale, l_shipdate AS Date,
       l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, c_mktsegment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
"""

REVIEW_PAGES = """
SELECT 'https://api.example.com/data/reviews.json?Filter=ProductId%3AP'
         || CAST(l_partkey AS VARCHAR) || '&Limit=10&offset='
         || CAST((l_linenumber - 1) * 10 AS VARCHAR) AS url
FROM lineitem
"""

REVIEW_TEXTS = """
SELECT d.doc_id AS review_id, d.source AS ProdID, d.text AS ReviewText,
       CAST(CASE WHEN l.quality = 1 THEN 5 WHEN l.quality = 0 THEN 1 END AS INTEGER) AS Rating
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def sql_literal(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def trait_count_columns(traits: Sequence[Trait]) -> str:
    """``nullif(count(*) FILTER (…), 0) AS family__value`` for every value."""
    return ",\n       ".join(
        f"nullif(count(*) FILTER (WHERE {t.column} = {sql_literal(v)}), 0) AS {t.out_name(v)}"
        for t in traits for v in t.values)


def trait_long_rows(traits: Sequence[Trait], source: str, key: str) -> str:
    """UNION ALL of ``(key, family, value, n)`` rows from a wide profile."""
    return "\nUNION ALL\n".join(
        f"SELECT {key}, '{t.family}' AS family, {sql_literal(t.label(v))} AS value, "
        f"{t.out_name(v)} AS n FROM {source}"
        for t in traits for v in t.values)


def mean_half_even(col: str, digits: int = 2) -> str:
    """Exact mean rounded half-even, in integer arithmetic (DuckDB's decimal
    division returns a double). Non-negative inputs."""
    scaled = f"CAST(CAST({col} AS DECIMAL(30,10)) * 10000000000 AS HUGEINT)"
    s = f"sum({scaled})"
    d = f"(count({col}) * CAST({10 ** (10 - digits)} AS HUGEINT))"
    q = f"({s} // {d})"
    r = f"({s} - {q} * {d})"
    return (f"CAST(({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} "
            f"THEN {q} % 2 ELSE 0 END) AS DOUBLE) / {10 ** digits}")
