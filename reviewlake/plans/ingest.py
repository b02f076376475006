"""Queries: page extraction, JSON payloads, URLs, frontier, dedupe, price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import expr as X
from reviewlake.operators import ingest as ing
from reviewlake.plans import sql, standins
from reviewlake.plans.registry import query
from reviewlake.sources import pages as pg
from reviewlake.sources.tables import read_table
from reviewlake.streaming.jobs import scratch_paths
from reviewlake.streaming.stores import SeenIds

URL_ID_RE = r"/(\d+)(?:[?#]|$)"
SCRIPT_RE = "(?s)<script[^>]*>(.*?)</script>"


def _pages(spark: SparkSession, d: str, cols=("page_id", "url", "html")) -> DataFrame:
    return read_table(spark, d, "pages", list(cols))


@query("page_links", """
SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (
  SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS link
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))
""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every crawled page (a sitemap's ``<loc>`` list works alike)."""
    return pg.explode_links(_pages(spark, d, ("page_id", "html")))


@query("page_script", f"""
SELECT page_id, CASE WHEN regexp_matches(html, '{SCRIPT_RE}')
                     THEN regexp_extract(html, '{SCRIPT_RE}', 1) END AS script
FROM pages
""")
def page_script(spark: SparkSession, d: str) -> DataFrame:
    """Body of the first script element of each page (where the JSON tree sits)."""
    p = _pages(spark, d, ("page_id", "html"))
    return p.select("page_id", pg.element_text("html", "script").alias("script"))


@query("event_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(len(json_keys(props)) AS INTEGER) AS n_keys
FROM events
""")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON text → typed struct field and → map (dynamic keys)."""
    ev = read_table(spark, d, "events", ["event_id", "props"])
    m = F.from_json("props", "map<string,bigint>")
    return ev.select("event_id",
                     F.from_json("props", "struct<k:bigint>").getField("k").alias("k"),
                     F.size(m).alias("n_keys"))


@query("attr_columns", """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract(props, '$.missing') AS BIGINT) AS missing
FROM events
""")
def attr_columns(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic attribute map → one column per requested key (null if absent)."""
    ev = read_table(spark, d, "events", ["event_id", "user_id", "props"])
    ev = ev.select("event_id", "user_id",
                   F.from_json("props", "map<string,bigint>").alias("attributes"))
    return pg.attribute_columns(ev, ["k", "missing"]).drop("attributes")


@query("attr_variant", """
SELECT key, json_extract_string(props, '$."' || key || '"') AS value, count(*) AS n
FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL
""")
def attr_variant(spark: SparkSession, d: str) -> DataFrame:
    """Values of every attribute that events carry; no key is declared."""
    return pg.attribute_profile(read_table(spark, d, "events", ["props"]), "props")


@query("url_id", """
SELECT page_id, split_part(string_split(url, '/')[-1], '?', 1) AS prod_id FROM pages
""")
def url_id(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, ("page_id", "url"))
    return p.select("page_id", X.product_id_from_url("url", "/").alias("prod_id"))


@query("url_regex_id", f"""
SELECT page_id, nullif(regexp_extract(url, '{URL_ID_RE}', 1), '') AS prod_id FROM pages
""")
def url_regex_id(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, ("page_id", "url"))
    return p.select("page_id", X.product_id_from_api_url("url", URL_ID_RE).alias("prod_id"))


@query("url_strip_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def url_strip_query(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, ("page_id", "url"))
    return p.select("page_id", X.strip_query("url").alias("url"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', ',', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, ("page_id", "html"))
    return p.select("page_id", X.strip_tags("html").alias("text"))


@query("url_contains", """
SELECT page_id, url FROM pages WHERE contains(url, '/en/') OR contains(url, '.net/')
""")
def url_contains(spark: SparkSession, d: str) -> DataFrame:
    return pg.urls_containing(_pages(spark, d, ("page_id", "url")), "url", ["/en/", ".net/"])


@query("url_path_levels", """
WITH u AS (SELECT page_id,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path
       FROM pages)
SELECT page_id, nullif(host, '') AS host, nullif(split_part(path, '/', 2), '') AS level1,
       nullif(split_part(path, '/', 3), '') AS level2,
       nullif(split_part(path, '/', 4), '') AS level3
FROM u
""")
def url_path_levels(spark: SparkSession, d: str) -> DataFrame:
    """Host and path levels of each URL; missing levels are null."""
    p = _pages(spark, d, ("page_id", "url"))
    return p.select("page_id", *pg.url_parts("url", 3))


PAGE = standins.STANDIN_PAGE_SIZE
REQUEST_FMT = ("https://api.example.com/data/reviews.json?Filter=contentlocale%%3Aen*"
               "&Filter=ProductId%%3A%s&Sort=SubmissionTime%%3Adesc"
               f"&Limit={PAGE}&offset=%d")
PAGE_PLAN_SQL = f"""
WITH pr AS (SELECT DISTINCT split_part(string_split(targetUrl, '-')[-1], '?', 1) AS prod_id,
                   reviews FROM ({sql.OFFERS})),
     p AS (SELECT prod_id, reviews, unnest(range(0, reviews - reviews % {PAGE}, {PAGE})) AS "offset"
           FROM pr),
     dp AS (SELECT prod_id, CAST("offset" AS INTEGER) AS "offset", max(reviews) AS priority
            FROM p GROUP BY ALL)
SELECT prod_id, "offset", priority, printf('{REQUEST_FMT}', prod_id, "offset") AS request_url FROM dp
"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return ing.page_plan(standins.offers(spark, d), page_size=PAGE)


query("page_plan", PAGE_PLAN_SQL)(_plan)


@query("frontier", f"""
WITH plan AS ({PAGE_PLAN_SQL}),
fetched AS (SELECT DISTINCT nullif(regexp_extract(url, 'ProductId%3A(\\w+)', 1), '') AS prod_id,
                   TRY_CAST(regexp_extract(url, '[?&]offset=(\\d+)', 1) AS INTEGER) AS "offset"
            FROM ({sql.REVIEW_PAGES}))
SELECT * FROM plan
WHERE NOT EXISTS (SELECT 1 FROM fetched f
                  WHERE f.prod_id = plan.prod_id AND f."offset" = plan."offset")
""")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages planned from the offers that no stored review came from."""
    fetched = ing.fetched_pages(standins.review_pages(spark, d))
    return ing.frontier(_plan(spark, d), fetched)


@query("frontier_ranges", f"""
WITH missing AS (
  SELECT prod_id, "offset", priority FROM ({PAGE_PLAN_SQL}) plan
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(regexp_extract(url, 'ProductId%3A(\\w+)', 1), '') AS prod_id,
                                          TRY_CAST(regexp_extract(url, '[?&]offset=(\\d+)', 1) AS INTEGER) AS "offset"
                                   FROM ({sql.REVIEW_PAGES})) f
                    WHERE f.prod_id = plan.prod_id AND f."offset" = plan."offset")),
top AS (SELECT prod_id, max(priority) AS priority FROM ({PAGE_PLAN_SQL}) GROUP BY ALL),
islands AS (
  SELECT prod_id, "offset", "offset" // {PAGE} - row_number() OVER (PARTITION BY prod_id ORDER BY "offset") AS island
  FROM missing)
SELECT i.prod_id, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS n_pages,
       any_value(t.priority) AS priority
FROM islands i JOIN top t USING (prod_id) GROUP BY i.prod_id, island
""")
def frontier_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Missing pages of each product as ranges."""
    fetched = ing.fetched_pages(standins.review_pages(spark, d))
    return ing.frontier_ranges(standins.offers(spark, d), fetched, page_size=PAGE)


INGEST_DEDUPE_SQL = """
SELECT review_id, obs_id, ts, sku_id, price, attrs FROM (
  SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS review_id, event_id AS obs_id, ts,
         user_id AS sku_id, event_type AS price, value AS attrs,
         row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) || ':' || event_type
                            ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1
"""


@query("ingest_dedupe", INGEST_DEDUPE_SQL)
def ingest_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First arrival per review id; later copies are not inserted."""
    return ing.first_seen(_arrivals(spark, d), "review_id", ["ts", "obs_id"])


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    obs = standins.price_observations(spark, d)
    return obs.select(F.concat_ws(":", F.col("sku_id").cast("string"), "price")
                      .alias("review_id"), "obs_id", "ts", "sku_id", "price", "attrs")


# The moment that separates what is stored from the batch in the merge queries.
STORED_UNTIL = "2024-01-16 00:00:00"


@query("insert_unseen", INGEST_DEDUPE_SQL)
def insert_unseen(spark: SparkSession, d: str) -> DataFrame:
    """A stored table and the rows of a later batch that it lacks: together the
    one-shot result."""
    rows, cut = _arrivals(spark, d), F.lit(STORED_UNTIL).cast("timestamp_ntz")
    stored = ing.first_seen(rows.where(F.col("ts") < cut), "review_id", ["ts", "obs_id"])
    batch = rows.where(F.col("ts") >= cut)
    return stored.unionByName(ing.insert_unseen(stored, batch, "review_id", ["ts", "obs_id"]))


BATCH_CUTS = ("2024-01-08", STORED_UNTIL, "2024-01-24 12:00:00")


@query("insert_unseen_bucketed", INGEST_DEDUPE_SQL)
def insert_unseen_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Four batches inserted into a store whose ids lie in buckets that a batch joins in
    place: the one-shot result."""
    rows, (out, ids) = _arrivals(spark, d), scratch_paths(spark, "seen_ids")
    seen = SeenIds(spark, ids, out, buckets=16)
    for n, batch in enumerate(standins.in_batches(rows, "ts", BATCH_CUTS)):
        seen.insert(batch, n, "review_id", ["ts", "obs_id"])
    return seen.rows(rows.schema)


PRICE_HISTORY_SQL = """
SELECT user_id AS sku_id, event_type AS price, min(ts) AS first_seen, max(ts) AS last_seen,
       count(*) AS n_obs, max({'t': ts, 'b': event_id, 'a': value}).a AS attrs
FROM events GROUP BY ALL
"""


@query("price_history", PRICE_HISTORY_SQL)
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return ing.price_history(standins.price_observations(spark, d))


@query("merge_price_history", PRICE_HISTORY_SQL)
def merge_price_history(spark: SparkSession, d: str) -> DataFrame:
    """A stored history updated with a later batch: the one-shot result."""
    obs, cut = standins.price_observations(spark, d), F.lit(STORED_UNTIL).cast("timestamp_ntz")
    stored = ing.price_history(obs.where(F.col("ts") < cut))
    return ing.merge_price_history(stored, obs.where(F.col("ts") >= cut))


@query("latest_offer", """
SELECT obs_id, ts, sku_id, price, attrs FROM (
  SELECT event_id AS obs_id, ts, user_id AS sku_id, event_type AS price, value AS attrs,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def latest_offer(spark: SparkSession, d: str) -> DataFrame:
    """Latest observation per SKU."""
    obs = standins.price_observations(spark, d).drop("props")
    return ing.latest_record(obs, "sku_id", "ts", "obs_id")


# One observation per step and SKU; a price on the list rewrites the newest record,
# any other adds one; a record's last version is the one before the next number.
COMPAT_SQL = """
WITH RECURSIVE o AS (
  SELECT user_id AS sku_id, event_type AS price, ts, value AS attrs,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
  SELECT sku_id, i, price, ts AS first_seen, ts AS updated, attrs, 1 AS rec,
         CAST([] AS VARCHAR[]) AS older FROM o WHERE i = 1
  UNION ALL
  SELECT o.sku_id, o.i, o.price,
         CASE WHEN o.price = f.price OR list_contains(f.older, o.price) THEN f.first_seen ELSE o.ts END,
         o.ts, o.attrs,
         CASE WHEN o.price = f.price OR list_contains(f.older, o.price) THEN f.rec ELSE f.rec + 1 END,
         CASE WHEN o.price = f.price OR list_contains(f.older, o.price) THEN f.older
              ELSE list_append(f.older, f.price) END
  FROM f JOIN o ON o.sku_id = f.sku_id AND o.i = f.i + 1)
SELECT sku_id, max_by(price, i) AS price, max_by(first_seen, i) AS first_seen,
       max(updated) AS updated, max_by(attrs, i) AS attrs
FROM f GROUP BY sku_id, rec
"""


@query("price_history_compat", COMPAT_SQL)
def price_history_compat(spark: SparkSession, d: str) -> DataFrame:
    """Exact store-upsert fold per SKU."""
    return ing.price_history_compat(standins.price_observations(spark, d))


@query("keep_last", """
SELECT obs_id, ts, sku_id, price, attrs FROM (
  SELECT event_id AS obs_id, ts, user_id AS sku_id, event_type AS price, value AS attrs,
         row_number() OVER (PARTITION BY user_id
                            ORDER BY event_type DESC, value DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Per SKU the row that sorts last on (price, attrs, id): keep-last dedupe."""
    obs = standins.price_observations(spark, d).drop("props")
    return ing.keep_last(obs, "sku_id", ["price", "attrs", "obs_id"])


def _product_pages(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages as product pages: the JSON tree in a script element. Pages of
    odd id list two child SKUs, every tenth page has no script, every seventh no
    category above the leaf."""
    p = _pages(spark, d, ("page_id", "url"))
    pid = F.col("page_id").cast("string")

    def sku(suffix: str):
        return F.struct(F.concat(pid, F.lit(suffix)).alias("skuId"), F.lit("$1.00").alias("listPrice"),
                        F.col("url").alias("targetUrl"))

    host, level1, level2, level3 = pg.url_parts("url", 3)
    top = F.struct(host.alias("displayName"))
    middle = F.struct(level1.alias("displayName"),
                      F.when(F.col("page_id") % 7 != 0, top).alias("parentCategory"))
    product = F.struct(
        F.when(F.col("page_id") % 2 == 1, F.array(sku("-a"), sku("-b"))).alias("regularChildSkus"),
        sku("").alias("currentSku"),
        F.struct(F.col("url").alias("displayName"), F.length("url").cast("bigint").alias("reviews"))
        .alias("productDetails"),
        F.struct(level2.alias("displayName"), middle.alias("parentCategory")).alias("parentCategory"))
    tree = F.to_json(F.struct(F.struct(product.alias("product")).alias("page")))
    return p.select("page_id", F.when(F.col("page_id") % 10 != 0, F.concat(
        F.lit('<html><script id="linkStore" type="text/json">'), tree, F.lit("</script></html>")))
        .otherwise(F.lit("<html></html>")).alias("html"))


@query("nested_project", """
WITH u AS (SELECT page_id, url,
       nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path
       FROM pages WHERE page_id % 10 <> 0),
s AS (SELECT *, unnest(CASE WHEN page_id % 2 = 1 THEN ['-a', '-b'] ELSE [''] END) AS suffix FROM u)
SELECT CAST(page_id AS VARCHAR) || suffix AS skuId, '$1.00' AS listPrice, url AS targetUrl,
       url AS name, CAST(length(url) AS BIGINT) AS reviews,
       CASE WHEN page_id % 7 <> 0 THEN host END AS Category1,
       nullif(split_part(path, '/', 2), '') AS Category2,
       nullif(split_part(path, '/', 3), '') AS Category3
FROM s
""")
def nested_project(spark: SparkSession, d: str) -> DataFrame:
    """Product tree of a page → one offer row per SKU."""
    return pg.parse_product_pages(_product_pages(spark, d)).select(
        "skuId", "listPrice", "targetUrl", "name", "reviews", "Category1", "Category2", "Category3")
