"""Crawled pages and API payloads → rows.

Pages, sitemaps and JSON payloads land as text columns (one file row per
fetched document); everything here is a column expression or an ``explode``,
so extraction runs where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake import schemas


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def attribute_values(html: Column | str, attr: str = "href") -> Column:
    """Array of every ``attr="…"`` value in the document, in order."""
    return F.regexp_extract_all(_c(html), F.lit(f'{attr}="([^"]*)"'), 1)


def tag_texts(xml: Column | str, tag: str = "loc") -> Column:
    """Array of the text of every ``<tag>…</tag>`` (a sitemap's URLs)."""
    return F.regexp_extract_all(_c(xml), F.lit(f"(?s)<{tag}>\\s*(.*?)\\s*</{tag}>"), 1)


def element_text(html: Column | str, tag: str = "script",
                 element_id: str | None = None) -> Column:
    """Text of the first ``<tag>`` (with ``id=element_id`` if given); null if
    the page has none."""
    attrs = f'[^>]*id="{element_id}"[^>]*' if element_id else "[^>]*"
    pattern = f"(?s)<{tag}{attrs}>(.*?)</{tag}>"
    return F.when(_c(html).rlike(pattern), F.regexp_extract(_c(html), pattern, 1))


def explode_links(pages: DataFrame, html: str = "html", attr: str = "href",
                  keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per link found in each page, with its position."""
    return pages.select(*keep, F.posexplode(attribute_values(html, attr))
                        .alias("pos", "link"))


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml",
                 contains: list[str] | None = None) -> DataFrame:
    """One row per ``<loc>`` URL; optionally only URLs containing any of
    ``contains`` (the crawler computed such a filter and dropped it)."""
    urls = sitemaps.select(F.explode(tag_texts(xml, "loc")).alias("url"))
    return urls_containing(urls, "url", contains) if contains else urls


def read_sitemap(spark, path: str, contains: list[str] | None = None) -> DataFrame:
    """Sitemap files → one row per ``<url>`` entry (``loc`` and, when present,
    ``lastmod``), with Spark's built-in XML source (``rowTag=url``); the files
    are split and parsed on the executors."""
    df = (spark.read.format("xml").option("rowTag", "url")
          .schema("loc string, lastmod string").load(path))
    urls = df.select(F.trim("loc").alias("url"), "lastmod").where(F.col("url").isNotNull())
    return urls_containing(urls, "url", contains) if contains else urls


def urls_containing(df: DataFrame, url: str, needles: list[str]) -> DataFrame:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.col(url).contains(n)
    return df.where(cond)


def url_parts(url: Column | str, levels: int = 3) -> list[Column]:
    """Host and the first ``levels`` path segments (null when missing)."""
    u = _c(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    cols = [F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1),
                     F.lit("")).alias("host")]
    for i in range(1, levels + 1):
        cols.append(F.nullif(F.split_part(path, F.lit("/"), F.lit(i + 1)), F.lit(""))
                    .alias(f"level{i}"))
    return cols


# --- review API payloads ---------------------------------------------------

REVIEW_FIELDS = {  # output column ← API result field
    "CID": "CID", "ProdID": "ProductId", "ContentLocale": "ContentLocale",
    "IsFeatured": "IsFeatured", "Rating": "Rating", "IsRecommended": "IsRecommended",
    "Date": "LastModeratedTime", "Title": "Title", "ReviewText": "ReviewText",
    "IsSyndicated": "IsSyndicated",
}


def parse_review_pages(payloads: DataFrame, body: str = "body",
                       url: str = "url") -> DataFrame:
    """Review API pages → one row per review.

    A page without ``Results`` yields no rows. Context attributes listed in
    ``ContextDataValuesOrder`` become the ``attributes`` map (their values),
    kept apart from the fixed fields so a key such as ``Rating`` cannot
    overwrite them. A key listed twice counts once; a date that cannot be
    read is null.
    """
    page = F.from_json(F.col(body), schemas.API_PAGE)
    results = F.coalesce(page.Results, F.array().cast(T.ArrayType(schemas.API_RESULT)))
    r = payloads.select(F.col(url).alias("url"), F.explode(results).alias("r"))
    order = F.array_distinct(F.array_compact(
        F.coalesce(F.col("r.ContextDataValuesOrder"), F.array().cast("array<string>"))))
    ctx = F.col("r.ContextDataValues")
    attrs = F.map_from_arrays(
        order, F.transform(order, lambda k: F.try_element_at(ctx, k).getField("Value")))
    fields = [F.col(f"r.{src}").alias(dst) for dst, src in REVIEW_FIELDS.items()]
    out = r.select(*fields, "url", attrs.alias("attributes"))
    return out.withColumn("Date", F.try_to_timestamp("Date"))


def attribute_columns(reviews: DataFrame, keys: list[str],
                      attrs: str = "attributes") -> DataFrame:
    """Context attributes → one column per requested key (null if absent)."""
    return reviews.select("*", *[F.element_at(F.col(attrs), F.lit(k)).alias(k) for k in keys])


def open_attributes(rows: DataFrame, payload: str) -> DataFrame:
    """One row per attribute of a JSON object, whatever its keys: the columns of ``rows`` with
    ``key`` and ``value`` (text). Nobody declares the keys: the payload is read as a VARIANT.

    A nested value is its JSON text, a JSON null is null; a payload that is no object
    gives no row.
    """
    v = F.try_parse_json(F.col(payload))
    held = rows.withColumn("_payload", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    each = held.sparkSession.tvf.variant_explode(F.col("_payload").outer())
    text = F.when(~F.is_variant_null("_value"), F.coalesce(
        F.try_variant_get("_value", "$", "string"), F.to_json(F.col("_value"))))
    return (held.lateralJoin(each.toDF("_pos", "_key", "_value"))
            .select(*rows.columns, F.col("_key").alias("key"), text.alias("value")))


def attribute_profile(rows: DataFrame, payload: str) -> DataFrame:
    """(key, value, n): how often each value of each attribute occurs."""
    return open_attributes(rows.select(payload), payload).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


# --- product pages ----------------------------------------------------------

def parse_product_pages(pages: DataFrame, html: str = "html",
                        element_id: str = "linkStore",
                        seen_at: Column | None = None) -> DataFrame:
    """Product pages → one offer row per SKU.

    The JSON tree sits in a script element. Child SKUs are used when the page
    lists them, else the single current SKU. Missing category levels are null
    (Category3 is the leaf, Category1 the root); product fields are copied to
    every SKU row. A page without the script, or without a SKU, gives no row.
    ``date`` is the first sighting and ``update`` the latest; both are
    ``seen_at`` here, and the price history keeps the earliest ``date``.
    """
    tree = F.from_json(element_text(html, "script", element_id), schemas.PRODUCT_PAGE)
    p = pages.select(tree.page.product.alias("p"))
    skus = F.coalesce(F.col("p.regularChildSkus"), F.array(F.col("p.currentSku")))
    d = F.col("p.productDetails")
    c3 = F.col("p.parentCategory")
    c2 = c3.getField("parentCategory")
    c1 = c2.getField("parentCategory")
    stamp = seen_at if seen_at is not None else F.current_timestamp()
    exploded = p.select("p", F.explode(skus).alias("sku")).where(F.col("sku.skuId").isNotNull())
    return exploded.select(
        F.col("sku.skuId").alias("skuId"), F.col("sku.listPrice").alias("listPrice"),
        F.col("sku.targetUrl").alias("targetUrl"), F.col("sku.skuImages").alias("skuImages"),
        F.col("sku.size").alias("size"),
        d.getField("displayName").alias("name"),
        d.getField("brand").getField("displayName").alias("brand"),
        d.getField("shortDescription").alias("shortDesc"),
        c1.getField("displayName").alias("Category1"),
        c2.getField("displayName").alias("Category2"),
        c3.getField("displayName").alias("Category3"),
        d.getField("lovesCount").alias("lovesCount"),
        d.getField("reviews").alias("reviews"),
        d.getField("rating").alias("rating"),
        stamp.alias("date"),
        stamp.alias("update"),
    )
