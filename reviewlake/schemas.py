"""Declared schemas of the domain tables and payloads (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I, TS = (T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                     T.IntegerType(), T.TimestampType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# One offer observation per SKU, as landed by the product crawler.
OFFER = _struct(
    ("skuId", S), ("listPrice", S), ("targetUrl", S),
    ("skuImages", _struct(("imageUrl", S))), ("size", S), ("name", S),
    ("brand", S), ("shortDesc", S), ("Category1", S), ("Category2", S),
    ("Category3", S), ("lovesCount", L), ("reviews", L), ("rating", D),
    ("date", TS), ("update", TS),
)

# One review, flattened from the review API (context attributes as a map).
REVIEW = _struct(
    ("CID", S), ("ProdID", S), ("ContentLocale", S), ("IsFeatured", B),
    ("Rating", I), ("IsRecommended", B), ("Date", TS), ("Title", S),
    ("ReviewText", S), ("IsSyndicated", B), ("url", S),
    ("attributes", T.MapType(S, S)),
)

# Catalogue: one row per product.
CATALOG = _struct(
    ("prod_id", S), ("name", S), ("short_desc", S), ("brand", S),
    ("category1", S), ("category2", S), ("category3", S), ("size", S),
    ("sku_image", S), ("reviews", L), ("variant", L), ("rating", D),
    ("price", D), ("loves_count", L),
)

# Review API page payload.
API_RESULT = _struct(
    ("CID", S), ("ProductId", S), ("ContentLocale", S), ("IsFeatured", B),
    ("Rating", I), ("IsRecommended", B), ("LastModeratedTime", S), ("Title", S),
    ("ReviewText", S), ("IsSyndicated", B),
    ("ContextDataValuesOrder", T.ArrayType(S)),
    ("ContextDataValues", T.MapType(S, _struct(("Value", S)))),
)
API_PAGE = _struct(("Results", T.ArrayType(API_RESULT)))

# Product page JSON (the part of the tree the crawler reads).
SKU = _struct(("skuId", S), ("listPrice", S), ("size", S),
              ("skuImages", _struct(("imageUrl", S))), ("targetUrl", S))
_CAT3 = _struct(("displayName", S))
_CAT2 = _struct(("displayName", S), ("parentCategory", _CAT3))
_CAT1 = _struct(("displayName", S), ("parentCategory", _CAT2))
_PRODUCT = _struct(
    ("regularChildSkus", T.ArrayType(SKU)),
    ("currentSku", SKU),
    ("productDetails", _struct(
        ("displayName", S), ("shortDescription", S),
        ("brand", _struct(("displayName", S))),
        ("lovesCount", L), ("rating", D), ("reviews", L))),
    ("parentCategory", _CAT1),
)
PRODUCT_PAGE = _struct(("page", _struct(("product", _PRODUCT))))
