"""The per-product audience profile of real review data.

Review traits come from fixed fields (locale, featured, recommended,
syndicated) and from the context-attribute map (age, eye colour, …). The
whole profile is one aggregate over the reviews (``traits.trait_counts``),
then one join to the sentiment counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as K
from reviewlake.functions.expr import product_id_from_api_url
from reviewlake.operators.traits import Trait, trait_counts

REVIEW_TRAITS = [
    Trait("age", "age", K.AGE_VALUES),
    Trait("country", "ContentLocale", K.COUNTRY_VALUES),
    Trait("featured", "IsFeatured", [False, True],
          {False: K.FEATURED_LABELS["false"], True: K.FEATURED_LABELS["true"]}),
    Trait("recommended", "IsRecommended", [False, True],
          {False: K.RECOMMENDED_LABELS["false"], True: K.RECOMMENDED_LABELS["true"]}),
    Trait("syndicated", "IsSyndicated", [False, True],
          {False: K.SYNDICATED_LABELS["false"], True: K.SYNDICATED_LABELS["true"]}),
    Trait("eye", "eyeColor", K.EYE_COLOR_VALUES),
    Trait("hair_color", "hairColor", K.HAIR_COLOR_VALUES),
    Trait("hair_condition", "hairCondition", K.HAIR_CONDITION_VALUES),
    Trait("skin_tone", "skinTone", K.SKIN_TONE_VALUES),
    Trait("skin_type", "skinType", K.SKIN_TYPE_VALUES),
]


def review_facts(reviews: DataFrame, id_from_url: bool = True) -> DataFrame:
    """Reviews with ``prod_id`` (from the API URL when asked) and the
    context attributes as columns."""
    pid = product_id_from_api_url("url") if id_from_url else F.col("ProdID")
    attrs = F.col("attributes")
    return reviews.select(
        pid.alias("prod_id"), "CID", "ContentLocale", "IsFeatured", "IsRecommended",
        "IsSyndicated",
        "Rating", "ReviewText",
        *[F.element_at(attrs, F.lit(k)).alias(k) for k in K.ATTRIBUTE_KEYS])


def review_profile(reviews: DataFrame, sentiment: DataFrame | None = None,
                   how: str = "inner", id_from_url: bool = True) -> DataFrame:
    """One row per product: a count column per declared trait value, joined to
    the sentiment counts (``inner`` drops products without scored text, as
    the surveyed job did; ``left`` keeps them)."""
    prof = trait_counts(review_facts(reviews, id_from_url), "prod_id", REVIEW_TRAITS)
    if sentiment is None:
        return prof
    return prof.join(sentiment, "prod_id", how)
