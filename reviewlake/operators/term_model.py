"""Sentiment by a table of term weights: scoring is a join and a sum.

The model is a table (term, weight) and an intercept; a review's margin is the
intercept plus the weights of its tokens, its class is 1 above 0. The table may be
that of the fitted regression (``regression_table``: every term's weight under its
hashed feature, so margins equal the pipeline's) or log-odds of the labelled reviews'
tokens (``log_odds_table``), which plain SQL gives as well.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import counted, sentiment_tokens
from reviewlake.operators.sentiment import SENTIMENT, with_text
from reviewlake.operators.tfidf import materialize
from reviewlake.operators.traits import trait_counts


def token_counts(reviews: DataFrame, keys: list[str], text: str = "ReviewText") -> DataFrame:
    """(keys, term, tf) of the reviews that have text."""
    tokens = with_text(reviews, text).select(*keys, F.explode(sentiment_tokens(text)).alias("term"))
    return tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def regression_table(model: PipelineModel, terms: DataFrame) -> tuple[DataFrame, float]:
    """(term, weight) of the fitted pipeline for the given terms, and its intercept.

    Each term is hashed and idf-weighted by the pipeline's own stages; its weight is the
    coefficient of its feature times that feature's idf, so terms that share a hash bucket
    share a weight, as in the pipeline.
    """
    _, hashing, idf, lr = model.stages
    one = idf.transform(hashing.transform(terms.select("term").distinct()
                                          .withColumn(hashing.getInputCol(), F.array("term"))))
    coefficients = lr.coefficients.toArray()
    dot = F.expr("aggregate(zip_with(_f, _c, (x, y) -> x * y), 0D, (a, x) -> a + x)")
    table = (one.withColumn("_f", vector_to_array(idf.getOutputCol()))
             .withColumn("_c", F.lit(coefficients.tolist())).select("term", dot.alias("weight")))
    return table, float(lr.intercept)


def log_odds_table(labelled: DataFrame, text: str = "ReviewText", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(term, weight): smoothed log-odds of a token in reviews of class 1 against class 0;
    and the one-row table of the intercept, the log-odds of the classes."""
    # Written: the texts are read once, not for each of the sums and for the weights.
    tokens = materialize(token_counts(labelled, [label], text).groupBy("term").agg(
        F.sum(F.when(F.col(label) == 1, F.col("tf")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col(label) == 0, F.col("tf")).otherwise(0)).alias("n0")))
    sizes = tokens.agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"), F.count(F.lit(1)).alias("v"))
    s1, s0, v = (sizes.select(c).scalar() for c in ("s1", "s0", "v"))
    weight = F.log((F.col("n1") + 1) / (s1 + v)) - F.log((F.col("n0") + 1) / (s0 + v))
    classes = with_text(labelled, text).agg(
        F.log((F.count_if(F.col(label) == 1) + 1) / (F.count_if(F.col(label) == 0) + 1)).alias("intercept"))
    return tokens.select("term", weight.alias("weight")), classes


def score_by_table(reviews: DataFrame, weights: DataFrame, intercept, key: str = "ProdID",
                   review_id: str = "review_id", text: str = "ReviewText", digits: int = 6) -> DataFrame:
    """(review_id, key, margin, prediction) of every review with text; margins are rounded, so
    that a class does not hang on the order of a sum. ``intercept``: a number or a scalar column.

    Tokens meet the table by a join on the term; the table has one row per term, so only
    the tokens' side can be skewed, which AQE splits. Tokens are counted in their review's row.
    """
    tf = with_text(reviews, text).select(review_id, F.inline(counted(sentiment_tokens(text))))
    sums = tf.join(weights, "term").groupBy(review_id).agg(F.sum(F.col("tf") * F.col("weight")).alias("s"))
    base = F.lit(intercept) if isinstance(intercept, (int, float)) else intercept
    scored = (with_text(reviews, text).select(review_id, key).join(sums, review_id, "left")
              .withColumn("margin", F.round(base + F.coalesce("s", F.lit(0.0)), digits)))
    return scored.select(review_id, key, "margin", F.when(F.col("margin") > 0, 1.0).otherwise(0.0).alias("prediction"))


def class_counts(scored: DataFrame, key: str = "ProdID") -> DataFrame:
    """Per product: reviews of either class, as ``sentiment.sentiment_counts`` gives them."""
    return trait_counts(scored, key, [SENTIMENT])
