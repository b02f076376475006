"""Review sentiment: a bag-of-words logistic regression trained on extreme
ratings (1 → negative, 5 → positive), then applied to every review with text.

Spark ML end to end: ``Tokenizer`` → ``HashingTF`` → ``IDF`` →
``LogisticRegression``; class counts per product are a conditional aggregate
with both classes declared, so a model that predicts one class still yields
both columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.constants import (HASHED_FEATURES, HIGH_RATING, LOGREG_MAX_ITER, LOW_RATING,
                                  SENTIMENT_LABELS, SPLIT_SEED, TRAIN_FRACTION,
                                  TRAIN_ROW_CAP)
from reviewlake.operators.tfidf import materialize
from reviewlake.operators.traits import Trait, trait_counts

SENTIMENT = Trait("sentiment", "prediction", [0.0, 1.0], SENTIMENT_LABELS)


def with_text(reviews: DataFrame, text: str = "ReviewText") -> DataFrame:
    """Reviews that have text (the tokenizer cannot take null)."""
    return reviews.na.drop(subset=[text])


def extreme_ratings(reviews: DataFrame, rating: str = "Rating") -> DataFrame:
    return reviews.where(F.col(rating).isin(LOW_RATING, HIGH_RATING))


def rating_label(rating: str = "Rating"):
    """5 → 1, 1 → 0, anything else → null."""
    return (F.when(F.col(rating) == HIGH_RATING, F.lit(1))
             .when(F.col(rating) == LOW_RATING, F.lit(0)))


def training_set(reviews: DataFrame, key: str = "ProdID", review_id: str = "review_id",
                 text: str = "ReviewText", rating: str = "Rating",
                 cap: int | None = TRAIN_ROW_CAP, sample: bool = False) -> DataFrame:
    """Labelled training rows: text present, rating 1 or 5, at most ``cap`` rows.

    The rows are the first in (product, review id) order, or with ``sample``
    those with the lowest id hash, which favours no product; both orders are
    total. They are chosen without their text, which then joins the chosen ids.
    """
    t = extreme_ratings(with_text(reviews, text), rating)
    t = t.select(key, review_id, text, rating_label(rating).alias("label"))
    if cap is None:
        return t
    order = [F.col(key), F.col(review_id)]
    if sample:
        integral = dict(t.dtypes)[review_id] in ("bigint", "int", "smallint", "tinyint")
        order = [hash_fraction(review_id, integral), F.col(review_id), F.col(key)]
    chosen = t.select(key, review_id).orderBy(*order).limit(cap)
    return t.join(chosen, [key, review_id], "left_semi")


def hash_fraction(review_id: str = "review_id", integral: bool = True):
    """A fixed number in [0, 1) per id. Integer ids: multiplicative hashing in
    integer arithmetic (no overflow), identical on every engine; other ids
    (review ids are often strings) go through ``xxhash64`` first."""
    c = F.col(review_id)
    x = F.pmod(c.cast("bigint") if integral else F.xxhash64(c), F.lit(2 ** 31))
    return F.pmod(x * F.lit(2654435761), F.lit(2 ** 32)) / F.lit(float(2 ** 32))


def split(df: DataFrame, review_id: str = "review_id", fraction: float = TRAIN_FRACTION,
          seed: int = SPLIT_SEED, by_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train/test split. ``randomSplit`` with the fixed seed by default; the
    hash form depends on the id alone, so it is stable under any
    repartitioning, retry or re-run."""
    if not by_hash:
        a, b = df.randomSplit([fraction, 1 - fraction], seed=seed)
        return a, b
    integral = dict(df.dtypes)[review_id] in ("bigint", "int", "smallint", "tinyint")
    u = hash_fraction(review_id, integral)
    return df.where(u < fraction), df.where(u >= fraction)


def pipeline(text: str = "ReviewText", features: int = HASHED_FEATURES,
             max_iter: int = LOGREG_MAX_ITER) -> Pipeline:
    tok = Tokenizer(inputCol=text, outputCol="words")
    tf = HashingTF(inputCol="words", outputCol="raw_features", numFeatures=features)
    idf = IDF(inputCol="raw_features", outputCol="features")
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr])


@dataclass
class SentimentModel:
    model: PipelineModel
    auc: float | None


def fit(train_rows: DataFrame, text: str = "ReviewText", review_id: str = "review_id",
        by_hash_split: bool = False, evaluate: bool = True) -> SentimentModel:
    """Fit on the training share, report AUC on the held-out share.

    The training rows feed the split, the IDF fit and the regression passes;
    they are written once to the checkpoint folder first.
    """
    train, test = split(materialize(train_rows), review_id, by_hash=by_hash_split)
    model = pipeline(text).fit(train)
    auc = exact_auc(held_out_scores(model, test)).first()["auc"] if evaluate else None
    return SentimentModel(model, auc)


def held_out_scores(model: PipelineModel, test: DataFrame) -> DataFrame:
    """(score, label) of held-out rows; the score is the probability of class 1."""
    return model.transform(test).select(vector_to_array("probability")[1].alias("score"), "label")


def predict(model: PipelineModel, reviews: DataFrame, key: str = "ProdID",
            text: str = "ReviewText") -> DataFrame:
    return model.transform(with_text(reviews, text).select(key, text))


def sentiment_counts(predictions: DataFrame, key: str = "ProdID") -> DataFrame:
    """Per product: reviews predicted negative / positive (null when none)."""
    return trait_counts(predictions, key, [SENTIMENT])


def hashed_features(df: DataFrame, text: str = "ReviewText",
                    features: int = HASHED_FEATURES) -> DataFrame:
    """Token, non-zero feature and total counts of the hashed term vectors."""
    tok = Tokenizer(inputCol=text, outputCol="words").transform(with_text(df, text))
    v = HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(tok)
    arr = vector_to_array("tf")
    return v.select("*", F.size("words").alias("n_tokens"),
                    F.size(F.filter(arr, lambda x: x != 0)).alias("n_features"),
                    F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("tf_sum"))


def exact_auc(scored: DataFrame, score: str = "score", label: str = "label",
              buckets: int = 1024) -> DataFrame:
    """Exact ROC AUC (rank-sum, ties count one half) as a one-row DataFrame.

    Distinct scores are aggregated first; the running count of negatives
    below each score is a prefix sum done in two levels — within range
    buckets of scores, plus the totals of the lower buckets — so no task has
    to sort all scores. Bucket bounds are ``buckets`` approximate quantiles;
    only the bucket sizes depend on them, never the result. Without both
    classes the AUC is null.
    """
    per = materialize(scored.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    qs = [i / buckets for i in range(1, buckets)]
    # ``buckets - 1`` numbers reach the driver, whatever the data size.
    row = per.agg(F.percentile_approx(F.col("s").cast("double"), qs, 10_000).alias("b")).first()
    edges = sorted(set(row["b"] or []))
    arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    b = per.withColumn("bucket", F.size(F.filter(arr, lambda x: x < F.col("s"))))
    w_in = (Window.partitionBy("bucket").orderBy("s")
            .rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("below_in", F.coalesce(F.sum("neg").over(w_in), F.lit(0)))
    tot = b.groupBy("bucket").agg(F.sum("neg").alias("bneg"))
    w_b = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("below_b", F.coalesce(F.sum("bneg").over(w_b), F.lit(0))).drop("bneg")
    j = b.join(F.broadcast(tot), "bucket")
    num = F.sum(F.col("pos") * (F.col("below_in") + F.col("below_b"))
                + F.lit(0.5) * F.col("pos") * F.col("neg"))
    return j.agg(F.try_divide(num, F.sum("pos") * F.sum("neg")).alias("auc"))
