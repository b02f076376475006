"""Queries: review filters, labels, training set, sentiment model and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.constants import TRAIN_ROW_CAP
from reviewlake.operators import sentiment as sm
from reviewlake.operators import factorise as nmf
from reviewlake.operators import newton
from reviewlake.operators import term_model as tm
from reviewlake.operators import tfidf as tfi
from reviewlake.operators import topics as tp
from reviewlake.operators.traits import ranked, trait_counts, trait_long, trait_share
from reviewlake.plans import sql, standins
from reviewlake.plans.registry import query
from reviewlake.plans.text import sentiment_tokens_sql
from reviewlake.sources.tables import read_table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return standins.review_texts(spark, d)


@query("reviews_with_text", f"""
SELECT review_id, ProdID FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL
""")
def reviews_with_text(spark: SparkSession, d: str) -> DataFrame:
    return sm.with_text(_texts(spark, d)).select("review_id", "ProdID")


@query("extreme_ratings", f"SELECT CID, ProdID, Rating FROM ({sql.REVIEWS}) WHERE Rating IN (1, 5)")
def extreme_ratings(spark: SparkSession, d: str) -> DataFrame:
    return sm.extreme_ratings(standins.reviews(spark, d)).select("CID", "ProdID", "Rating")


@query("rating_label", f"""
SELECT CID, Rating, CASE WHEN Rating = 5 THEN 1 WHEN Rating = 1 THEN 0 END AS label
FROM ({sql.REVIEWS})
""")
def rating_label(spark: SparkSession, d: str) -> DataFrame:
    r = standins.reviews(spark, d)
    return r.select("CID", "Rating", sm.rating_label().alias("label"))


TRAIN_SQL = f"""
SELECT ProdID, review_id, ReviewText, CASE WHEN Rating = 5 THEN 1 WHEN Rating = 1 THEN 0 END AS label
FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL AND Rating IN (1, 5)
ORDER BY ProdID, review_id LIMIT {TRAIN_ROW_CAP}
"""


@query("train_set", TRAIN_SQL)
def train_set(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows, capped at the first 100 000 in (product, review) order."""
    return sm.training_set(_texts(spark, d))


TRAIN_SAMPLE_CAP = 200


@query("train_sample", f"""
SELECT ProdID, review_id, ReviewText, CASE WHEN Rating = 5 THEN 1 WHEN Rating = 1 THEN 0 END AS label
FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL AND Rating IN (1, 5)
ORDER BY ((review_id % 2147483648) * 2654435761) % 4294967296, review_id LIMIT {TRAIN_SAMPLE_CAP}
""")
def train_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling form: the labelled rows of lowest id hash, from all products."""
    return sm.training_set(_texts(spark, d), cap=TRAIN_SAMPLE_CAP, sample=True)


LABEL_COUNTS_SQL = f"""
SELECT ProdID AS prod_id,
       nullif(count(*) FILTER (WHERE label = 0), 0) AS sentiment__BadSentiment,
       nullif(count(*) FILTER (WHERE label = 1), 0) AS sentiment__GoodSentiment
FROM (SELECT ProdID, CASE WHEN Rating = 5 THEN 1 WHEN Rating = 1 THEN 0 END AS label
      FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL)
GROUP BY ProdID
"""


def _label_counts(spark: SparkSession, d: str) -> DataFrame:
    t = sm.with_text(_texts(spark, d))
    t = t.select(F.col("ProdID").alias("prod_id"),
                 sm.rating_label().cast("double").alias("prediction"))
    return trait_counts(t, "prod_id", [sm.SENTIMENT])


query("label_counts", LABEL_COUNTS_SQL)(_label_counts)


@query("label_share", f"""
WITH c AS ({LABEL_COUNTS_SQL}),
l AS (SELECT prod_id, 'sentiment' AS family, 'BadSentiment' AS value,
             sentiment__BadSentiment AS n FROM c
      UNION ALL
      SELECT prod_id, 'sentiment', 'GoodSentiment', sentiment__GoodSentiment FROM c)
SELECT prod_id, family, value, n, n / sum(n) OVER (PARTITION BY prod_id, family) AS share,
       CAST(row_number() OVER (PARTITION BY prod_id ORDER BY n DESC NULLS LAST, value) AS INTEGER) AS rank
FROM l
""")
def label_share(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment mix per product on the true labels (the pie's data)."""
    share = trait_share(trait_long(_label_counts(spark, d), "prod_id", [sm.SENTIMENT]), "prod_id")
    return ranked(share, "prod_id", "n", "value")


@query("auc_sql", """
WITH s AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
               count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY score),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
SELECT round(sum(pos * below + 0.5 * pos * neg) / (sum(pos) * sum(neg)), 9) AS auc FROM c
""")
def auc_sql(spark: SparkSession, d: str) -> DataFrame:
    """Exact ROC AUC of a fixed score (document length) against the quality label."""
    lab = read_table(spark, d, "labels", ["doc_id", "quality"])
    docs = read_table(spark, d, "documents", ["doc_id", "n_chars"])
    s = lab.join(docs, "doc_id").select(F.col("n_chars").cast("double").alias("score"),
                                        F.col("quality").alias("label"))
    return sm.exact_auc(s).select(F.round("auc", 9).alias("auc"))


@query("hashed_tf", f"""
SELECT review_id, CAST(len({sentiment_tokens_sql('ReviewText')}) AS INTEGER) AS n_tokens,
       CAST(len({sentiment_tokens_sql('ReviewText')}) AS DOUBLE) AS tf_sum
FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL
""")
def hashed_tf(spark: SparkSession, d: str) -> DataFrame:
    """Hashed term-frequency vectors (10 000 buckets): tokens, and the vector's sum,
    which is the token count whatever the buckets are."""
    h = sm.hashed_features(_texts(spark, d))
    return h.select("review_id", "n_tokens", "tf_sum")


@query("split_sets", f"SELECT review_id, CAST(1 AS BIGINT) AS n_parts FROM ({TRAIN_SQL})")
def split_sets(spark: SparkSession, d: str) -> DataFrame:
    """Seeded 80/20 split of the training rows: every row is in exactly one part."""
    train, test = sm.split(sm.materialize(sm.training_set(_texts(spark, d))))
    both = train.select("review_id").unionByName(test.select("review_id"))
    return both.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_parts"))


@query("split_sets_hash", f"""
SELECT review_id, CASE WHEN ((review_id % 2147483648) * 2654435761) % 4294967296
                            / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS part
FROM ({TRAIN_SQL})
""")
def split_sets_hash(spark: SparkSession, d: str) -> DataFrame:
    """Id-hash 80/20 split of the training rows (stable under re-runs)."""
    train, test = sm.split(sm.training_set(_texts(spark, d)), by_hash=True)
    return (train.select("review_id", F.lit("train").alias("part"))
            .unionByName(test.select("review_id", F.lit("test").alias("part"))))


def _model(spark: SparkSession, d: str, evaluate: bool) -> sm.SentimentModel:
    return sm.fit(sm.training_set(_texts(spark, d)), evaluate=evaluate)


SCORED_SQL = f"""
SELECT ProdID AS prod_id, count(*) AS n_scored FROM ({sql.REVIEW_TEXTS})
WHERE ReviewText IS NOT NULL AND ProdID IS NOT NULL GROUP BY ProdID
"""


def sentiment_table(spark: SparkSession, d: str) -> DataFrame:
    """Predicted negative / positive reviews per product (all reviews with text)."""
    m = _model(spark, d, evaluate=False)
    pred = sm.predict(m.model, _texts(spark, d))
    return sm.sentiment_counts(pred.withColumnRenamed("ProdID", "prod_id"), "prod_id")


@query("sentiment_counts", SCORED_SQL)
def sentiment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scored reviews per product: the predicted classes add up to the reviews with text.
    (Which class a review gets is the model's; see the ML tests.)"""
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in
              ("sentiment__BadSentiment", "sentiment__GoodSentiment")]
    return sentiment_table(spark, d).select("prod_id", (counts[0] + counts[1]).alias("n_scored"))


@query("sentiment_auc", "SELECT true AS defined, true AS in_range")
def sentiment_auc(spark: SparkSession, d: str) -> DataFrame:
    """Held-out AUC of the sentiment model: that there is one, and its range."""
    train, test = sm.split(sm.materialize(sm.training_set(_texts(spark, d))))
    auc = sm.exact_auc(sm.held_out_scores(sm.pipeline().fit(train), test))
    return auc.select(F.col("auc").isNotNull().alias("defined"),
                      F.coalesce(F.col("auc").between(0, 1), F.lit(False)).alias("in_range"))


@query("sentiment_preview", f"SELECT * FROM ({SCORED_SQL}) ORDER BY prod_id LIMIT 10")
def sentiment_preview(spark: SparkSession, d: str) -> DataFrame:
    """First ten products of the sentiment table."""
    return sentiment_counts(spark, d).orderBy("prod_id").limit(10)


@query("topics", "SELECT doc_id AS prod_id, true AS topic_in_range FROM documents")
def topics(spark: SparkSession, d: str) -> DataFrame:
    """Dominant topic of every description: each product once, topic 0 to 4."""
    t = tp.dominant_topics(standins.descriptions(spark, d))
    return t.select("prod_id", F.col("topic").between(0, 4).alias("topic_in_range"))


# Length, punctuation and line breaks of a labelled document, about standard size.
NUMERIC_SQL = """
SELECT l.quality::DOUBLE AS y, 1.0::DOUBLE AS x0, ln(1 + length(d.text)) - 7 AS x1,
       20 * length(regexp_replace(d.text, '[^.,;:!?]', '', 'g')) / (1.0 + length(d.text)) AS x2
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND l.quality IS NOT NULL
"""
NEWTON_STEPS, NEWTON_L2 = 8, 1.0


def _newton_sql() -> str:
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    h = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}

    def minor(rows: tuple[int, int], cols: tuple[int, int]) -> str:
        (a, b), (c, e) = rows, cols
        return f"({h[a, c]} * {h[b, e]} - {h[a, e]} * {h[b, c]})"
    rest = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    det = " + ".join(f"{'-' if j == 1 else ''}{h[0, j]} * {minor((1, 2), rest[j])}" for j in range(3))
    solved = [" + ".join(f"{'-' if (i + j) % 2 else ''}g{i} * {minor(rest[i], rest[j])}" for i in range(3))
              for j in range(3)]
    sums = ", ".join([f"sum((y - p) * x{i}) - {NEWTON_L2} * b{i} AS g{i}" for i in range(3)]
                     + [f"sum(p * (1 - p) * x{i} * x{j}) + {NEWTON_L2 if i == j else 0.0} AS h{i}{j}" for i, j in pairs])
    return f"""
WITH RECURSIVE known AS ({NUMERIC_SQL}),
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT step + 1, {', '.join(f'b{j} + ({solved[j]}) / ({det})' for j in range(3))}
  FROM (SELECT step, b0, b1, b2, {sums}
        FROM (SELECT b.*, y, x0, x1, x2, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2))) AS p FROM b, known
              WHERE step < {NEWTON_STEPS})
        GROUP BY step, b0, b1, b2))
SELECT unnest(['intercept', 'length', 'punctuation']) AS feature,
       unnest([round(b0, 6), round(b1, 6), round(b2, 6)]) AS coefficient
FROM b WHERE step = {NEWTON_STEPS}
"""


@query("logreg_newton", _newton_sql())
def logreg_newton(spark: SparkSession, d: str) -> DataFrame:
    """Quality by length and punctuation: coefficients of the regression fitted by Newton steps."""
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    rows = sm.materialize(docs.join(read_table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")
                          .select("quality", F.length("text").alias("n"),
                                  F.length(F.regexp_replace("text", "[^.,;:!?]", "")).alias("marks")))
    n = F.col("n")
    features = {"length": F.log(1 + n) - 7, "punctuation": 20 * F.col("marks") / (F.lit(1.0) + n)}
    beta = newton.fit_newton(rows, "quality", features, l2=NEWTON_L2, steps=NEWTON_STEPS)
    table = F.explode(F.map_from_arrays(F.lit(list(beta)), F.lit([float(v) for v in beta.values()])))
    # One row per coefficient, hung on the fitted table itself.
    return (rows.agg(F.count(F.lit(1)).alias("n")).select(table.alias("feature", "coefficient"))
            .select("feature", F.round("coefficient", 6).alias("coefficient")))


TABLE_SCORED_SQL = f"""
WITH r AS (SELECT ProdID, review_id, ReviewText, CASE WHEN Rating = 5 THEN 1 WHEN Rating = 1 THEN 0 END AS label
           FROM ({sql.REVIEW_TEXTS}) WHERE ReviewText IS NOT NULL),
t AS (SELECT ProdID, review_id, label, unnest({sentiment_tokens_sql('ReviewText')}) AS term FROM r),
c AS (SELECT term, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0
      FROM t WHERE label IS NOT NULL GROUP BY term),
s AS (SELECT sum(n1) AS s1, sum(n0) AS s0, count(*) AS v FROM c),
w AS (SELECT term, ln((n1 + 1) / (s1 + v)) - ln((n0 + 1) / (s0 + v)) AS weight FROM c, s),
i AS (SELECT ln((count(*) FILTER (WHERE label = 1) + 1) / (count(*) FILTER (WHERE label = 0) + 1)) AS b FROM r),
m AS (SELECT review_id, sum(weight) AS s FROM t JOIN w USING (term) GROUP BY review_id),
p AS (SELECT r.ProdID, round(i.b + coalesce(m.s, 0), 6) > 0 AS good FROM r LEFT JOIN m USING (review_id), i)
SELECT ProdID AS prod_id, nullif(count(*) FILTER (WHERE NOT good), 0) AS sentiment__BadSentiment,
       nullif(count(*) FILTER (WHERE good), 0) AS sentiment__GoodSentiment
FROM p WHERE ProdID IS NOT NULL GROUP BY ProdID
"""


@query("sentiment_by_table", TABLE_SCORED_SQL)
def sentiment_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Negative and positive reviews per product by a table of term weights: both counts."""
    texts = _texts(spark, d)
    weights, classes = tm.log_odds_table(sm.training_set(texts, cap=None))
    scored = tm.score_by_table(texts, weights, classes.scalar())
    return tm.class_counts(scored.withColumnRenamed("ProdID", "prod_id"), "prod_id")


@query("topics_nmf", "SELECT source AS category, doc_id AS prod_id, true AS non_negative, true AS in_range FROM documents")
def topics_nmf(spark: SparkSession, d: str) -> DataFrame:
    """Dominant factor of every description, fitted per category: each product once, factors
    finite and not negative."""
    docs = standins.descriptions(spark, d)
    # By ranges: a partition has few categories, so its documents share their terms.
    u = tfi.unique_docs(docs.repartitionByRange("category", "prod_id"), "prod_id", "category")
    made, _ = nmf.factorise(tfi.tfidf(u, by_range=True), passes=NMF_PASSES)
    t = nmf.dominant_factor(made, docs, ["category", "prod_id"])
    return t.select("category", "prod_id", F.coalesce(F.col("weight") >= 0, F.lit(True)).alias("non_negative"),
                    F.coalesce(F.col("topic").between(0, 4), F.col("weight").isNull()).alias("in_range"))


NMF_PASSES = 3
