"""Sentiment model checks: rows-only, counts consistent, AUC sane."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import sentiment as sm


def toy_reviews(spark, n=120):
    good = "great lovely perfect smooth love it"
    bad = "awful broke terrible rash hate it"
    rows = [(i, f"P{i % 4}", good if i % 2 else bad, 5 if i % 2 else 1) for i in range(n)]
    rows += [(n + 1, "P0", None, 5), (n + 2, "P1", "okay I guess", 3)]
    return spark.createDataFrame(rows, "review_id long, ProdID string, ReviewText string, "
                                       "Rating int")


def test_model_separates_and_counts_add_up(spark):
    reviews = toy_reviews(spark)
    m = sm.fit(sm.training_set(reviews), by_hash_split=True)
    assert m.auc is not None and 0.5 < m.auc <= 1.0
    pred = sm.predict(m.model, reviews)
    counts = sm.sentiment_counts(pred).collect()
    total = sum((r["sentiment__BadSentiment"] or 0) + (r["sentiment__GoodSentiment"] or 0)
                for r in counts)
    assert total == reviews.where(F.col("ReviewText").isNotNull()).count()


def test_exact_auc_matches_definition(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = sm.exact_auc(df, buckets=2).first().auc
    pos = [s for s, l in rows if l == 1]
    neg = [s for s, l in rows if l == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, label int")
    assert sm.exact_auc(df).first().auc is None
    assert sm.exact_auc(df.limit(0)).first().auc is None


def test_topics_read_every_document(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from reviewlake.operators import topics as tp
    seen = []
    fit = LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: seen.append(self.getSubsamplingRate()) or fit(self, df))
    df = spark.createDataFrame([(i, f"red lipstick matte {i}") for i in range(8)],
                               "prod_id int, description string")
    out = tp.dominant_topics(df, max_iter=2).collect()
    assert seen == [1.0] and sorted(r.prod_id for r in out) == list(range(8))
    assert all(0 <= r.topic <= 4 for r in out)


def test_hash_sample_takes_rows_of_all_products(spark):
    rows = [(i, f"P{i // 100}", "text", 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "review_id long, ProdID string, ReviewText string, Rating int")
    first = sm.training_set(df, cap=200).select("ProdID").distinct().count()
    spread = sm.training_set(df, cap=200, sample=True)
    assert first == 2 and spread.count() == 200 and spread.select("ProdID").distinct().count() == 10


def test_topic_passes_read_written_counts(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from reviewlake.operators import topics as tp
    plans = []
    fit = LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(self, df))
    df = spark.createDataFrame([(i, f"red matte {i}") for i in range(4)] + [(9, None)], "prod_id int, description string")
    assert sorted(r.prod_id for r in tp.dominant_topics(df.where("description is not null"), max_iter=1).collect()) == [0, 1, 2, 3]
    assert "regexp_replace" not in plans[0] and "parquet" in plans[0]
