"""Newton regression, scoring by a table of term weights, non-negative factorisation."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from reviewlake.operators import factorise as nmf
from reviewlake.operators import newton
from reviewlake.operators import sentiment as sm
from reviewlake.operators import term_model as tm


def test_newton_equals_numpy_and_is_finite_when_separable(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [(int(b), float(a[0]), float(a[1])) for a, b in zip(x, y, strict=True)] + [(None, 9.0, 9.0), (1, None, 0.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(5)
    got = newton.fit_newton(df, "y", {"a": F.col("a"), "b": F.col("b")}, l2=0.7, steps=9)
    full, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(9):
        p = 1 / (1 + np.exp(-full @ beta))
        h = full.T @ (full * (p * (1 - p))[:, None]) + 0.7 * np.eye(3)
        beta = beta + np.linalg.solve(h, full.T @ (y - p) - 0.7 * beta)
    assert np.allclose([got["intercept"], got["a"], got["b"]], beta, atol=1e-9)
    assert got["a"] > 1 and got["b"] < -0.5
    parted = df.select((F.col("a") > 0).cast("int").alias("y"), "a")
    far = newton.fit_newton(parted, "y", {"a": F.col("a")}, l2=1.0)
    assert np.isfinite(list(far.values())).all() and far["a"] > 2
    scores = newton.predict_newton(parted, {"a": F.col("a")}, far).where("score > 0.5 and y = 0")
    assert scores.count() < 20
    assert newton.fit_newton(parted.limit(0), "y", {"a": F.col("a")}) == {"intercept": 0.0, "a": 0.0}


def reviews(spark, n=240, seed=2):
    r = random.Random(seed)
    words = {0: ["awful", "hate", "bad", "it"], 1: ["great", "love", "nice", "it"]}
    rows = []
    for i in range(n):
        label = i % 2
        text = None if i % 31 == 0 else " ".join(r.choice(words[label] + ["very", "the  red"]) for _ in range(r.randint(0, 9)))
        rows.append((i, f"P{i % 7}" if i % 29 else None, text, 5 if label else 1))
    return spark.createDataFrame(rows, "review_id long, ProdID string, ReviewText string, Rating int")


def test_scores_by_the_regressions_table_are_the_pipelines(spark):
    df = reviews(spark)
    model = sm.pipeline().fit(sm.training_set(df, cap=None))
    weights, intercept = tm.regression_table(model, tm.token_counts(df, []).select("term"))
    scored = tm.score_by_table(df, weights, intercept, digits=9)
    from pyspark.ml.functions import vector_to_array
    want = {r.review_id: (round(r.m, 6), r.prediction) for r in model.transform(sm.with_text(df)).select(
        "review_id", vector_to_array("rawPrediction")[1].alias("m"), "prediction").collect()}
    got = {r.review_id: (round(r.margin, 6), r.prediction) for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    counts = {r.ProdID: r for r in tm.class_counts(scored).collect()}
    direct = {r.ProdID: r for r in sm.sentiment_counts(sm.predict(model, df)).collect()}
    assert counts == direct and None not in counts


def test_log_odds_tell_the_classes_apart(spark):
    df = reviews(spark)
    weights, classes = tm.log_odds_table(sm.training_set(df, cap=None))
    w = {r.term: r.weight for r in weights.collect()}
    assert w["great"] > 1 > -1 > w["awful"] and abs(w["it"]) < 0.7
    scored = tm.score_by_table(df, weights, classes.scalar()).join(df.select("review_id", "Rating", "ReviewText"), "review_id")
    known = scored.where("length(ReviewText) > 20")
    right = known.where("(Rating = 5) = (prediction = 1)").count()
    assert right >= 0.95 * known.count() and scored.count() == df.where("ReviewText is not null").count()


def numpy_passes(x, w, h, passes):
    """The same updates on dense matrices; errors after each pass."""
    errors = []
    for _ in range(passes):
        w = w * (x @ h.T) / (w @ (h @ h.T) + nmf.TINY)
        h = h * (w.T @ x) / ((w.T @ w) @ h + nmf.TINY)
        errors.append(float(((x - w @ h) ** 2).sum()))
    return w, h, errors


def test_factorisation_equals_numpy_and_its_error_falls(spark):
    r = np.random.default_rng(4)
    k, rows = 3, []
    for cat, n, m in (("c1", 12, 9), ("c2", 5, 7)):
        base = r.random((n, k)) @ r.random((k, m)) * (r.random((n, m)) < 0.6)
        base[0, 0] = base[:, 1].max() + 1
        rows += [(cat, int(i), f"t{j}", float(base[i, j])) for i, j in np.argwhere(base > 0)]
    triples = spark.createDataFrame(rows, "category string, prod_id long, term string, weight double").repartition(3)
    start = nmf.factorise(triples, k=k, passes=0)
    last, errors = None, []
    for passes in (1, 2, 4):
        last = nmf.factorise(triples, k=k, passes=passes)
        errors.append({x.category: x.error for x in nmf.squared_error(triples, *last, k=k).collect()})
    for cat in ("c1", "c2"):
        ids = sorted({x[1] for x in rows if x[0] == cat})
        names = sorted({x[2] for x in rows if x[0] == cat})
        x = np.zeros((len(ids), len(names)))
        for c, i, t, w in rows:
            if c == cat:
                x[ids.index(i), names.index(t)] = w

        def matrix(frame, key, order, cat=cat):
            got = {v[key]: [v[f"f{i}"] for i in range(k)] for v in frame.where(F.col("category") == cat).collect()}
            return np.array([got[o] for o in order])
        w, h, want = numpy_passes(x, matrix(start[0], "prod_id", ids), matrix(start[1], "term", names).T, 4)
        assert np.allclose(matrix(last[0], "prod_id", ids), w) and np.allclose(matrix(last[1], "term", names).T, h)
        assert np.allclose([e[cat] for e in errors], [want[0], want[1], want[3]])
        assert want[0] > want[1] > want[2] > want[3] and (w >= 0).all()


def test_terms_are_counted_in_their_documents_row(spark):
    from collections import Counter

    from reviewlake.functions.text import counted
    from reviewlake.operators.tfidf import document_frequencies, term_frequencies
    rows = [(1, "c", "red Red blue, the red"), (1, "c", "blue x green"), (2, None, "red the the"), (3, "c", None),
            (4, "c", ""), (5, "c", " , "), (None, "c", "red"), (6, "d", "one")]
    docs = spark.createDataFrame(rows, "prod_id int, category string, description string")
    tf = term_frequencies(docs)
    assert {(r.prod_id, r.category, r.term, r.tf) for r in tf.collect()} == {
        (1, "c", "red", 3), (1, "c", "blue", 2), (1, "c", "green", 1), (2, None, "red", 1), (None, "c", "red", 1),
        (6, "d", "one", 1)}
    # One grouping, on the document; no table of all terms of a task's documents.
    plan = tf._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    assert {(r.category, r.term): r.df for r in document_frequencies(tf).collect()}["c", "red"] == 2
    words = [["b", "a", "b", "", "a", "b"], [], ["z"]]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").select(counted(F.col("w")).alias("n")).collect()
    assert [{x.term: x.tf for x in r.n} for r in got] == [dict(Counter(w)) for w in words]


def test_the_table_of_weights_reads_the_texts_once(spark):
    rows = [(1, "p", "good good", 1), (2, "p", "bad", 0), (3, "q", "", 1)]
    labelled = spark.createDataFrame(rows, "review_id int, ProdID string, ReviewText string, label int")
    weights, classes = tm.log_odds_table(labelled)
    assert "explode" not in weights._jdf.queryExecution().optimizedPlan().toString()
    got = {r.review_id: r.margin for r in tm.score_by_table(labelled, weights, classes.scalar()).collect()}
    n1, n0, s1, s0, v = {"good": 2, "": 1}, {"bad": 1}, 3, 1, 3
    want = {w: np.log((n1.get(w, 0) + 1) / (s1 + v)) - np.log((n0.get(w, 0) + 1) / (s0 + v)) for w in ("good", "bad", "")}
    base = np.log(3 / 2)
    assert np.allclose([got[1], got[2], got[3]], [base + 2 * want["good"], base + want["bad"], base + want[""]], atol=2e-6)


def test_blocks_of_triples_stay_and_only_terms_of_several_blocks_travel(spark, monkeypatch):
    monkeypatch.setattr(nmf, "BLOCK_DOCS", 4)
    r = np.random.default_rng(5)
    k, rows = 3, []
    for d in range(22):
        # Terms of all documents, of neighbours, and of one document; one document has a term twice.
        names = [f"all{int(j)}" for j in r.choice(6, 4, replace=False)] + [f"near{d // 2}", f"own{d}"]
        rows += [("c1", d, t, float(x)) for t, x in zip(names, r.random(len(names)) + 0.1, strict=True)]
    rows += [("c1", 3, "own3", 0.25), ("c2", 3, "own3", 0.5), (None, 5, "all1", 1.0), ("c1", None, "all1", 1.0)]
    triples = spark.createDataFrame(rows, "category string, prod_id long, term string, weight double").repartitionByRange(2, "category", "prod_id")
    made = nmf._Factors(triples, "category", "prod_id", "term", k)
    n = made.blocks.count()
    assert n >= 6
    held = made.blocks.selectExpr("block", "explode(terms) AS term").where("term LIKE 'all%'")
    assert sorted({x.term[:3] for x in made.shared.where("term IS NOT NULL").collect()} - {"nea"}) == ["all"]
    assert made.shared.count() < made.blocks.selectExpr("explode(terms)").count() and held.count() > made.terms.count()
    x = np.zeros((22, len(names := sorted({t for c, d, t, _ in rows if c == "c1" and d is not None}))))
    for c, d, t, w in rows:
        if c == "c1" and d is not None:
            x[d, names.index(t)] += w

    def matrix(frame, key, order):
        got = {v[key]: [v[f"f{i}"] for i in range(k)] for v in frame.where("category = 'c1'").collect()}
        assert len(got) == len(order)
        return np.array([got[o] for o in order])
    start, last = (nmf.factorise(triples, k=k, passes=p) for p in (0, 3))
    w, h, _ = numpy_passes(x, matrix(start[0], "prod_id", range(22)), matrix(start[1], "term", names).T, 3)
    assert np.allclose(matrix(last[0], "prod_id", range(22)), w) and np.allclose(matrix(last[1], "term", names).T, h)
    # No exchange of the blocks: what is told is dealt as they lie.
    plan = made.run(0, False, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "weights" in plan


def test_triples_are_cut_into_whole_documents_of_one_category(monkeypatch):
    import pyarrow as pa
    rows = [("a", d, f"t{j}") for d in range(5) for j in range(d + 1)] + [("b", 4, "t0"), ("b", 5, "t0"), ("c", 5, "t1")]
    monkeypatch.setattr(nmf, "BLOCK_TRIPLES", 6)
    for docs, size in ((2, 1), (9, 2), (9, 100), (1, 3)):
        monkeypatch.setattr(nmf, "BLOCK_DOCS", docs)
        batches = [pa.RecordBatch.from_pylist([dict(zip("gdt", r, strict=True)) for r in rows[i:i + size]])
                   for i in range(0, len(rows), size)]
        cut = [(t.to_pylist(), list(begin)) for t, begin in nmf._cut(iter(batches))]
        assert [tuple(r.values()) for t, _ in cut for r in t] == rows
        held = [{(r["g"], r["d"]) for r in t} for t, _ in cut]
        assert all(len({g for g, _ in h}) == 1 and len(h) == len(b) <= docs for h, (_, b) in zip(held, cut, strict=True))
        assert sum(map(len, held)) == len({r[:2] for r in rows})
        assert all(t[i]["d"] != t[i - 1]["d"] for t, b in cut for i in b[1:])
    assert list(nmf._cut(iter([]))) == []
