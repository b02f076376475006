"""Quality rules, suffix dedup, context trees and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm.queries import byte_bpe_path
from reviewlake.llm.textbytes import chunks, distinct

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "a b", "é漢 🙂 é漢 🙂", "same text here\nsame text here"]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(seed, n_docs=40, words=90):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["ti", "on", "er", "é", "th", "ß"]) for _ in range(r.randint(1, 4)))
                  for _ in range(60)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n_docs)]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    texts = prose(1) + ODD
    texts += [texts[3], texts[3] + " and more", texts[7][:200] + texts[8], "#|# " * 60]
    texts += [" ".join(texts[9].split()[:40] + [r.choice("abc")] + texts[9].split()[41:])] * 3
    texts.append(" ".join(prose(2, 60)))        # a long one
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[5], 1), (None, "null id", 1)]
    random.Random(3).shuffle(rows)
    # The extra column's name is one that the results use.
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3), rows


def test_distinct_is_unique():
    for n in (0, 1, 5, 4000):
        keys = np.random.default_rng(n).integers(0, 1 << 12, n).astype(np.uint64) << np.uint64(40)
        keys ^= np.random.default_rng(n + 1).integers(0, 3, n).astype(np.uint64)
        for got, want in zip(distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(got, want)


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))


def test_quality_counts_and_verdicts(spark, corpus):
    from reviewlake.llm.quality import fit_quality, keep_quality, score_quality
    docs, rows = corpus
    got = Counter(tuple(r)[:8] for r in score_quality(docs, None).collect())
    want = Counter()
    for i, t, _ in rows:
        c = brute_rules(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert got == want
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert fit_quality(docs, labels) is None            # one class
    kept = keep_quality(docs, None)
    assert kept.columns == docs.columns and kept.count() == sum(v for k, v in want.items() if k[7])


def test_quality_held_out_accuracy(spark):
    from reviewlake.llm.quality import fit_quality, score_quality
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where(F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(2)) == 0)
    scored = score_quality(docs, fit_quality(docs, half, max_train_rows=1500)).join(
        labels.join(half, "doc_id", "left_anti"), "doc_id").where("not base_failed")
    r = scored.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")).alias("right"),
                   F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double"))).alias("keeps")).first()
    assert r["right"] > 0.97 and r["keeps"] > 0.97


def test_op8_rejects_held_out_toxic_texts(spark, tmp_path):
    from reviewlake.llm.queries import QUERIES
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fifth = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(5)) == 0
    docs.join(labels, "doc_id", "left_semi").write.parquet(f"{tmp_path}/documents.parquet")
    labels.where(~fifth).write.parquet(f"{tmp_path}/labels.parquet")
    judged = QUERIES["op8_quality_rules"](spark, str(tmp_path)).join(labels.where(fifth), "doc_id").where(
        "not base_failed and quality = 1")
    kept = {r.toxic: (r.kept, r.n) for r in judged.groupBy("toxic").agg(
        F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1][0] < 0.25 and kept[0][0] > 0.97


def test_quality_works_in_small_blocks(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from reviewlake.llm import quality as q

    def peak(run):
        tracemalloc.start()
        got = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 300, n))) for n in r.integers(0, 900, 1500)] + [None, ""]
    weights = r.normal(size=1 << q.BUCKET_BITS).astype(np.float32)
    model = q.QualityModel(weights, 0.1, 1.0, 0.0, other=q.QualityModel(weights, 0.2, 1.0, 0.0, True))
    q.judge(pa.array(texts[:50]), model)
    got, most = peak(lambda: q.judge(pa.array(texts), model))
    assert most < 80 << 20
    alone = [q.judge(pa.array([t], pa.string()), model)["probability"][0] for t in texts[::40]]
    assert np.allclose(got["probability"][::40], alone) and len(got["kept"]) == len(texts)

    rows, y, held = [], r.random(300) < 0.4, r.random(300) < 0.25
    for good in y:
        n = int(r.integers(0, 4000))
        rows.append(np.stack([r.integers(0, 1 << 17, n) + (1 << 17) * (r.random(n) < 0.1) * good,
                              np.full(n, 1 / 400)]).astype(np.float32))
    batch = pa.RecordBatch.from_arrays([pa.array(y.astype(float)), pa.array(held),
                                        pa.array([x.tobytes() for x in rows], pa.binary())], ["label", "held", "features"])
    monkeypatch.setattr(q, "ITERATIONS", 3)
    whole = next(q._fit(iter([batch])))
    monkeypatch.setattr(q, "FIT_FEATURES", 1 << 14, raising=False)
    (cut,), most = peak(lambda: list(q._fit(iter([batch.slice(0, 100), batch.slice(100)]))))
    assert most < 2 * batch.nbytes + 10 * 8 * (1 << q.BUCKET_BITS)
    assert np.allclose(*[np.frombuffer(x.column(0)[0].as_py(), np.float32) for x in (whole, cut)], atol=1e-6)
    # One plain step on dense rows gives the first step's direction.
    monkeypatch.setattr(q, "ITERATIONS", 1)
    w = np.frombuffer(next(q._fit(iter([batch]))).column(0)[0].as_py(), np.float32)
    n, m = (y & ~held).sum(), (~y & ~held).sum()
    g = np.zeros(1 << q.BUCKET_BITS)
    for x, good, out in zip(rows, y, held, strict=True):
        if not out:
            np.add.at(g, x[0].astype(int), x[1] * q.FEATURE_SCALE * (-0.25 / n if good else 0.25 / m))
    assert np.array_equal(np.sign(w[np.abs(g) > 1e-7]), -np.sign(g[np.abs(g) > 1e-7])) and not w[g == 0].any()
    assert list(q._fit(iter([]))) == [] == list(q._fit(iter([batch.filter(pa.array(y))])))


def brute_spans(rows, width=50):
    order = lambda i: -1 if i is None else i
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first[b[p:p + width]] = min(order(i), first.get(b[p:p + width], 1 << 60))
    out = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < order(i):
                gone[p:p + width] = b"\1" * width
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup(spark, corpus, monkeypatch):
    from reviewlake.llm import blocks
    from reviewlake.llm.suffix_dedup import COVER, MODULUS, cut_repeats, repeated_spans
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))
    docs, rows = corpus
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 2000)
    assert Counter(tuple(r)[:5] for r in repeated_spans(docs).collect()) == brute_spans(rows)
    cut = cut_repeats(docs, length_col="n_words")
    assert cut.schema == docs.schema and cut.count() == len(rows)
    assert cut.where("length(text) <> n_words").isEmpty()
    assert repeated_spans(docs.limit(0)).isEmpty() and cut_repeats(docs.limit(0)).isEmpty()


def test_more_blocks_than_a_table_may_have_buckets(spark, corpus, monkeypatch):
    from reviewlake.llm import blocks, storage
    from reviewlake.llm.suffix_dedup import repeated_spans
    docs, rows = corpus
    monkeypatch.setattr(storage, "MAX_BUCKETS", 3)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 2000)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        made = blocks.write_blocks(docs, block_bytes=200)
        assert made.parts == 3 and made.frame.count() > 20
        texts = Counter(c.text(i) for _, c in map(blocks.unpack, (r.asDict() for r in made.frame.collect()))
                        for i in range(len(c)))
        assert texts == Counter((t or "").encode() for _, t, _ in rows)
        assert Counter(tuple(r)[:5] for r in repeated_spans(docs).collect()) == brute_spans(rows)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def brute_tree(texts, learnt, depth):
    """Context trees by their definition, node by node."""
    count = defaultdict(lambda: [0, 0])
    seqs = [[255] * depth + list(low(t or "").encode()) + [255] for t in texts]
    for q, use in zip(seqs, learnt, strict=True):
        for p in range(depth, len(q) if use else 0):
            for bit in range(8):
                node = (q[p] >> (8 - bit)) + (1 << bit)
                for d in range(depth + 1):
                    count[node, tuple(q[p - 1 - j] for j in range(d))][q[p] >> (7 - bit) & 1] += 1
    kt = lambda a, b: (math.lgamma(a + .5) + math.lgamma(b + .5)
                       - math.lgamma(a + b + 1) - math.log(math.pi))
    children = defaultdict(list)
    for z, c in count:
        if c:
            children[z, c[:-1]].append((z, c))
    weighted, stop = {}, {}
    for n in sorted(count, key=lambda n: -len(n[1])):
        own = kt(*count[n])
        if len(n[1]) == depth:
            weighted[n], stop[n] = own, 1.0
        else:
            both = np.logaddexp(own, sum(weighted[c] for c in children[n]))
            weighted[n], stop[n] = both - math.log(2), math.exp(own - both)
    out = []
    for q in seqs:
        total = 0.0
        for p in range(depth, len(q)):
            for bit in range(8):
                node, one, prob = (q[p] >> (8 - bit)) + (1 << bit), q[p] >> (7 - bit) & 1, None
                for d in range(depth, -1, -1):
                    n = (node, tuple(q[p - 1 - j] for j in range(d)))
                    if n in count:
                        own = (count[n][one] + .5) / (sum(count[n]) + 1)
                        prob = own if prob is None else stop[n] * own + (1 - stop[n]) * prob
                total += math.log10(.5 if prob is None else prob)
        out.append(total)
    return out


def test_context_tree(spark):
    from reviewlake.llm.ctw import score_texts
    rows = [(i, t) for i, t in enumerate(prose(4, 14, 30) + ODD)] + [(None, "No id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    learnt = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, _ in rows]
    want = brute_tree([t for _, t in rows], learnt, 3)
    words = Counter()
    for (_, t), use in zip(rows, learnt, strict=True):
        if use:
            words.update([*WORD.findall(low(t or "")), None])
    n, v = sum(words.values()), len(words)
    got = {r.doc_id: r for r in score_texts(docs, depth=3).collect()}
    for (i, t), use, score in zip(rows, learnt, want, strict=True):
        tokens, r = [*WORD.findall(low(t or "")), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            not use, len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert abs(r.base_score - sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-9
        assert abs(r.score - score) < 1e-4 * max(1, -score)
    assert score_texts(docs.limit(0)).isEmpty()


def test_context_tree_is_a_distribution():
    from reviewlake.llm.ctw import Top, log10_probabilities, log_kt, trees
    r = np.random.default_rng(1)
    key = np.unique(r.integers(0, 1 << 32, 300).astype(np.uint64) & np.uint64(0x03030303))
    found = trees(key, r.integers(1, 9, len(key)), 3)
    top = Top(np.zeros((257, 256), int), np.zeros((257, 256), int), np.ones((257, 256)))
    context = key[0] >> np.uint64(8) << np.uint64(8)
    p = 10 ** log10_probabilities(context + np.arange(256, dtype=np.uint64), found, top, 3)
    assert abs(p.sum() - 1) < 1e-9
    assert abs(log_kt(np.array([700]), np.array([300]))[0] - (
        math.lgamma(700.5) + math.lgamma(300.5) - math.lgamma(1001) - math.log(math.pi))) < 1e-9


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    from reviewlake.llm.tokens import Encoder
    own, theirs = Encoder(byte_bpe_path()), Tokenizer.from_file(byte_bpe_path())
    r = random.Random(1)
    letters = list("ab'srtvemld  \n\t.!?é漢1２½ 　​🙂\r\x1c\x85A'")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + prose(9)
    for chunk in chunks(pa.array(texts), 5000):
        ids, offs = own.encode(chunk)
        for i in range(len(chunk)):
            assert ids[offs[i]:offs[i + 1]].tolist() == theirs.encode(
                texts[chunk.first + i], add_special_tokens=False).ids


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    from reviewlake.llm.packing import pack
    docs, rows = corpus
    t, size = Tokenizer.from_file(byte_bpe_path()), 64
    got = [r.asDict() for r in pack(docs, byte_bpe_path(), capacity=size).collect()]
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = list(range(len(ids), 0, -size))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in got) // size) + 1
    assert pack(docs.limit(0), byte_bpe_path()).isEmpty()


def test_sweep_is_best_fit_decreasing():
    from reviewlake.llm.packing import sweep
    r = random.Random(2)
    for _ in range(30):
        lengths = sorted((r.randint(1, 40) for _ in range(r.randint(1, 200))), reverse=True)
        gaps = []
        for x in lengths:
            fits = [g for g in gaps if g >= x]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - x)
            else:
                gaps.append(40 - x)
        moves = sweep(Counter(lengths), 40)
        last = max(int(m[3] + (m[2] - m[1]) // m[4]) for m in moves)
        assert last == len(gaps) and sum(int(m[2] - m[1]) for m in moves) == len(lengths)


def test_workers_hold_little_beside_their_texts():
    import tracemalloc

    from reviewlake.llm import near_dup
    from reviewlake.llm.tokens import Encoder
    r = random.Random(3)
    some = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    texts = pa.array([" ".join(r.choices(some, k=170)) for _ in range(4000)])      # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), texts], ["id", "k", "text"])
    encoder = Encoder(byte_bpe_path())

    def peak(work) -> int:
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1] >> 20
        finally:
            tracemalloc.stop()

    held = (peak(lambda: sum(b.num_rows for b in near_dup._sketch(iter([batch])))),
            peak(lambda: [len(encoder.encode(c)[0]) for c in chunks(texts)] and None))
    assert max(held) < 80, held
