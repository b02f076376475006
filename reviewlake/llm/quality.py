"""Quality rules and a hashed n-gram logistic regression over whole texts (operator 8).

Rules and features are computed on the bytes of each text in Arrow batches.
The regression sees relative frequencies of hashed word 1- and 2-grams and of
character 3- and 4-grams (bytes, A-Z lower-cased); its margin is turned into a
probability by Platt scaling on labelled rows that it was not fitted on. Given a
toxicity label, a second head learns it from the words (runs of letters and digits) that
are present, however long the text: smoothed log-odds of those that tell, calibrated
alike. A text is rejected by either; the probability is then the lesser of being good
and of not being toxic.

Defined cases: a null text has no words and fails the base rules; rows are
judged one by one, so repeated ids give repeated results; a label table that is
empty or holds one class gives no head, and without any the base rules decide alone;
null labels are ignored, repeated labels of an id are averaged; empty tables
give empty results; columns other than id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.textbytes import (LOWER, WHITE, Chunk, byte_prefix_hash, chunks, mix, owners,
                                      prefix_hash, salted, span_hash, spans, windows, words)

#: The fixed rules: fewest words, longest share of words in repeated 8-word
#: windows (percent), and the characters counted as symbols.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WIDTH = 8
SYMBOLS = b"#*$%&|<>"

#: Rows kept have at least this calibrated probability of being good.
KEEP_PROBABILITY = 0.5
#: The classifier is fitted on at most this many labelled rows (lowest id hash).
MAX_TRAIN_ROWS = 4000
BUCKET_BITS = 18
CHAR_ORDERS = (3, 4)
ITERATIONS = 60
L2 = 1e-6
#: Bytes of text judged at once: what a task holds beside them is some 250 times as much.
JUDGE_BYTES = 1 << 18
#: Features of the sample that a step of the fit works on at once (or those of one row).
FIT_FEATURES = 1 << 20
#: Relative frequencies are small numbers; this brings them to about 1.
FEATURE_SCALE = 32.0
#: A word tells of toxicity if its count among toxic rows is so many standard deviations off.
TELLING = 5.0

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = _IS_LETTER[128:] = True

RESULT_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                 "n_repeat_words long, base_failed boolean, kept boolean, probability double")


@dataclass
class QualityModel:
    """Weights per hashed bucket, the intercept, and the calibration line."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    #: Whether it sums the weights of the words present, or relative frequencies of all features.
    presence: bool = False
    #: A model of being not toxic, or none.
    other: QualityModel | None = None

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def rule_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The base columns of each text of a chunk."""
    data, offs = chunk.data, chunk.offs
    starts, ends, bounds = words(chunk)
    n_words = np.diff(bounds)
    prefix = byte_prefix_hash(data)

    lines = spans(data != 0x0A, offs)
    with_word = np.diff(np.searchsorted(starts, np.append(lines[0], len(data)))) > 0 \
        if len(lines[0]) else np.zeros(0, bool)
    line_text = owners(lines[2])[with_word]
    line_key = salted(span_hash(prefix, lines[0][with_word], lines[1][with_word]), line_text)
    first = np.unique(line_key, return_index=True)[1]
    distinct = np.bincount(line_text[first], minlength=len(chunk))

    word_prefix = prefix_hash(span_hash(prefix, starts, ends))
    at, text = windows(bounds, REPEAT_WIDTH)
    key = salted(span_hash(word_prefix, at, at + REPEAT_WIDTH), text)
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, at[repeated], 1)
    np.add.at(edge, at[repeated] + REPEAT_WIDTH, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return {
        "n_words": n_words,
        "word_chars": chunk.sums(~WHITE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.sums(_IS_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text, minlength=len(chunk)) - distinct,
        "n_repeat_words": covered[bounds[1:]] - covered[bounds[:-1]],
    }


def feature_families(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Families of features: the bucket of each occurrence, and the texts' bounds."""
    lowered = Chunk(chunk.first, LOWER[chunk.data], chunk.offs)
    starts, ends, bounds = words(lowered)
    word_hash = span_hash(byte_prefix_hash(lowered.data), starts, ends)
    shift = np.uint64(64 - BUCKET_BITS)
    yield (word_hash >> shift).astype(np.int32), bounds
    at, _ = windows(bounds, 2)
    pair = mix(word_hash[at] + word_hash[at + 1] * np.uint64(3)) if len(at) else word_hash[:0]
    yield (pair >> shift).astype(np.int32), _window_bounds(bounds, 2)
    for order in CHAR_ORDERS:
        at, _ = windows(chunk.offs, order)
        gram = np.full(len(at), order, np.uint32)
        for i in range(order):
            gram = gram * np.uint32(0x01000193) ^ lowered.data[at + i]
        gram = gram * np.uint32(0x9E3779B1)
        yield (gram >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), \
            _window_bounds(chunk.offs, order)


def _window_bounds(bounds: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.maximum(np.diff(bounds) - width + 1, 0))))


def words_present(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of each text: text, bucket; by text."""
    data = LOWER[chunk.data]
    starts, ends, bounds = spans(_IS_LETTER[data], chunk.offs)
    bucket = span_hash(byte_prefix_hash(data), starts, ends) >> np.uint64(64 - BUCKET_BITS)
    each = np.unique(owners(bounds) << BUCKET_BITS | bucket.astype(np.int64))
    return each >> BUCKET_BITS, each & ((1 << BUCKET_BITS) - 1)


def margins(chunk: Chunk, model: QualityModel) -> np.ndarray:
    if model.presence:
        text, bucket = words_present(chunk)
        return model.bias + np.bincount(text, weights=model.weights[bucket], minlength=len(chunk))
    out = np.full(len(chunk), model.bias)
    for bucket, bounds in feature_families(chunk):
        total = np.concatenate(([0.0], np.cumsum(model.weights[bucket], dtype=np.float64)))
        count = np.diff(bounds)
        out += FEATURE_SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(count, 1)
    return out


def probabilities(chunk: Chunk, model: QualityModel) -> np.ndarray:
    """The least probability of the model and the other one with it."""
    own = model.probability(margins(chunk, model))
    return np.minimum(own, probabilities(chunk, model.other)) if model.other else own


def judge(texts: pa.Array, model: QualityModel | None) -> dict[str, np.ndarray]:
    """All result columns but the id, for one Arrow batch of texts."""
    parts: list[dict[str, np.ndarray]] = []
    for chunk in chunks(texts, JUDGE_BYTES):
        part = rule_counts(chunk)
        part["probability"] = probabilities(chunk, model) if model \
            else np.full(len(chunk), np.nan)
        parts.append(part)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability")
    out = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"]
    if model:
        out["kept"] &= out["probability"] >= KEEP_PROBABILITY
    return out


# -- fitting ---------------------------------------------------------------

def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        held = batch.column(1).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(2), JUDGE_BYTES):
            rows: list[list[np.ndarray]] = [[] for _ in range(len(chunk))]
            for bucket, bounds in feature_families(chunk):
                for i in range(len(chunk)):
                    own = bucket[bounds[i]:bounds[i + 1]]
                    if len(own):
                        index, count = np.unique(own, return_counts=True)
                        rows[i].append(np.stack([index.astype(np.float32),
                                                 (count / len(own)).astype(np.float32)]))
            here = slice(chunk.first, chunk.first + len(chunk))
            joined = [np.concatenate(r, axis=1) if r else np.zeros((2, 0), np.float32)
                      for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(label[here].astype(np.float64)), pa.array(held[here].astype(bool)),
                pa.array([j.tobytes() for j in joined], pa.binary())],
                ["label", "held", "features"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit and calibrate on the bounded sample: one row of parameters, or none.

    The features are kept once, in blocks of rows; a step's own arrays are those of a block.
    """
    label, held, blocks = [], [], []
    for batch in batches:
        label.append(batch.column(0).to_numpy(zero_copy_only=False))
        held.append(batch.column(1).to_numpy(zero_copy_only=False))
        blocks += _blocks(batch.column(2))
        del batch
    y = np.concatenate(label) if label else np.zeros(0)
    held = np.concatenate(held) if held else np.zeros(0, bool)
    fit = ~held
    if len(set(y[fit] > 0.5)) < 2:
        return
    size = 1 << BUCKET_BITS
    at = np.cumsum([0] + [len(counts) for counts, _, _ in blocks])

    def margin(w, b):
        return np.concatenate([np.bincount(np.repeat(np.arange(len(counts)), counts), weights=value * w[bucket],
                                           minlength=len(counts)) for counts, bucket, value in blocks]) + b

    def gradient(error):
        g = np.zeros(size)
        for first, (counts, bucket, value) in zip(at[:-1], blocks, strict=True):
            g += np.bincount(bucket, weights=value * np.repeat(error[first:first + len(counts)], counts),
                             minlength=size)
        return g

    target = (y > 0.5).astype(float)
    good = target[fit].mean()
    # Both classes weigh the same, so the rarer class is learnt as well; held rows weigh nothing.
    weight = np.where(target > 0, 0.5 / good, 0.5 / (1 - good)) / fit.sum() * fit
    w, b = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, ITERATIONS + 1):   # Adam on the full batch
        p = 1 / (1 + np.exp(-np.clip(margin(w, b), -60, 60)))
        error = (p - target) * weight
        g = gradient(error) + L2 * w
        gb = error[fit].sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        b -= 0.1 * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8)
    calibrate = held if len(set(y[held] > 0.5)) == 2 else fit
    slope, offset = _platt(margin(w, b)[calibrate], y[calibrate] > 0.5)
    yield pa.RecordBatch.from_arrays([
        pa.array([w.astype(np.float32).tobytes()], pa.binary()),
        pa.array([b]), pa.array([slope]), pa.array([offset])], ["w", "b", "slope", "shift"])


def _blocks(features: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: features per row, then the buckets and scaled values of all of them."""
    rows: list[np.ndarray] = []
    n = 0
    for k in range(len(features)):
        rows.append(np.frombuffer(features[k].as_buffer(), np.float32).reshape(2, -1))
        n += rows[-1].shape[1]
        if k + 1 == len(features) or n >= FIT_FEATURES:
            yield (np.array([x.shape[1] for x in rows]),
                   np.concatenate([x[0] for x in rows]).astype(np.int32),
                   np.concatenate([x[1] for x in rows]) * np.float32(FEATURE_SCALE))
            rows, n = [], 0


def _present_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2), JUDGE_BYTES):
            text, bucket = words_present(chunk)
            at = np.searchsorted(text, np.arange(len(chunk) + 1))
            here = slice(chunk.first, chunk.first + len(chunk))
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[here], batch.column(1)[here],
                pa.array([bucket[i:j].astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)],
                         pa.binary())], ["label", "held", "features"])


def _fit_present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log-odds of the words that tell, and their calibration: one row of parameters, or none."""
    label, held, features = [], [], []
    for batch in batches:
        label += batch.column(0).to_pylist()
        held += batch.column(1).to_pylist()
        features += [np.frombuffer(b, np.int32) for b in batch.column(2).to_pylist()]
    good, held = np.array(label) > 0.5, np.array(held, bool)
    if len(set(good[~held])) < 2:
        return

    def seen(rows: np.ndarray) -> np.ndarray:
        own = [features[i] for i in np.flatnonzero(rows)]
        return np.bincount(np.concatenate(own), minlength=1 << BUCKET_BITS)

    clean, toxic = seen(good & ~held), seen(~good & ~held)
    n, m = (good & ~held).sum(), (~good & ~held).sum()
    share = m / (n + m)
    both = clean + toxic
    off = (toxic - share * both) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    w = np.where(np.abs(off) >= TELLING, np.log((clean + 1 - share) / n) - np.log((toxic + share) / m), 0.0)
    calibrate = np.flatnonzero(held)
    if len(set(good[calibrate])) < 2:
        calibrate = np.flatnonzero(~held)
    slope, offset = _platt(np.array([w[features[i]].sum() for i in calibrate]), good[calibrate])
    yield pa.RecordBatch.from_arrays([
        pa.array([w.astype(np.float32).tobytes()], pa.binary()),
        pa.array([0.0]), pa.array([slope]), pa.array([offset])], ["w", "b", "slope", "shift"])


def _platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton steps for sigmoid(slope * margin + offset), with Platt's smoothed targets."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([margin, np.ones(len(margin))])
    par = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(par @ x, -60, 60)))
        g = x @ (p - target) + 1e-6 * par
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        par = par - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(par[0]), float(par[1])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality", toxic_col: str | None = None,
                max_train_rows: int = MAX_TRAIN_ROWS) -> QualityModel | None:
    """Fit the classifier, and with ``toxic_col`` a second one of texts that are not toxic,
    each on its own bounded sample of labelled rows; None if neither has two classes."""
    fits = [_fit_column(docs, labels, F.col(label_col).cast("double"), id_col, text_col, max_train_rows)]
    if toxic_col:
        fits.append(_fit_column(docs, labels, 1 - F.col(toxic_col).cast("double"), id_col, text_col,
                                max_train_rows, presence=True))
    first, *others = [m for m in fits if m] or [None]
    return replace(first, other=others[0]) if others else first


def _fit_column(docs: DataFrame, labels: DataFrame, label: Column, id_col: str, text_col: str,
                max_train_rows: int, presence: bool = False) -> QualityModel | None:
    """Fit one head on a bounded sample of labelled rows.

    The sample is the ``max_train_rows`` labelled ids of lowest hash; a quarter
    of it, by another hash, calibrates. None if one class alone is left.
    """
    order = F.xxhash64(F.lit("quality"), "id")
    sample = (labels.select(F.col(id_col).alias("id"), label.alias("label"))
              .dropna().groupBy("id").agg(F.avg("label").alias("label"))
              .orderBy(order, "id").limit(max_train_rows))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "id")     # at most max_train_rows ids
            .select("label", (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0).alias("held"),
                    "text"))
    fitted = (rows.mapInArrow(_present_rows if presence else _sparse_rows, "label double, held boolean, features binary")
              .repartition(1)
              .mapInArrow(_fit_present if presence else _fit, "w binary, b double, slope double, shift double").collect())
    if not fitted:
        return None
    r = fitted[0]
    return QualityModel(np.frombuffer(r.w, np.float32), r.b, r.slope, r.shift, presence)


# -- scoring ---------------------------------------------------------------

def score_quality(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: the base columns, the verdict, the probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # 2**BUCKET_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch.column(1), shared.value)
            columns = [batch.column(0)]
            columns += [pa.array(got[k].astype(np.int64)) for k in
                        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [pa.array(got[k].astype(bool)) for k in ("base_failed", "kept")]
            columns += [pa.array(got["probability"], from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT_SCHEMA)


def keep_quality(docs: DataFrame, model: QualityModel | None, *, text_col: str = "text") -> DataFrame:
    """The documents that the rules and the classifier keep, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at), shared.value)["kept"].astype(bool)))

    return docs.mapInArrow(run, docs.schema)
