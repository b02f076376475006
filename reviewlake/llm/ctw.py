"""Context-tree weighting over bytes, fitted on and applied to whole texts (operator 6).

A text is its bytes, A-Z lower-cased, then one end symbol. Each byte is decided
by eight binary choices; each choice (its bits so far) has a context tree over
the ``DEPTH`` preceding bytes. A node of a tree holds a Krichevsky-Trofimov
estimate of its training counts, and the tree mixes all depths: the weighted
probability of a node is the mean of its own estimate and the product of its
children's. The choice's probability mixes the estimates on the path with the
posterior weights of that mean; a path ends at the deepest node that training
reached. The tree is learnt from the training texts and then stays as it is.

Blocks of text send their distinct strings of DEPTH + 1 bytes with training
counts, dealt by the two nearest context bytes, so a bucket's task holds whole
trees below depth two. What depths zero and one need of them is summed up (at
most 256 * 255 rows), then each bucket answers the blocks' strings with log
probabilities. The word counts of the base model are exchanged in the same way.

Defined cases: a null text is empty and has its end only; a null id counts as an
empty text in the fold; repeated rows are scored each; without training texts
every bit has probability one half; an empty table gives no rows; columns other
than id and text are never looked at. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.blocks import (REPLY_SCHEMA, ask, by_bucket, messages, pack_ints, pack_keys,
                                   rows_of, unpack, unpack_ints, unpack_keys, with_replies,
                                   write_blocks)
from reviewlake.llm.storage import written, written_by
from reviewlake.llm.textbytes import (LOWER, Chunk, byte_prefix_hash, distinct, mix, owners, span_hash,
                                      words)

DEPTH = 5
#: Never a byte of UTF-8: the end of a text, and the context before its start.
END = 0xFF
FOLDS, HELD_OUT = 7, 2

#: Beyond this many possible strings, distinct ones are found by sorting.
_DIRECT = 1 << 25

TOP_SCHEMA = "near int, node int, zeros long, ones long, below double"
RESULT_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                 "base_score double, score double, n_bytes long, code_bits_per_byte double")


def held_out(ids: np.ndarray) -> np.ndarray:
    """Which ids are not learnt from."""
    return np.array([zlib.crc32(b"" if i == -(2 ** 63) else str(i).encode()) % FOLDS == HELD_OUT
                     for i in ids.tolist()], bool)


# -- strings of a block ----------------------------------------------------

@dataclass
class Strings:
    """A block's distinct strings, by bucket and reversed context, and their use."""

    keys: np.ndarray        # nearest context byte first, the coded byte last
    bounds: np.ndarray      # of the buckets
    which: np.ndarray       # per coded byte or end, the string
    ends: np.ndarray        # per text, the end of its coded bytes


def strings(chunk: Chunk, buckets: int, depth: int = DEPTH) -> Strings:
    n = len(chunk)
    size = np.diff(chunk.offs)
    stream = np.full(len(chunk.data) + n * (depth + 1), END, np.uint8)
    begin = chunk.offs[:-1] + np.arange(n) * (depth + 1) + depth
    coded = np.ones(len(stream), bool)
    for d in range(depth):
        coded[begin - 1 - d] = False
    is_text = coded.copy()
    is_text[begin + size] = False
    stream[is_text] = LOWER[chunk.data]

    present = np.flatnonzero(np.bincount(stream, minlength=256))
    symbol = np.zeros(256, np.int32)
    symbol[present] = np.arange(len(present))
    symbol = symbol[stream]
    number, key = symbol, present.astype(np.uint64)
    for level in range(1, depth + 1):
        possible = len(key) * len(present)
        longer = np.zeros(len(stream), np.int32 if possible <= _DIRECT else np.int64)
        np.multiply(number[:-1], len(present), out=longer[1:], casting="unsafe", dtype=longer.dtype)
        longer[1:] += symbol[1:]
        if level == depth:
            longer = longer[coded]
        if possible <= _DIRECT:
            used = np.zeros(possible, bool)
            used[longer] = True
            found = np.flatnonzero(used)
            place = np.zeros(possible, np.int32)
            place[found] = np.arange(len(found))
            number = place[longer]
        else:
            found, number = np.unique(longer, return_inverse=True)
        key = key[found // len(present)] << np.uint64(8) | present[found % len(present)].astype(np.uint64)
    near_first = key & np.uint64(0xFF)
    for d in range(depth):      # the nearest context byte becomes the highest
        near_first |= (key >> np.uint64(8 * (d + 1)) & np.uint64(0xFF)) << np.uint64(8 * (depth - d))
    bucket = bucket_of(near_first, buckets, depth)
    order = np.lexsort((near_first, bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return Strings(near_first[order], bounds, rank[number], np.cumsum(size + 1))


def bucket_of(keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    pair = keys >> np.uint64(8 * (depth - 1))
    return (mix(pair + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _strings_question(buckets: int, depth: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        ids, chunk = unpack(row)
        own = strings(chunk, buckets, depth)
        learnt = np.repeat(~held_out(ids), np.diff(chunk.offs) + 1)
        count = np.bincount(own.which[learnt], minlength=len(own.keys))
        for b in np.flatnonzero(np.diff(own.bounds)).tolist():
            here = slice(own.bounds[b], own.bounds[b + 1])
            yield b, pack_keys(own.keys[here]) + pack_ints(count[here])
    return question


# -- the trees of a bucket -------------------------------------------------

_SMALL = 256
_LOG_GAMMA_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_LOG_GAMMA_ONE = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _log_gamma(count: np.ndarray, plus: float, small: np.ndarray) -> np.ndarray:
    x = np.maximum(count, _SMALL) + plus
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(count < _SMALL, small[np.minimum(count, _SMALL - 1)], large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return (_log_gamma(zeros, 0.5, _LOG_GAMMA_HALF) + _log_gamma(ones, 0.5, _LOG_GAMMA_HALF)
            - _log_gamma(zeros + ones, 1.0, _LOG_GAMMA_ONE) - math.log(math.pi))


@dataclass
class Nodes:
    """The nodes of one depth whose choice has ``level`` bits behind it."""

    key: np.ndarray         # context bytes, nearest first, then the bits so far
    zeros: np.ndarray
    ones: np.ndarray
    stop: np.ndarray        # posterior weight of this node's own estimate
    weighted: np.ndarray    # natural log of the weighted probability


def _nodes(key: np.ndarray, count: np.ndarray, level: int, children: Nodes | None) -> Nodes:
    """key: context and byte, ascending and distinct."""
    node = key >> np.uint64(8 - level)
    one = (key >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
    ones = np.add.reduceat(count * one, start) if len(start) else count[:0]
    zeros = np.add.reduceat(count, start) - ones if len(start) else count[:0]
    node = node[start]
    own = log_kt(zeros, ones)
    if children is None:
        return Nodes(node, zeros, ones, np.ones(len(node)), own)
    bits = np.uint64((1 << level) - 1)
    parent = children.key >> np.uint64(level + 8) << np.uint64(level) | (children.key & bits)
    below = np.bincount(np.searchsorted(node, parent), weights=children.weighted, minlength=len(node))
    both = np.logaddexp(own, below)
    return Nodes(node, zeros, ones, np.exp(own - both), both - math.log(2))


def trees(key: np.ndarray, count: np.ndarray, depth: int) -> dict[tuple[int, int], Nodes]:
    """All nodes from ``depth`` up to depth two of a bucket's strings, which have counts."""
    found: dict[tuple[int, int], Nodes] = {}
    for d in range(depth, 1, -1):
        if d < depth:
            drop = np.uint64(8)
            shorter = key >> np.uint64(16) << drop | (key & np.uint64(0xFF))
            key, which = np.unique(shorter, return_inverse=True)
            count = np.bincount(which, weights=count, minlength=len(key)).astype(np.int64)
        for level in range(8):
            found[d, level] = _nodes(key, count, level, found.get((d + 1, level)))
    return found


def _merged(bodies: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The bodies' keys, all distinct keys, and their total counts."""
    keys, counts = [], []
    for body in bodies:
        k, rest = unpack_keys(body)
        keys.append(k)
        counts.append(unpack_ints(rest, len(k)))
    every, _, which = distinct(np.concatenate(keys))
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    return keys, every, total


def _top_of_bucket(depth: int):
    """Sums over a bucket's contexts of depth two, by the nearest byte and choice."""
    def run(group: pa.Table) -> pa.Table:
        _, key, count = _merged(group.column("body").to_pylist())
        found = trees(key[count > 0], count[count > 0], depth)
        parts = []
        for level in range(8):
            nodes = found[2, level]
            node = (nodes.key & np.uint64((1 << level) - 1)).astype(np.int64) + (1 << level)
            near = (nodes.key >> np.uint64(level + 8)).astype(np.int64)
            parts.append((near, node, nodes.zeros, nodes.ones, nodes.weighted))
        near, node, zeros, ones, below = (np.concatenate(x) for x in zip(*parts, strict=True))
        both, which = np.unique(near << 8 | node, return_inverse=True)
        add = lambda x: np.bincount(which, weights=x, minlength=len(both))
        return pa.table({
            "near": pa.array((both >> 8).astype(np.int32)), "node": pa.array((both & 255).astype(np.int32)),
            "zeros": pa.array(add(zeros).astype(np.int64)), "ones": pa.array(add(ones).astype(np.int64)),
            "below": pa.array(add(below).astype(np.float64))})
    return run


@dataclass
class Top:
    """Depths one (rows 0-255, by the nearest byte) and zero (row 256): counts and
    stop weights by choice."""

    zeros: np.ndarray
    ones: np.ndarray
    stop: np.ndarray


def _top(rows: list) -> Top:
    zeros, ones = np.zeros((257, 256), np.int64), np.zeros((257, 256), np.int64)
    below = np.zeros((257, 256))
    for r in rows:
        zeros[r["near"], r["node"]], ones[r["near"], r["node"]] = r["zeros"], r["ones"]
        below[r["near"], r["node"]] = r["below"]
    zeros[256], ones[256] = zeros[:256].sum(0), ones[:256].sum(0)
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, below)
    weighted = np.where(zeros + ones > 0, both - math.log(2), 0.0)
    below[256] = weighted[:256].sum(0)
    both[256] = np.logaddexp(own[256], below[256])
    return Top(zeros, ones, np.exp(own - both))


def log10_probabilities(asked: np.ndarray, found: dict[tuple[int, int], Nodes], top: Top,
                        depth: int) -> np.ndarray:
    """log10 of the probability of the last byte of each asked string (ascending)."""
    total = np.zeros(len(asked))
    shorter = {depth: (asked, None)}
    key = asked
    for d in range(depth - 1, 1, -1):
        short = key >> np.uint64(16) << np.uint64(8) | (key & np.uint64(0xFF))
        key, which = np.unique(short, return_inverse=True)
        above = shorter[d + 1][1]
        shorter[d] = (key, which if above is None else which[above])
    near = (asked >> np.uint64(8 * depth)).astype(np.int64)
    byte = (asked & np.uint64(0xFF)).astype(np.int64)
    for level in range(8):
        q = np.full(len(asked), np.nan)
        for d in range(depth, 1, -1):
            key, which = shorter[d]
            nodes = found[d, level]
            if not len(nodes.key):
                continue
            node = key >> np.uint64(8 - level)
            at = np.minimum(np.searchsorted(nodes.key, node), len(nodes.key) - 1)
            there = nodes.key[at] == node
            one = (key >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            own = (np.where(one, nodes.ones[at], nodes.zeros[at]) + 0.5) / (
                nodes.ones[at] + nodes.zeros[at] + 1.0)
            stop = nodes.stop[at]
            if which is not None:
                there, own, stop = there[which], own[which], stop[which]
            q = np.where(there, np.where(np.isnan(q), own, stop * own + (1 - stop) * q), q)
        node = (byte >> (8 - level)) + (1 << level)
        one = (byte >> (7 - level) & 1).astype(bool)
        for row in (near, 256):
            n1, n0, stop = top.ones[row, node], top.zeros[row, node], top.stop[row, node]
            own = (np.where(one, n1, n0) + 0.5) / (n1 + n0 + 1.0)
            mixed = np.where(np.isnan(q), own, stop * own + (1 - stop) * q)
            q = np.where(n0 + n1 > 0, mixed, q)
        total += np.log10(np.where(np.isnan(q), 0.5, q))
    return total


def _string_answers(depth: int, shared):
    def run(group: pa.Table) -> pa.Table:
        keys, every, count = _merged(group.column("body").to_pylist())
        found = trees(every[count > 0], count[count > 0], depth)
        answer = log10_probabilities(every, found, shared.value, depth).astype(np.float32)
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"),
            "body": pa.array([answer[np.searchsorted(every, k)].tobytes() for k in keys], pa.binary())})
    return run


# -- words of the base model -----------------------------------------------

def _word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    lowered = Chunk(0, LOWER[chunk.data], chunk.offs)
    starts, ends, bounds = words(lowered)
    return span_hash(byte_prefix_hash(lowered.data), starts, ends), bounds


def _words_question(buckets: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        ids, chunk = unpack(row)
        word, bounds = _word_hashes(chunk)
        key = np.unique(word)
        learnt = np.sort(word[~held_out(ids)[owners(bounds)]])
        count = np.searchsorted(learnt, key, "right") - np.searchsorted(learnt, key)
        bound = by_bucket(key, buckets)
        for b in np.flatnonzero(np.diff(bound)).tolist():
            here = slice(bound[b], bound[b + 1])
            yield b, pack_keys(key[here]) + pack_ints(count[here])
    return question


def _words_answer(bodies: list[bytes]) -> list[bytes]:
    """Total training counts of each block's words; the note: tokens and distinct words."""
    keys, every, total = _merged(bodies)
    note = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
    return [*(pack_ints(total[np.searchsorted(every, k)]) for k in keys), note]


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        tokens, types = np.frombuffer(row["body"], np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([types])], ["n", "v"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        n = int((~held_out(np.frombuffer(row["doc_ids"], np.int64))).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])


# -- the operator ----------------------------------------------------------

def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                depth: int = DEPTH) -> DataFrame:
    """One row per document with the base model's and the tree's log10 probability."""
    blocks = write_blocks(docs, id_col=id_col, text_col=text_col)
    buckets, spark = blocks.buckets, docs.sparkSession
    texts = blocks.frame.select("block", "doc_ids", "offs", "data")

    counts = ask(texts, _words_question(buckets), _words_answer, "word-counts")
    totals = (counts.where("block = -1").mapInArrow(_notes, "n long, v long")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first())
    ends = texts.select("doc_ids").mapInArrow(_ends, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    tokens = (totals["n"] or 0) + ends
    norm = tokens + (totals["v"] or 0) + (ends > 0) + 1

    # Dealt by bucket once; both passes over the buckets then read them in place.
    sent = written_by(messages(texts, _strings_question(buckets, depth)), "bucket", blocks.parts, "strings")
    top = _top(sent.groupBy("bucket").applyInArrow(_top_of_bucket(depth), TOP_SCHEMA)
               .groupBy("near", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
               .collect())          # at most 256 * 255 rows
    shared = spark.sparkContext.broadcast(top)
    answers = written(sent.groupBy("bucket").applyInArrow(_string_answers(depth, shared), REPLY_SCHEMA),
                      "string-scores")
    frame = with_replies(with_replies(texts, blocks, answers, "answers"), blocks, counts, "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, chunk = unpack(row)
            own = strings(chunk, buckets, depth)
            value = np.zeros(len(own.keys), np.float32)
            for r in row["answers"] or []:
                value[own.bounds[r["bucket"]]:own.bounds[r["bucket"] + 1]] = np.frombuffer(r["body"], np.float32)
            total = np.cumsum(value[own.which], dtype=np.float64)
            score = np.diff(total[own.ends - 1], prepend=0.0)

            word, bounds = _word_hashes(chunk)
            key, _, which = distinct(word)
            bound = by_bucket(key, buckets)
            count = np.zeros(len(key), np.int64)
            for r in row["counts"] or []:
                here = slice(bound[r["bucket"]], bound[r["bucket"] + 1])
                count[here] = unpack_ints(r["body"], here.stop - here.start)
            per_word = np.concatenate(([0.0], np.cumsum(np.log10((count + 1) / norm)[which])))
            known = np.concatenate(([0], np.cumsum((count > 0)[which])))
            base = per_word[bounds[1:]] - per_word[bounds[:-1]] + math.log10((ends + 1) / norm)
            size = np.diff(chunk.offs)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=ids == -(2 ** 63)), pa.array(held_out(ids)),
                pa.array(np.diff(bounds) + 1), pa.array(known[bounds[1:]] - known[bounds[:-1]] + (ends > 0)),
                pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base), pa.array(score),
                pa.array(size), pa.array(-score / math.log10(2) / np.maximum(size, 1))],
                [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return frame.mapInArrow(run, RESULT_SCHEMA)
