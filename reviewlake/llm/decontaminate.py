"""Benchmark decontamination by a BM25 index of test items with block-max pruning (operator 2).

The test items are the indexed documents, the training passages the queries. An
item is its words (A-Z lower-cased, split at ASCII white space, punctuation at
the ends of words dropped); its question is all but its last sentence, its answer the
last sentence (an item of one sentence is all question). A passage is a run of
2 * s words starting at a multiple of s, s being the longest item's length, so an
item that a text holds lies whole in one of its passages.

An item can be verified only if enough of its words are in the passage; the
retrieval threshold of an item is the BM25 score that then remains when the
words of highest impact are the missing ones, so it loses no verifiable item.
Pruning is that of block-max WAND, for all passages of a chunk at once: a passage
goes on if the sum of its terms' greatest impacts reaches the lowest threshold,
then only with the item blocks where the sum of the terms' block maxima does,
and only there items are scored. Candidates are verified on word order: of the
item's question, and of its answer, at least ``SIMILARITY`` of the runs of five
words (a shorter part: the part itself) must stand in the passage.

Items are indexed in shards of at most ``SHARD_ITEMS``, so what a task holds does
not grow with the benchmark; every document is compared with every shard.

Defined cases: null texts and texts or items without words match nothing; an item
without an id is an item like others, reported under a null; items of equal text are
reported each; documents are dropped by their text (a 64-bit hash of it), whatever their
ids; repeated documents are reported each; an empty
table on either side gives no rows; columns other than the named are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.storage import written
from reviewlake.llm.textbytes import (LOWER, WHITE, Chunk, byte_prefix_hash, chunks, owners,
                                      prefix_hash, span_hash, spans)

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Items of a block, whose greatest impact per term is kept.
BLOCK_ITEMS = 16
SHARD_ITEMS = 1024

_SEPARATOR = WHITE.copy()
_SEPARATOR[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

RESULT_SCHEMA = ("doc_id long, item_id long, passage_word long, bm25 double, threshold double, "
                 "question_overlap double, answer_overlap double")


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and the texts' bounds. Runs of ASCII
    punctuation separate words as white space does."""
    data = LOWER[chunk.data]
    starts, ends, bounds = spans(~_SEPARATOR[data], chunk.offs)
    return span_hash(byte_prefix_hash(data), starts, ends), bounds


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    question: np.ndarray        # hashes of its runs of five words, or of itself
    answer: np.ndarray
    least_terms: int            # distinct terms that a verified passage surely has


def _runs(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(words)
    first = np.arange(max(1, len(words) - SHINGLE_WORDS + 1))
    return np.unique(span_hash(prefix, first, np.minimum(first + SHINGLE_WORDS, len(words))))


def _item(item_id: int, text: str) -> Item | None:
    parts = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text)
    parts = [p for p in parts if len(_words(p))]
    whole = _words(text)
    if not len(whole):
        return None
    question, answer = ("".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")
    q, a = _words(question), _words(answer)
    if len(a) < SHINGLE_WORDS or len(q) < SHINGLE_WORDS:
        q, a = whole, whole[:0]     # a part too short to tell by itself
    missing = 0
    for part in (q, a):
        runs = _runs(part)
        # Each word that is nowhere in the passage breaks at least one run.
        missing += len(runs) - math.ceil(SIMILARITY * len(runs) - 1e-9)
    return Item(item_id, whole, _runs(q), _runs(a), len(np.unique(whole)) - missing)


def _words(text: str) -> np.ndarray:
    for chunk in chunks(pa.array([text])):
        return terms(chunk)[0]
    return np.zeros(0, np.uint64)


class Index:
    """Inverted index of one shard of items: impacts, block maxima, thresholds."""

    def __init__(self, items: list[Item], df: dict[int, int], n_items: int, mean_words: float) -> None:
        items = sorted(items, key=lambda i: (i.item_id is not None, i.item_id or 0))
        self.items = items
        self.terms = np.unique(np.concatenate([i.words for i in items]))
        idf = np.array([math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in self.terms.tolist()])
        self.threshold = np.zeros(len(items), np.float32)
        # Postings by item; a row is an item's impact per term.
        self.by_item = np.zeros((len(items), len(self.terms)), np.float32)
        for number, item in enumerate(items):
            term, tf = np.unique(item.words, return_counts=True)
            at = np.searchsorted(self.terms, term)
            norm = K1 * (1 - B + B * len(item.words) / mean_words)
            impact = idf[at] * tf * (K1 + 1) / (tf + norm)
            self.by_item[number, at] = impact
            self.threshold[number] = np.sort(impact)[:max(item.least_terms, 1)].sum()
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.stack([self.by_item[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].max(axis=0)
                                   for b in range(blocks)], axis=1)
        self.term_max = self.block_max.max(axis=1)
        self.block_least = np.array([self.threshold[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].min()
                                     for b in range(blocks)])
        self.lookup_bits = max(12, int(len(self.terms) * 16).bit_length())
        self.maybe = np.zeros(1 << self.lookup_bits, bool)
        self.maybe[self.terms >> np.uint64(64 - self.lookup_bits)] = True

    def numbers(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are indexed terms, and the terms' numbers."""
        place = np.flatnonzero(self.maybe[word >> np.uint64(64 - self.lookup_bits)])
        at = np.minimum(np.searchsorted(self.terms, word[place]), len(self.terms) - 1)
        real = self.terms[at] == word[place]
        return place[real], at[real]

    def matches(self, word: np.ndarray, bounds: np.ndarray, stride: int):
        """Verified matches: text, item number, passage's first word, score, overlaps."""
        place, term = self.numbers(word)
        text = np.searchsorted(bounds, place, "right") - 1
        cell = (place - bounds[text]) // stride
        # Cells of all texts numbered on; a passage is a cell and the next of its text.
        cells = -(-np.diff(bounds) // stride)
        base = np.concatenate(([0], np.cumsum(cells)))
        cell = cell + base[text]
        # A term counts once per cell.
        once = np.unique(cell * len(self.terms) + term)
        cell, term = once // len(self.terms), once % len(self.terms)
        top = np.bincount(cell, weights=self.term_max[term], minlength=base[-1] + 1)
        follows = np.zeros(base[-1] + 1, bool)
        follows[:-1] = True
        follows[base[1:] - 1] = False
        bound = top + np.where(follows, np.append(top[1:], 0.0), 0.0)
        alive = np.zeros(base[-1] + 1, bool)
        alive[:-1] = bound[:-1] >= self.block_least.min() - 1e-3
        for b in range(len(self.block_least)):
            for p, h in self._block_hits(b, alive, cell, term, follows):
                i = int(np.searchsorted(base, p, "right")) - 1
                first = (p - int(base[i])) * stride
                passage = word[bounds[i] + first:min(bounds[i] + first + 2 * stride, bounds[i + 1])]
                own = term[np.searchsorted(cell, p):np.searchsorted(cell, p + 1 + follows[p])]
                score = float(self.by_item[h, np.unique(own)].sum())
                if score < self.threshold[h] - 1e-3:
                    continue
                item, prefix = self.items[h], prefix_hash(passage)
                q, a = _overlap(item.question, prefix, item), _overlap(item.answer, prefix, item)
                if min(q, a) >= SIMILARITY - 1e-9:
                    yield i, h, first, score, q, a

    def _block_hits(self, b: int, alive: np.ndarray, cell: np.ndarray, term: np.ndarray,
                    follows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Passages and items of a block whose scores may reach the items' thresholds."""
        def passage_sums(impact: np.ndarray, passages: np.ndarray) -> np.ndarray:
            need = passages.copy()
            need[1:] |= passages[:-1] & follows[:-1]
            rows = need[cell]
            c, t = cell[rows], term[rows]
            start = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
            total = np.zeros((len(passages) + 1, impact.shape[1]), np.float32)
            if len(c):
                total[c[start]] = np.add.reduceat(impact[t], start, axis=0)
            return total[:-1] + np.where(follows[:, None], total[1:], np.float32(0))

        bound = passage_sums(self.block_max[:, b:b + 1], alive)[:, 0]
        go = alive & (bound >= self.block_least[b] - 1e-3)
        if not go.any():
            return
        items = slice(b * BLOCK_ITEMS, (b + 1) * BLOCK_ITEMS)
        score = passage_sums(np.ascontiguousarray(self.by_item[items].T), go)
        hit = go[:, None] & (score >= self.threshold[items] - 1e-3)
        for p, h in np.argwhere(hit).tolist():
            yield p, h + b * BLOCK_ITEMS


def _overlap(runs: np.ndarray, prefix: np.ndarray, item: Item) -> float:
    """Share of the runs that stand in the passage; 1 for a part without runs."""
    if not len(runs):
        return 1.0
    width = min(SHINGLE_WORDS, len(item.words))
    first = np.arange(max(0, len(prefix) - width))
    return float(np.isin(runs, span_hash(prefix, first, first + width)).mean())


def build_shards(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text",
                 shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, int]:
    """The items with their shard number, written, and the number of shards."""
    named = items.select(F.col(item_col).cast("long").alias("item_id"),
                         F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    n = named.count()
    shards = max(1, -(-n // shard_items))
    return written(named.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")),
                   "items"), shards


def find_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds, with the best passage."""
    named, shards = build_shards(items, item_col=item_col, text_col=item_text_col)

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                word, bounds = terms(chunk)
                text = owners(bounds)
                pair = np.unique(np.stack([text.astype(np.uint64), word]), axis=1)[1] if len(word) else word
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair.view(np.int64)), pa.array(np.full(len(pair), False)),
                     pa.array(np.zeros(len(pair), np.int64))], ["term", "item", "words"])
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(size), np.int64)), pa.array(np.full(len(size), True)),
                     pa.array(size)], ["term", "item", "words"])

    parsed = written(named.select("text").mapInArrow(item_terms, "term long, item boolean, words long"),
                     "item-terms")
    size = parsed.where("item and words > 0").agg(F.count("*").alias("n"), F.avg("words").alias("mean"),
                                                  F.max("words").alias("most")).first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_items, mean, stride = size["n"], size["mean"] or 1.0, int(size["most"] or 1)
    frequency = parsed.where("not item").groupBy("term").agg(F.count("*").alias("df"))
    found = None
    for shard in range(shards):
        # One shard: at most about SHARD_ITEMS items and their terms.
        own = [_item(r["item_id"], r["text"]) for r in named.where(F.col("shard") == shard).collect()]
        own = [i for i in own if i is not None]
        if not own:
            continue
        have = docs.sparkSession.createDataFrame(
            [(int(t),) for t in np.unique(np.concatenate([i.words for i in own])).view(np.int64)], "term long")
        df = {r["term"] & (2 ** 64 - 1): r["df"] for r in frequency.join(have, "term").collect()}
        part = _search(rows, Index(own, df, n_items, mean), stride)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], RESULT_SCHEMA)


def _search(rows: DataFrame, index: Index, stride: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                word, bounds = terms(chunk)
                best: dict[tuple[int, int], tuple] = {}
                for i, h, first, score, q, a in index.matches(word, bounds, stride):
                    row = (q + a, score, -first)
                    if (i, h) not in best or row > best[i, h][0]:
                        best[i, h] = (row, first, score, q, a)
                if not best:
                    continue
                keys = sorted(best)
                ids = batch.column(0).take(pa.array([chunk.first + i for i, _ in keys]))
                rest = list(zip(*(best[k][1:] for k in keys), strict=True))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([index.items[h].item_id for _, h in keys], pa.int64()),
                    pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.float64()),
                    pa.array([float(index.threshold[h]) for _, h in keys], pa.float64()),
                    pa.array(rest[2], pa.float64()), pa.array(rest[3], pa.float64())],
                    [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return rows.mapInArrow(run, RESULT_SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    # Told by the text: rows that share an id, or have none, are judged one by one.
    name = "_hit"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hit = written(find_contaminated(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), items,
                                    id_col="_key", text_col="_text")
                  .select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, key).join(hit, name, "left_anti").select(*docs.columns)
