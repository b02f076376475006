"""Removal of repeated byte strings by a blockwise suffix sort (operator 5).

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id. The suffixes are sorted to a depth of ``width``
bytes, bucket by bucket, with the help of a difference cover:

1. The cover sample. Positions whose remainder modulo 21 is in a difference
   cover of 21 are sampled (5 of 21), each named by its next 30 bytes. For any
   two positions one shift below 21 takes both into the cover, so two suffixes
   that tie for 50 bytes have a sampled position in common, within their first
   21, that ties for 30 bytes. The names are ranked bucket by bucket, and a
   block learns which of its sampled positions tie with another at all.
2. The suffix buckets. Only suffixes that follow a tied sample can tie for 50
   bytes; all others are settled by the sample and are never sorted. The rest are
   named by their 50 bytes and sorted one bucket of names at a time; within a
   name the smallest document id decides, and a block learns per name whether a
   smaller one than its own exists.
3. Each block marks its bytes.

Before the first step equal whole texts are told apart: only that with the
smallest id takes part, the others go whole if they have ``width`` bytes.

The order is that of 64-bit names, not of the alphabet: equal prefixes are
neighbours in either. A task holds one bucket (a fixed share of the text) or one
block; a string that a third of all documents share is one entry per block.
Two different strings of 50 bytes have the same name with a chance of 2**-64.

Defined cases: a null text is empty; texts shorter than ``width`` stay whole; of
rows with equal ids none removes the other's bytes; a null id is smaller than
all others; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.blocks import (Blocks, ask, bits, by_bucket, carried, member, pack_ints,
                                   pack_keys, rows_of, same_in_two, unbits, unpack, unpack_ints,
                                   unpack_keys, with_replies, write_blocks)
from reviewlake.llm.textbytes import Chunk, byte_prefix_hash, distinct, mix, span_hash, spans

WIDTH = 50
MODULUS = 21
#: Every remainder modulo 21 is a difference of two of these.
COVER = (3, 6, 7, 12, 14)
SAMPLE_WIDTH = WIDTH - MODULUS + 1

#: Entries of the table in which a block looks up its tied samples.
_TABLE_BITS = 24

RESULT_SCHEMA = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                 "starts array<long>, ends array<long>")


class _Block:
    """A block's texts with the names that the steps exchange."""

    def __init__(self, row: dict, n_bytes: int) -> None:
        ids, chunk = unpack(row)
        self.copy = _copies(row)
        if self.copy.any():
            live = ~self.copy
            size = np.diff(chunk.offs)
            ids = ids[live]
            chunk = Chunk(0, chunk.data[np.repeat(live, size)],
                          np.concatenate(([0], np.cumsum(size[live]))))
        self.ids, self.chunk = ids, chunk
        self.prefix = byte_prefix_hash(chunk.data)
        #: Sample names keep as many bits as the size of the corpus asks for: a tie by
        #: chance only sends one more suffix to the sort.
        self.unused = np.uint64(max(0, 64 - (max(n_bytes, 1).bit_length() + 9)))

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions, ascending, and their names."""
        offs = self.chunk.offs
        last = np.diff(offs) - SAMPLE_WIDTH          # a text's last place with a name
        turns = np.maximum(last // MODULUS + 1, 0)   # of the cover
        text = np.repeat(np.arange(len(turns), dtype=np.int32), turns)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(turns) - turns, turns)
        place = (turn * MODULUS)[:, None] + np.array(COVER)
        at = (place + offs[text][:, None])[place <= last[text][:, None]]
        name = span_hash(self.prefix, at, at + SAMPLE_WIDTH)
        return at, name >> self.unused << self.unused

    def suffixes(self, replies: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the suffixes that may tie, by document id, and their names."""
        at, name = self.sample()
        every = np.sort(name)
        again = every[1:] == every[:-1]
        own = every[np.append(True, ~again)] if len(every) else every
        bound = by_bucket(own, buckets)
        tied = [every[1:][again]]
        for r in replies or []:
            here = own[bound[r["bucket"]]:bound[r["bucket"] + 1]]
            tied.append(here[unbits(r["body"], len(here))])
        table = np.zeros(1 << _TABLE_BITS, bool)
        shift = np.uint64(64 - _TABLE_BITS)
        table[np.concatenate(tied) >> shift] = True
        ties = np.zeros(len(self.chunk.data) + 1, np.int32)
        ties[at + 1] = table[name >> shift]
        np.cumsum(ties, out=ties)
        offs, n = self.chunk.offs, len(self.chunk.data)
        # The last WIDTH - 1 places of a text start no suffix of that length.
        short = np.zeros(n + 1, np.int8)
        np.add.at(short, np.maximum(offs[1:] - WIDTH + 1, offs[:-1]), 1)
        np.add.at(short, offs[1:], -1)
        may = np.cumsum(short, dtype=np.int8)[:n] == 0
        may[:max(n - MODULUS + 1, 0)] &= ties[MODULUS:] > ties[:n + 1 - MODULUS]
        first = np.flatnonzero(may)
        if np.any(self.ids[1:] < self.ids[:-1]):
            rank = np.argsort(np.argsort(self.ids, kind="stable"))
            first = first[np.argsort(rank[self.text_of(first)], kind="stable")]
        return first, span_hash(self.prefix, first, first + WIDTH)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.chunk), dtype=np.int32), np.diff(self.chunk.offs))[at]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[self.text_of(at)]


def _copies(row: dict) -> np.ndarray:
    """Which texts of a block equal one with a smaller id, from the replies."""
    keys = np.frombuffer(row["keys"], np.int64)
    out = np.zeros(len(keys), bool)
    bucket, order = _text_buckets(keys, row["text_buckets"])
    for r in row["copies"] or []:
        own = order[bucket[r["bucket"]]:bucket[r["bucket"] + 1]]
        out[own] = unbits(r["body"], len(own))
    return out


def _text_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets in the ascending order of the texts' keys."""
    spread = mix(keys.view(np.uint64))
    order = np.argsort(spread, kind="stable")
    return by_bucket(spread[order], buckets), order


def _texts_question(row: dict) -> Iterator[tuple[int, bytes]]:
    keys, ids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["doc_ids"], np.int64)
    bound, order = _text_buckets(keys, row["text_buckets"])
    for b in np.flatnonzero(np.diff(bound)).tolist():
        own = order[bound[b]:bound[b + 1]]
        yield b, keys[own].tobytes() + ids[own].tobytes()


def _texts_answer(bodies: list[bytes]) -> list[bytes | None]:
    both = [np.frombuffer(b, np.int64).reshape(2, -1) for b in bodies]
    every = np.concatenate(both, axis=1)
    _, which = np.unique(every[0], return_inverse=True)
    least = np.full(which.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, every[1])
    later = every[1] > least[which]
    found = np.split(later, np.cumsum([x.shape[1] for x in both])[:-1])
    return [bits(f) if f.any() else None for f in found]


def _samples_question(n_bytes: int, buckets: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        block = _Block(row, n_bytes)
        names = np.unique(block.sample()[1])
        bound = by_bucket(names, buckets)
        for b in np.flatnonzero(np.diff(bound)).tolist():
            yield b, pack_keys(names[bound[b]:bound[b + 1]] >> block.unused)
    return question


def _samples_answer(bodies: list[bytes]) -> list[bytes | None]:
    names = [unpack_keys(b)[0] for b in bodies]
    ties = same_in_two(names)
    found = [member(ties, n) for n in names]
    return [bits(f) if f.any() else None for f in found]


def _suffix_question(n_bytes: int, buckets: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        block = _Block(row, n_bytes)
        at, name = block.suffixes(row["ties"], buckets)
        names, first, _ = distinct(name)
        doc = block.doc_of(at[first])
        bound = by_bucket(names, buckets)
        for b in np.flatnonzero(np.diff(bound)).tolist():
            here = slice(bound[b], bound[b + 1])
            yield b, pack_keys(names[here]) + pack_ints(doc[here])
    return question


def _suffix_answer(bodies: list[bytes]) -> list[bytes | None]:
    """Per name of each block, whether a document before the block's first has it."""
    names, docs = [], []
    for body in bodies:
        name, rest = unpack_keys(body)
        names.append(name)
        docs.append(unpack_ints(rest, len(name)))
    every, doc = np.concatenate(names), np.concatenate(docs)
    order = np.argsort(every)
    every, doc = every[order], doc[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(every))))
    earlier = np.empty(len(every), bool)
    earlier[order] = least < doc
    found = np.split(earlier, np.cumsum([len(n) for n in names])[:-1])
    return [bits(f) if f.any() else None for f in found]


def _removed(row: dict, n_bytes: int, buckets: int) -> tuple[np.ndarray, Chunk, np.ndarray]:
    """Ids, texts, and which bytes go."""
    block = _Block(row, n_bytes)
    at, name = block.suffixes(row["ties"], buckets)
    names, first, which = distinct(name)
    doc = block.doc_of(at)
    bound = by_bucket(names, buckets)
    elsewhere = np.zeros(len(names), bool)
    for r in row["earlier"] or []:
        here = slice(bound[r["bucket"]], bound[r["bucket"] + 1])
        elsewhere[here] = unbits(r["body"], here.stop - here.start)
    gone = at[elsewhere[which] | (doc > doc[first][which])]
    n = len(block.chunk.data)
    edge = np.bincount(gone, minlength=n + WIDTH + 1) - np.bincount(gone + WIDTH, minlength=n + WIDTH + 1)
    covered = np.cumsum(edge)[:n] > 0
    ids, chunk = unpack(row)
    size = np.diff(chunk.offs)
    every = np.repeat(block.copy & (size >= WIDTH), size)
    every[np.repeat(~block.copy, size)] = covered
    return ids, chunk, every


def _settled(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, Blocks]:
    """Blocks with both kinds of replies."""
    blocks = write_blocks(docs, id_col=id_col, text_col=text_col, carry=carry)
    n_bytes, buckets = blocks.n_bytes, blocks.buckets
    text_buckets = max(1, n_bytes >> 28)
    frame = blocks.frame.withColumn("text_buckets", F.lit(text_buckets))
    copies = ask(frame.select("block", "doc_ids", "keys", "text_buckets"),
                 _texts_question, _texts_answer, "copies")
    frame = with_replies(frame, blocks, copies, "copies")
    texts = frame.drop("rest")
    ties = ask(texts, _samples_question(n_bytes, buckets), _samples_answer, "cover-ties")
    tied = with_replies(texts, blocks, ties, "ties")
    earlier = ask(tied, _suffix_question(n_bytes, buckets), _suffix_answer, "suffix-ties")
    both = with_replies(with_replies(frame, blocks, ties, "ties"), blocks, earlier, "earlier")
    return both, blocks


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, removed runs (byte offsets), hash of what is kept."""
    frame, blocks = _settled(docs, id_col, text_col, carry=False)
    n_bytes, buckets = blocks.n_bytes, blocks.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, chunk, gone = _removed(row, n_bytes, buckets)
            starts, ends, bound = spans(gone, chunk.offs)
            kept = chunk.data[~gone]
            kept_offs = np.concatenate(([0], np.cumsum(chunk.sums(~gone))))
            digest = [hashlib.sha256(kept[kept_offs[i]:kept_offs[i + 1]]).hexdigest()
                      for i in range(len(chunk))]
            begin = np.repeat(chunk.offs[:-1], np.diff(bound))
            lists = pa.array(bound.astype(np.int32))
            id_array = pa.array(ids, pa.int64(), mask=ids == -(2 ** 63))
            yield pa.RecordBatch.from_arrays([
                id_array, pa.array(np.diff(chunk.offs)), pa.array(chunk.sums(gone)),
                pa.array(np.diff(bound)), pa.array(digest, pa.string()),
                pa.ListArray.from_arrays(lists, pa.array(starts - begin)),
                pa.ListArray.from_arrays(lists, pa.array(ends - begin))],
                [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return frame.mapInArrow(run, RESULT_SCHEMA)


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                length_col: str | None = None) -> DataFrame:
    """The documents with the repeated bytes cut out of their text, all columns kept.

    A character of which a byte goes is cut whole. ``length_col`` gets the new
    text's length in characters.
    """
    frame, blocks = _settled(docs, id_col, text_col, carry=True)
    n_bytes, buckets, columns = blocks.n_bytes, blocks.buckets, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, chunk, gone = _removed(row, n_bytes, buckets)
            offs = np.concatenate(([0], np.cumsum(chunk.sums(~gone))))
            kept = chunk.data[~gone]
            texts = [kept[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "ignore")
                     for i in range(len(chunk))]
            others = carried(row)
            arrays = []
            for i, name in enumerate(columns):
                if name == text_col:
                    arrays.append(pa.array(texts, pa.string()))
                elif name == length_col:
                    arrays.append(pa.array([len(t) for t in texts]).cast(others.column(i).type))
                else:
                    arrays.append(others.column(i).combine_chunks())
            yield from pa.table(arrays, names=columns).to_batches()

    return frame.mapInArrow(run, docs.schema)
