"""Bulk-synchronous best-fit packing of tokenised documents (operator 7).

Documents are cut into pieces, range-sorted by length and ranked within their
length. A superstep takes the documents of one length, longest first, and sweeps
the gaps upward from their successor, the smallest gap that holds them: the r-th
document goes to the r-th place, so two documents never meet in one place, and
the sequences move to their new gap. As documents of one length, and sequences
with one gap, are interchangeable, a superstep is decided on counts per size
(at most ``capacity`` of them); the rows find their places by rank in the tasks.

Defined cases: a null text is an empty document of one token, the end token;
repeated ids and rows are packed as separate documents; an empty table gives no
rows; columns other than id and text are never looked at. A text is encoded as
a whole in memory, whatever its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.storage import written
from reviewlake.llm.textbytes import chunks
from reviewlake.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document; only the first piece of a longer one may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                ids, offs = own.encode(chunk)
                out: list[list[int]] = [[] for _ in range(5)]
                for i in range(len(chunk)):
                    full = np.append(ids[offs[i]:offs[i + 1]], np.uint32(end_id)).astype("<u4")
                    number = -(-len(full) // capacity)
                    head = len(full) - (number - 1) * capacity
                    for k in range(number):
                        a = head + (k - 1) * capacity if k else 0
                        b = head + k * capacity
                        row = (chunk.first + i, k, a, b - a, zlib.crc32(full[a:b].tobytes()))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                     *(pa.array(x, pa.int64()) for x in out[2:])],
                    [x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Supersteps over the lengths, longest first; counts: documents per length.

    Returns moves (length, rank from, rank to, first sequence, documents per
    sequence, offset): documents of that length with these ranks go, ``documents
    per sequence`` to each, to the sequences numbered on from the first.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)    # gap: runs of sequences
    sizes: list[int] = []                                           # gaps in use, ascending
    opened = 0
    moves = []

    def put(gap: int, first: int, number: int) -> None:
        if number and gap:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect.bisect_left(sizes, length)          # the successor
            if at == len(sizes):
                number = -(-(total - rank) // (capacity // length))
                put(capacity, opened, number)
                opened += number
                continue
            gap = sizes[at]
            first, number = gaps[gap].popleft()
            if not gaps[gap]:
                sizes.pop(at)
            each = min(gap // length, total - rank)
            taken = min(number, (total - rank) // each)
            moves.append((length, rank, rank + taken * each, first, each, capacity - gap))
            rank += taken * each
            put(gap - each * length, first, taken)
            if taken < number:      # the rest keeps its gap, and stays in front
                if not gaps[gap]:
                    bisect.insort(sizes, gap)
                gaps[gap].appendleft((first + taken, number - taken))
    return np.array(moves, np.int64).reshape(-1, 6)


def ranked(rows: DataFrame) -> DataFrame:
    """Range-sort pieces by length and number them within their length."""
    ordered = written(
        rows.repartitionByRange("length", "doc_id", "piece", "ids_crc32")
            .sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
            .withColumn("part", F.spark_partition_id())
            .withColumn("row", F.monotonically_increasing_id()), "packing-ranked")
    runs = ordered.groupBy("length", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(
        _window("length").orderBy("part").rowsBetween(_unbounded(), -1))
    # Ranges are disjoint but for their ends: at most capacity + partitions runs.
    runs = runs.select("length", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return (ordered.join(F.broadcast(runs), ["length", "part"])
            .withColumn("rank", F.col("row") + F.col("shift")).drop("part", "row", "shift"))


def _window(*keys: str):
    from pyspark.sql import Window
    return Window.partitionBy(*keys)


def _unbounded() -> int:
    from pyspark.sql import Window
    return Window.unboundedPreceding


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    rows = ranked(written(cut, "pieces"))       # sampling for the ranges reads them as well
    counts = {r["length"]: r["n"] for r in                   # at most capacity rows
              rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = sweep(counts, capacity)
    order = np.lexsort((moves[:, 1], moves[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(moves[order])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # One ascending key of length and rank; ranks stay below 2**48.
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            move = table[np.searchsorted(key, (length << 48) + rank, "right") - 1] \
                if len(table) else np.zeros((0, 6), np.int64)
            behind = rank - move[:, 1]
            sequence = move[:, 3] + behind // move[:, 4]
            offset = move[:, 5] + behind % move[:, 4] * length
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, RESULT_SCHEMA)
