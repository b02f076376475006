"""Questions that blocks of text put to the corpus, answered per key bucket.

Documents lie in blocks of a few MB, written once as a bucketed table. A step
sends, per block and bucket of 64-bit keys, one packed message; a bucket's task
sees that bucket's keys of all blocks and replies to each block, key by key, in
the order of the question. Replies come back to the blocks by a join that moves
the replies only, as the block table is bucketed by block. A key that a third of
the documents share is one key per block and so never a hot group.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import storage
from reviewlake.llm.storage import shared_folder, written
from reviewlake.llm.textbytes import Chunk, chunks

BLOCK_BYTES = 4 << 20
#: Text bytes for which one bucket answers, over all blocks.
BUCKET_BYTES = 8 << 20

BLOCK_SCHEMA = "block long, doc_ids binary, keys binary, offs binary, data binary, rest binary"
MESSAGE_SCHEMA = "bucket int, block long, body binary"
REPLY_SCHEMA = "block long, bucket int, body binary"


class Blocks:
    """A bucketed table of text blocks: the frame, its bucket count, the text's size."""

    def __init__(self, frame: DataFrame, parts: int, n_bytes: int) -> None:
        self.frame, self.parts, self.n_bytes = frame, parts, n_bytes
        self.buckets = max(1, -(-n_bytes // BUCKET_BYTES))


def write_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 carry: bool = False, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write the whole texts of ``docs`` as blocks; a longer text has a block of its own.

    A null id sorts before all others. With ``carry``, all columns of the rows go
    along and come back from ``carried``.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    n_bytes = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    # The text itself goes once, as the block's bytes.
    others_of = [F.lit(None).cast("string") if c == text_col else docs[c] for c in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
                       *(x.alias(f"c{i}") for i, x in enumerate(others_of) if carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, Chunk, pa.RecordBatch]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held]).astype(np.int64)
            keys = np.concatenate([h[1] for h in held]).astype(np.int64)
            lengths = np.concatenate([np.diff(h[2].offs) for h in held])
            offs = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
            rest = pa.BufferOutputStream()
            if carry:
                with pa.ipc.new_stream(rest, held[0][3].schema) as out:
                    for h in held:
                        out.write_batch(h[3])
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                pa.array([keys.tobytes()], pa.binary()), pa.array([offs.tobytes()], pa.binary()),
                pa.array([b"".join(h[2].data.tobytes() for h in held)], pa.binary()),
                pa.array([rest.getvalue().to_pybytes()], pa.binary())],
                ["block", "doc_ids", "keys", "offs", "data", "rest"])

        for batch in batches:
            ids = batch.column(0).fill_null(-(2 ** 63)).to_numpy()
            keys = batch.column(2).to_numpy()
            others = batch.select(batch.schema.names[3:]) if carry else None
            for chunk in chunks(batch.column(1), block_bytes):
                if held and size + len(chunk.data) > block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
                here = slice(chunk.first, chunk.first + len(chunk))
                held.append((ids[here], keys[here], chunk, others[here] if carry else None))
                size += len(chunk.data)
        if held:
            yield block()

    name = f"llm_blocks_{uuid.uuid4().hex}"
    parts = min(2 * max(1, -(-n_bytes // block_bytes)), storage.MAX_BUCKETS)
    (rows.mapInArrow(run, BLOCK_SCHEMA).write.format("parquet").option("compression", "zstd")
         .option("path", f"{shared_folder(spark)}/{name}").bucketBy(parts, "block").saveAsTable(name))
    return Blocks(spark.table(name), parts, n_bytes)


def carried(row: dict) -> pa.Table:
    """The columns of a block's rows (c0, c1, ... in the order of the documents' columns),
    the text itself left null."""
    with pa.ipc.open_stream(row["rest"]) as stream:
        return stream.read_all()


def unpack(row: dict) -> tuple[np.ndarray, Chunk]:
    """Ids and texts of a block row."""
    return (np.frombuffer(row["doc_ids"], np.int64),
            Chunk(0, np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offs"], np.int64)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def with_replies(frame: DataFrame, blocks: Blocks, replies: DataFrame, name: str) -> DataFrame:
    """Blocks with the list of their replies, by bucket, in a column. The replies are
    dealt as the block table is, so that no text moves."""
    lists = (replies.repartition(blocks.parts, "block").groupBy("block")
             .agg(F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias(name)))
    return frame.join(lists.hint("shuffle_hash"), "block", "left")


def messages(frame: DataFrame, question: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The messages of every block: bucket, block, body."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            sent = list(question(row))
            if sent:
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in sent], pa.int32()),
                    pa.array([row["block"]] * len(sent), pa.int64()),
                    pa.array([x for _, x in sent], pa.binary())], ["bucket", "block", "body"])

    return frame.mapInArrow(send, MESSAGE_SCHEMA)


def ask(frame: DataFrame, question: Callable[[dict], Iterator[tuple[int, bytes]]],
        answer: Callable[[list[bytes]], list[bytes]], tag: str) -> DataFrame:
    """Send the messages of every block, answer them bucket by bucket, write the replies.

    ``question(block row)`` gives (bucket, body); ``answer(bodies of a bucket)``
    gives a body for each, or None to say nothing; one more body than asked is the
    bucket's note, which is kept under block -1.
    """

    def reply(group: pa.Table) -> pa.Table:
        bodies = group.column("body").to_pylist()
        got = answer(bodies)
        keep = [i for i, x in enumerate(got) if x is not None]
        block = [*group.column("block").to_pylist(), -1]
        return pa.table({
            "block": pa.array([block[i] for i in keep], pa.int64()),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(keep), pa.int32()),
            "body": pa.array([got[i] for i in keep], pa.binary())})

    return written(messages(frame, question).groupBy("bucket").applyInArrow(reply, REPLY_SCHEMA), tag)


# -- packed keys -----------------------------------------------------------

def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first, then the differences by byte plane, without
    the planes that are all zero."""
    steps = np.diff(keys, prepend=keys[:1])
    width = (int(steps.max()).bit_length() + 7) // 8 if len(keys) else 0
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:width])
    head = np.array([len(keys), width, keys[0] if len(keys) else 0], np.uint64)
    return head.tobytes() + planes.tobytes()


def unpack_keys(body: bytes) -> tuple[np.ndarray, bytes]:
    """The keys of a body, and what follows them."""
    n, width, first = np.frombuffer(body, np.uint64, 3)
    n, width = int(n), int(width)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(body, np.uint8, width * n, 24).reshape(width, n).T
    keys = np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)
    return keys + first, body[24 + width * n:]


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds, in ascending keys that use all 64 bits evenly, of equal ranges of keys."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)),
                           [len(keys)])).astype(np.int64)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as differences from the least, in the narrowest type that holds them."""
    low = int(values.min()) if len(values) else 0
    spread = int(values.max()) - low if len(values) else 0
    code = next(c for c, most in ((1, 1 << 8), (2, 1 << 16), (4, 1 << 32), (8, 1 << 64)) if spread < most)
    shifted = (values.astype(np.int64) - np.int64(low)).view(np.uint64)
    return np.array([low, code], np.int64).tobytes() + shifted.astype(f"<u{code}").tobytes()


def unpack_ints(body: bytes, n: int) -> np.ndarray:
    low, code = np.frombuffer(body, np.int64, 2)
    return np.frombuffer(body, f"<u{code}", n, 16).astype(np.int64) + low


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def same_in_two(keys: list[np.ndarray]) -> np.ndarray:
    """Ascending keys that are in two or more of the lists, each of distinct keys."""
    every = np.sort(np.concatenate(keys))
    return np.unique(every[1:][every[1:] == every[:-1]])


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the ascending ``keys`` are in the ascending ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys
