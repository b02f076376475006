"""Exact duplicates by owners in Patricia tries (operator 11).

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
space. A map task first finds equal texts of a bounded run of its rows with a trie of its
own, so a text that a third of the rows share is sent once per run. Texts then go to partitions
by length and content hash, whose tasks insert the full byte strings into a compressed
radix trie; a terminal node stores the smallest id and the number of rows. Bytes alone
decide, never a hash.

A trie is kept within a byte budget by spilling subtrees: the heaviest subtree of its first
branch goes out, terminal by terminal, and a stub stays; later texts that lead to the stub
follow it. What was spilled is written and dealt anew by length and hash for another round;
what stayed is final, so rounds end. A text whose copies of all runs are too many bytes for
one task is dealt to several by its runs' numbers, and what these found goes to another
round. Rows learn their owner by joins of ids, in which no text takes part.

Defined cases: a null text is empty; a null id is larger than all others; of repeated rows
(same id, equal text) one is kept; an empty table gives no rows; a text longer than the budget
has a trie of its own; columns other than id and text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.storage import written
from reviewlake.llm.textbytes import WHITE, Chunk, byte_prefix_hash, chunks, span_hash

#: Text bytes of a run of rows, in which equal texts are found before any is sent.
RUN_BYTES = 8 << 20
#: Text bytes of a partition's task, on average.
PARTITION_BYTES = 8 << 20
#: Bytes of copies of one text that a task takes.
COPY_BYTES = 4 * PARTITION_BYTES
#: Bytes that a trie may hold before subtrees are spilled: its labels, and so many per node.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400

NULL_ID = 2 ** 63 - 1

#: Rows (kind 0) with the number of their text, and texts (kind 1) to be inserted.
RUN_SCHEMA = """kind int, owner long, id long, first boolean, sha string, length long, hash long,
    text binary, least long, n long"""
#: Texts (kind 0) and their terminal, terminals (kind 1), spilled texts (kind 2).
TRIE_SCHEMA = """kind int, owner long, terminal long, length long, hash long, text binary,
    least long, least_owner long, n long"""


class Node:
    """A node of the trie: the label that leads to it, its children by first byte, and what
    ends here. ``weight`` is the bytes of its subtree; ``stub`` marks a spilled one."""

    __slots__ = ("label", "children", "terminal", "weight", "stub")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.terminal = label, {}, None
        self.weight, self.stub = NODE_BYTES + len(label), False


class Trie:
    """Byte strings with a value each; every label holds at least one byte but the root's."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, new):
        """The value of ``key``; ``new()`` makes that of a key that is not there yet. None if the
        way leads to a spilled subtree."""
        path, node, at = [], self.root, 0
        while True:
            path.append(node)
            if at == len(key):
                if node.terminal is None:
                    node.terminal = new()
                return node.terminal
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                child.terminal = new()
                self._heavier(path, child.weight)
                return child.terminal
            label = child.label
            if key.startswith(label, at):
                if child.stub:
                    return None
                node, at = child, at + len(label)
                continue
            same = common_prefix(label, key, at)
            upper = Node(label[:same])
            upper.weight += child.weight - same
            upper.children[label[same]] = child
            child.label = label[same:]
            child.weight -= same
            node.children[key[at]] = upper
            self._heavier(path, NODE_BYTES)
            node, at = upper, at + same

    @staticmethod
    def _heavier(path: list[Node], n: int) -> None:
        for node in path:
            node.weight += n

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Take the heaviest subtree of the first branch out: its keys and values. Nothing if
        only one key is left."""
        path, prefix = [self.root], b""
        while path[-1].terminal is None:
            open_children = [c for c in path[-1].children.values() if not c.stub]
            if len(open_children) != 1:
                break
            path.append(open_children[0])
            prefix += open_children[0].label
        open_children = [c for c in path[-1].children.values() if not c.stub]
        if not open_children:
            return
        out = max(open_children, key=lambda c: c.weight)
        stack = [(out, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.terminal is not None:
                yield key, node.terminal
            stack += [(c, key) for c in node.children.values() if not c.stub]
        # The first byte is enough for a stub: all that begins with it was in the subtree.
        before = out.weight
        out.children, out.terminal, out.stub, out.label = {}, None, True, out.label[:1]
        out.weight = NODE_BYTES + 1
        self._heavier(path, out.weight - before)

    def items(self) -> Iterator[object]:
        """The values that are left."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.terminal is not None:
                yield node.terminal
            stack += node.children.values()


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``label`` ``key`` has from ``at`` on; found by halving."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


# -- steps -------------------------------------------------------------------

def normalised(chunk: Chunk) -> Chunk:
    """The texts with every run of white space as one space."""
    white = WHITE[chunk.data]
    again = np.zeros(len(white), bool)
    again[1:] = white[1:] & white[:-1]
    again[chunk.offs[:-1][chunk.offs[:-1] < len(white)]] = False
    offs = np.concatenate(([0], np.cumsum(~again)))[chunk.offs]
    return Chunk(chunk.first, np.where(white, np.uint8(0x20), chunk.data)[~again], offs.astype(np.int64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the texts of each run of rows: rows with their text's number, and the distinct texts."""
    from pyspark import TaskContext
    schema = pa.schema([("kind", pa.int32()), ("owner", pa.int64()), ("id", pa.int64()), ("first", pa.bool_()),
                        ("sha", pa.string()), ("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()),
                        ("least", pa.int64()), ("n", pa.int64())])
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for raw in chunks(batch.column(1), RUN_BYTES):
            chunk, trie, texts = normalised(raw), Trie(), []
            hashes = span_hash(byte_prefix_hash(chunk.data), chunk.offs[:-1], chunk.offs[1:]).view(np.int64)
            rows = []
            for i in range(len(chunk)):
                key, doc = chunk.text(i), int(ids[raw.first + i])

                def new(key: bytes = key, i: int = i) -> dict:
                    nonlocal number
                    number += 1
                    texts.append({"kind": 1, "owner": number, "length": len(key), "hash": int(hashes[i]), "text": key,
                                  "sha": hashlib.sha256(key).hexdigest(), "least": NULL_ID, "n": 0, "row": -1})
                    return texts[-1]

                found = trie.insert(key, new)
                found["n"] += 1
                rows.append({"kind": 0, "owner": found["owner"], "id": doc, "first": False, "sha": found["sha"]})
                if found["row"] < 0 or doc < found["least"]:
                    found["least"], found["row"] = doc, i
            for t in texts:
                rows[t.pop("row")]["first"] = True
            yield pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_pylist(texts, schema)


def _tries(budget: int):
    """Insert a partition's texts; what the trie cannot hold is spilled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        schema = pa.schema([("kind", pa.int32()), ("owner", pa.int64()), ("terminal", pa.int64()),
                            ("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()),
                            ("least", pa.int64()), ("least_owner", pa.int64()), ("n", pa.int64())])
        number, trie = TaskContext.get().partitionId() << 40, Trie()

        def spilled(key: bytes, t: dict) -> dict:
            return {"kind": 2, "owner": t["terminal"], "text": key, **{
                c: t[c] for c in ("length", "hash", "least", "least_owner", "n")}}

        for batch in batches:
            out, size = [], 0
            columns = [batch.column(c) for c in ("owner", "length", "hash", "text", "least", "least_owner", "n", "salts")]
            for i in range(batch.num_rows):
                owner, length, key_hash, key, least, least_owner, n, salts = (c[i].as_py() for c in columns)

                def new(key: bytes | None = key if salts > 1 else None, length: int = length,
                        key_hash: int = key_hash) -> dict:
                    nonlocal number
                    number += 1
                    return {"kind": 1, "terminal": number, "length": length, "hash": key_hash, "text": key,
                            "least": NULL_ID, "least_owner": NULL_ID, "n": 0}

                found = trie.insert(key, new)
                went = found is None
                if went:
                    found = new()
                found["n"] += n
                found["least"], found["least_owner"] = min(
                    (found["least"], found["least_owner"]), (least, least_owner))
                out.append({"kind": 0, "owner": owner, "terminal": found["terminal"]})
                if went:
                    out.append(spilled(key, found))
                    size += len(key)
                while trie.root.weight > budget:
                    gone = [spilled(k, t) for k, t in trie.spill()]
                    if not gone:
                        break
                    out += gone
                    size += sum(len(x["text"]) for x in gone)
                if size > budget:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        # A text that other tasks hold as well goes to another round.
        ends = [t if t["text"] is None else spilled(t["text"], t) for t in trie.items()]
        if ends:
            yield pa.RecordBatch.from_pylist(ends, schema)
    return run


def salted_copies(texts: DataFrame) -> DataFrame:
    """The texts with ``salts``: among how many tasks the copies of a text are dealt, 1 for most."""
    keys = ["length", "hash"]
    several = (texts.groupBy(*keys).agg(F.count("*").alias("copies"))
               .select(*keys, F.least(F.floor(F.col("copies") / 2), F.ceil(
                   F.col("copies") * F.col("length") / COPY_BYTES)).alias("salts")).where("salts > 1"))
    several = written(several, "salts")
    if several.isEmpty():
        return texts.withColumn("salts", F.lit(1).cast("long"))
    return texts.join(several, keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))


def owners(texts: DataFrame, parts: int, budget: int = TRIE_BYTES) -> DataFrame:
    """(owner, least, least_owner, n) of each text (owner, length, hash, text, least, n): the
    smallest id among equal texts, the owner number that brought it, and their rows."""
    texts = texts.select("owner", "length", "hash", "text", "least", F.col("owner").alias("least_owner"), "n")
    names, done, step = None, None, 0
    while True:
        dealt = salted_copies(texts).repartition(parts, "length", "hash", F.lit(step),
                                                 F.pmod(F.xxhash64("owner"), F.col("salts")))
        got = written(dealt.mapInArrow(_tries(budget), TRIE_SCHEMA), "tries")
        here = got.where("kind = 0").select("owner", "terminal")
        names = here if names is None else (names.join(
            here.select(F.col("owner").alias("terminal"), F.col("terminal").alias("next")), "terminal")
            .select("owner", F.col("next").alias("terminal")))
        ends = got.where("kind = 1").select("terminal", "least", "least_owner", "n")
        final = names.join(ends, "terminal").drop("terminal")
        done = final if done is None else done.union(final)
        spilled = got.where("kind = 2")
        if spilled.isEmpty():
            return done
        texts = spilled.select("owner", "length", "hash", "text", "least", "least_owner", "n")
        step += 1


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (the smallest id of equal texts), group_size,
    kept (true for one row of each group) and text_sha256 of the normalised text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    runs = written(rows.mapInArrow(_runs, RUN_SCHEMA), "runs")
    texts = runs.where("kind = 1")
    n_bytes = texts.agg(F.sum("length")).first()[0] or 0
    found = owners(texts.select("owner", "length", "hash", "text", "least", "n"),
                   max(1, -(-n_bytes // PARTITION_BYTES)), trie_bytes)
    members = runs.where("kind = 0").select("owner", "id", "first", "sha")
    return members.join(found, "owner").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col),
        F.when(F.col("least") != NULL_ID, F.col("least")).alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("first") & (F.col("owner") == F.col("least_owner"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def oracle_sql() -> str:
    return r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""
