"""Conversation structure repair by weighted interval parsing (operator 13).

The roles of a conversation shall read ``(s?(ua)+)?`` by their initials. A repair keeps,
reroles, deletes or inserts rows; the cheapest one is wanted, of equally cheap ones that
whose edits' initials (its audit) are least in ASCII.

The repair grammar is in Chomsky normal form over spans of rows: a nonterminal ``(p, q)``
derives the spans that, once repaired, lead the wanted sequence from state p to q, so
``(p, r) -> (p, q) (q, r)``, and ``(p, q) -> row`` by an edit of one row. A chart cell is the
minimum (cost, audit) of a span and a nonterminal. Insertions need no row; their closure
(the cheapest way from p to q by insertions alone) is taken with every row. Cells are
combined bottom-up by span length, 1, 2, 4 and so on. Every derivation of a span passes
through some state at any place inside it, so one split per span is enough and all
spans need not be tried. An audit tells its cost, hence no audit of a cell is the
beginning of another one as cheap, and the least of a span is made of the least of its parts.

Rows are sorted by range over the whole table, so a conversation of any length is spread
over tasks: a task makes one span of each conversation that it holds rows of, whose
cells are combined in a second step with those of the other tasks. The digest of the
repaired rows is taken in a third step that streams them in order: SHA-256 cannot be
split, but no more than a span's audit is held.

Defined cases: null conversation ids are one conversation; a null text is empty, a null
role has no initial and fits nowhere; rows of one turn are ordered by role and text;
identical rows are duplicates but for the first one; an empty table gives no rows; columns
other than the four named ones are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.storage import written

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States of the wanted sequence: at its begin, after s, after u, after a.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
STEPS = {"s": {BEGIN: AFTER_S}, "u": {BEGIN: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
         "a": {AFTER_U: AFTER_A}}
FINAL = (BEGIN, AFTER_A)
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}

Cells = dict[tuple[int, int], tuple[int, str]]

#: A row (kind 0) with its place, or a span (kind 1) with its cells.
SPAN_SCHEMA = """kind int, conv_id long, part int, place long, copies long, first_seen boolean, role string,
    body string, fault string, blank long, duplicate long, truncated long, illegal long, turns long,
    low long, high long, head string, tail string, cells array<struct<p:int,q:int,cost:long,audit:string>>"""
CONVERSATION_SCHEMA = """kind int, conv_id long, part int, gaps long, blank long, duplicate long,
    truncated long, illegal long, cost long, audit string"""
DIGEST_SCHEMA = "conv_id long, repaired_sha256 string"


# -- the chart ---------------------------------------------------------------

def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans taken together."""
    out: Cells = {}
    for (p, q), (cost, audit) in left.items():
        for r in range(STATES):
            if (q, r) in right:
                more, rest = right[q, r]
                new = (cost + more, audit + rest)
                if (p, r) not in out or new < out[p, r]:
                    out[p, r] = new
    return out


def _closure() -> Cells:
    """The cheapest insertions that lead from one state to another."""
    one: Cells = {(p, q): (INSERT, "I") for role in "ua" for p, q in STEPS[role].items()}
    one |= {(p, p): (0, "") for p in range(STATES)}
    while (more := combine(one, one)) != one:
        one = more
    return one


INSERTIONS = _closure()


def row_cells(initial: str, fault: str) -> Cells:
    """Cells of a single row: its edits, followed by any insertions."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(STATES)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role in "ua":
            cells |= {(p, q): (more + REROLE, "R") for p, q in STEPS[role].items()}
        cells |= {(p, q): (more, "K") for p, q in STEPS.get(initial, {}).items()}
    return combine(cells, INSERTIONS)


def parse(leaves: list[Cells]) -> Cells:
    """The chart's cells of the whole span, combined bottom-up by span length."""
    spans = leaves
    while len(spans) > 1:
        spans = [combine(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def deleted(n: int) -> Cells:
    """Cells of n rows that must go: their deletions, with insertions anywhere."""
    out: Cells | None = None
    square = row_cells("", "duplicate")
    while n:                    # the n-th power by squaring
        if n & 1:
            out = square if out is None else combine(out, square)
        n >>= 1
        square = combine(square, square) if n else square
    return out


# -- steps -------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn``, a null being one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = F.crc32(key.cast("binary")) % 20
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), text.alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")))


def fault_of(text: str) -> Column:
    """blank, truncated or null, by the text alone."""
    words = F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(words == "", "blank").when(~F.right(words, F.lit(1)).isin(".", "!", "?"), "truncated")


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, marked where the role and text come first."""
    same = rows.groupBy("conv_id", "role", "text", "turn").agg(F.sum("copies").alias("copies"))
    said = [F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), F.col("role").isNull(),
            F.coalesce("role", F.lit("")), F.col("text")]
    names = ["_c0", "_c1", "_c2", "_c3", "_c4"]
    same = same.withColumns(dict(zip(names, said, strict=True)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = same.groupBy(*names).agg(F.min(turn).alias("first"))
    return (same.join(first, names).withColumn("first_seen", F.col("first") == turn)
            .select("conv_id", "turn", "role", "text", "copies", "first_seen"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with its place, and after them the spans of their conversations."""
    from pyspark import TaskContext
    part, place, now, empty = TaskContext.get().partitionId(), 0, None, True
    schema = pa.schema([
        ("kind", pa.int32()), ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()),
        ("copies", pa.int64()), ("first_seen", pa.bool_()), ("role", pa.string()), ("body", pa.string()),
        ("fault", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
        ("head", pa.string()), ("tail", pa.string()),
        ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()),
                                      ("audit", pa.string())])))])
    span: dict = {}
    leaves: list[Cells] = []

    def close() -> dict:
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in parse(leaves).items()]
        return {**span, "kind": 1, "conv_id": now, "part": part, "place": place, "cells": cells}

    for batch in batches:
        out = []
        for conv, turn, role, text, copies, first_seen, fault in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies",
                                                        "first_seen", "fault")), strict=True):
            if empty or conv != now:
                if not empty:
                    out.append(close())
                now, empty, leaves, place = conv, False, [], 0
                span = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                span |= {"low": None, "high": None, "head": (role or "")[:1], "tail": None}
            initial = (role or "")[:1]
            if span["tail"] is not None and span["tail"] + initial not in ("su", "ua", "au"):
                span["illegal"] += 1
            span["illegal"] += copies - 1
            span["tail"] = initial
            if turn is not None and turn != span["high"]:
                span["turns"] += 1
                span["low"] = turn if span["low"] is None else span["low"]
                span["high"] = turn
            if fault == "blank":
                span["blank"] += copies
                leaves.append(deleted(copies))
            else:
                again = copies - 1 if first_seen else copies
                span["duplicate"] += again
                if first_seen:
                    span["truncated"] += fault == "truncated"
                    leaves.append(row_cells(initial, fault or ""))
                if again:
                    leaves.append(deleted(again))
            out.append({"kind": 0, "conv_id": conv, "part": part, "place": place, "copies": copies,
                        "first_seen": first_seen, "role": role, "body": text, "fault": fault})
            place += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if not empty:
        yield pa.RecordBatch.from_pylist([close()], schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order to one row per conversation (kind 0) and the audit of each span (kind 1)."""
    schema = pa.schema([
        ("kind", pa.int32()), ("conv_id", pa.int64()), ("part", pa.int32()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    held: list[dict] = []

    def close() -> list[dict]:
        # The best way from each state to the end, and of each span what it begins with.
        rest: dict[int, tuple[int, str]] = {q: (0, "") for q in FINAL}
        begins: list[dict[int, tuple[str, int]]] = []
        for s in reversed(held):
            here: dict[int, tuple[int, str]] = {}
            begin: dict[int, tuple[str, int]] = {}
            for c in s["cells"]:
                p, q = c["p"], c["q"]
                if q in rest:
                    new = (c["cost"] + rest[q][0], c["audit"] + rest[q][1])
                    if p not in here or new < here[p]:
                        here[p], begin[p] = new, (c["audit"], q)
            rest = here
            begins.append(begin)
        begins.reverse()
        cost, audit, state = min((INSERTIONS[BEGIN, q][0] + rest[q][0], INSERTIONS[BEGIN, q][1] + rest[q][1], q)
                                 for q in rest if (BEGIN, q) in INSERTIONS)
        lead = INSERTIONS[BEGIN, state][1]
        out, total = [], {"illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "turns": 0}
        low = high = tail = None
        for i, s in enumerate(held):
            for k in total:
                total[k] += s[k]
            if tail is not None and tail + s["head"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            tail = s["tail"]
            if s["low"] is not None:
                total["turns"] -= s["low"] == high
                low, high = s["low"] if low is None else low, s["high"]
            mine, state = begins[i][state]
            out.append({"kind": 1, "conv_id": s["conv_id"], "part": s["part"], "audit": lead + mine})
            lead = ""
        gaps = 0 if low is None else high - low + 1 - total["turns"]
        del total["turns"]
        return [*out, {"kind": 0, "conv_id": held[0]["conv_id"], "gaps": gaps, "cost": cost, "audit": audit, **total}]

    for s in _streamed(batches):
        if held and held[0]["conv_id"] != s["conv_id"]:
            yield pa.RecordBatch.from_pylist(close(), schema)
            held = []
        held.append(s)
    if held:
        yield pa.RecordBatch.from_pylist(close(), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's rows behind their span's audit, in order, to the digest of what is left."""
    import hashlib
    digest, lines, now, audit, at, state = None, 0, None, "", 0, BEGIN

    def put(role: str, body: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + f"{role}:{body}").encode())
        lines += 1

    def insert() -> None:
        """The insertions that come next in the audit."""
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = AFTER_A if state == AFTER_U else AFTER_U
            put(ROLE[state], "")
            at += 1

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}],
                                          pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    for r in _streamed(batches):
        if digest is None or r["conv_id"] != now:
            if digest is not None:
                yield close()
            digest, lines, now, state = hashlib.sha256(), 0, r["conv_id"], BEGIN
        if r["place"] < 0:
            audit, at = r["audit"], 0
            insert()
            continue
        for _ in range(r["copies"]):
            edit, at = audit[at], at + 1
            if edit == "K":
                state = STEPS[r["role"][0]][state]
                put(r["role"], r["body"])
            elif edit == "R":
                state = AFTER_A if state == AFTER_U else AFTER_U
                put(ROLE[state], r["body"])
            insert()
    if digest is not None:
        yield close()


def repair_conversations(rows: DataFrame, *, parts: int | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): the counts of its
    faults, the cost and audit of its cheapest repair, and the digest of the repaired rows.
    ``copies`` says how often a row is there."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    marked = _numbered(rows).withColumn("fault", fault_of("text"))
    # Nulls sort first.
    sorted_rows = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    both = written(sorted_rows.mapInArrow(_spans, SPAN_SCHEMA), "spans")
    spans = both.where("kind = 1").select("conv_id", "part", "blank", "duplicate", "truncated", "illegal",
                                          "turns", "low", "high", "head", "tail", "cells")
    found = written(spans.repartition("conv_id").sortWithinPartitions("conv_id", "part")
                    .mapInArrow(_conversations, CONVERSATION_SCHEMA), "repairs")
    audits = found.where("kind = 1").select(
        "conv_id", "part", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("copies"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("body"), "audit")
    kept = both.where("kind = 0").select("conv_id", "part", "place", "copies", "role", "body",
                                         F.lit(None).cast("string").alias("audit"))
    digests = (audits.union(kept).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
               .mapInArrow(_digests, DIGEST_SCHEMA))
    whole = found.where("kind = 0").drop("kind", "part")
    return (whole.join(digests, whole.conv_id.eqNullSafe(digests.conv_id)).drop(digests.conv_id)
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    "repaired_sha256"))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows``, repaired after its damage; one without a row left has an empty repair."""
    all_ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_conversations(damaged(rows)).withColumnRenamed("conv_id", "_found")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def oracle_sql() -> str:
    """The same by a fold over each conversation's rows: for each state the least (cost, audit, lines)."""
    # crc32 bit by bit: an item of the list is a byte to mix in, or -1 to shift.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)
                          ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

    def step(frm: str, cost: str, edit: str, line: str) -> str:
        return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{edit}', 't': list_append({frm}.t, {line})}}"

    def took(to_role: str, frm: list[str]) -> list[str]:
        line = "r.role || ':' || r.text"
        keep = {"user": "u", "assistant": "a"}[to_role]
        return [f"CASE WHEN r.hard THEN NULL ELSE {step(x, 'r.more + 1', 'R', f"'{to_role}:' || r.text")} END" for x in frm] \
            + [f"CASE WHEN r.hard OR r.initial IS DISTINCT FROM '{keep}' THEN NULL ELSE {step(x, 'r.more', 'K', line)} END"
               for x in frm]

    def gone(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + 2, 'a': {x}.a || 'D', 't': {x}.t}} END"

    def guarded(options: list[str], frm: list[str]) -> list[str]:
        return [f"CASE WHEN {x} IS NULL THEN NULL ELSE {o} END" for o, x in zip(options, frm, strict=True)]

    def least(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"

    s = ["f.s0", "f.s1", "f.s2", "f.s3"]
    to_s = guarded([f"CASE WHEN r.hard OR r.initial IS DISTINCT FROM 's' THEN NULL ELSE "
                    f"{step(s[0], 'r.more', 'K', "r.role || ':' || r.text")} END"], [s[0]])
    from_u = [s[0], s[1], s[3]]
    to_u = guarded(took("user", from_u), from_u * 2)
    to_a = guarded(took("assistant", [s[2]]), [s[2]] * 2)
    rows = [least([gone(s[0])]), least([*to_s, gone(s[1])]), least([*to_u, gone(s[2])]), least([*to_a, gone(s[3])])]

    def insert(x: str, role: str, times: int = 1) -> str:
        other = "assistant" if role == "user" else "user"
        lines = ", ".join(f"'{role if i % 2 == 0 else other}:'" for i in range(times))
        return (f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + {5 * times}, 'a': {x}.a || '{'I' * times}', "
                f"'t': list_concat({x}.t, [{lines}])}} END")
    closed = ["o0", "o1",
              least(["o2", *(insert(x, "user") for x in ("o0", "o1", "o3"))]),
              least(["o3", insert("o2", "assistant"), *(insert(x, "user", 2) for x in ("o0", "o1"))])]
    white = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text
                            ORDER BY turn NULLS FIRST, copy) AS again,
         regexp_replace(text, '{white}+$', '') AS words, coalesce(role[1], '') AS initial
  FROM hurt),
faults AS (
  SELECT *, CASE WHEN words = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                 WHEN words[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
rows_of AS (
  SELECT *, fault IN ('blank', 'duplicate') AS hard, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more
  FROM faults),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_of GROUP BY conv_id),
begun AS (
  SELECT conv_id, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS o0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS o1,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS o2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS o3
  FROM counts),
folded AS (
  SELECT conv_id, 0::BIGINT AS pos, {closed[0]} AS s0, {closed[1]} AS s1, {closed[2]} AS s2, {closed[3]} AS s3 FROM begun
  UNION ALL
  SELECT conv_id, pos, {closed[0]} AS s0, {closed[1]} AS s1, {closed[2]} AS s2, {closed[3]} AS s3 FROM (
    SELECT f.conv_id, r.pos, {rows[0]} AS o0, {rows[1]} AS o1, {rows[2]} AS o2, {rows[3]} AS o3
    FROM folded f JOIN rows_of r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = f.pos + 1)),
ended AS (
  SELECT f.conv_id, least(s0, coalesce(s3, s0)) AS o, c.* EXCLUDE (conv_id, n)
  FROM folded f JOIN counts c ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.pos = c.n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(o.c, 0)::BIGINT AS cost,
       coalesce(o.a, '') AS audit, sha256(coalesce(array_to_string(o.t, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN ended e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""
