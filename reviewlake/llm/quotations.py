"""Quotation linking: messages joined to what they quote, in reply order (operator 3).

DataFrame functions only. The lines of a message are parsed into quote levels (the
number of leading ``>``); a passage is a maximal run of lines of one level without a
blank line. Passages and their lines are normalised (lower case, white space
collapsed) and hashed. A quoted passage is linked to the latest earlier message of
its conversation that says it itself, at level zero, as a whole or else in one of
its lines; failing that to the first message of another conversation that does.

A message answers the message that its least deeply quoted linked passage comes from
(the latest, if several), otherwise the message before it. Its reply depth is the
number of answers between it and the conversation's first message, and the
conversation is ordered by depth, then turn: everything comes after what it answers.

A conversation of any length is spread over tasks: rows are numbered by a range
sort, and "the latest before" is found inside spans of 1024 positions and, for
whole spans, on one row per span.

Defined cases: a null text is empty; null conversations are one conversation, a null
turn comes first; messages with equal turns are ordered by text and role, repeated
rows stay; an empty table gives no rows; columns other than the four are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlake.llm.storage import written

SPAN = 1024
_NULL = -(2 ** 62)
_QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)+)"


def latest_before(rows: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Add the greatest ``value`` (a struct that starts with the position) among the rows of
    the same keys with a smaller position."""
    rows = rows.withColumn("_span", F.floor(F.col(pos) / SPAN))
    inside = W.partitionBy(*keys, "_span").orderBy(pos).rangeBetween(W.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "_span").agg(F.max(value).alias("_most"))
    earlier = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_carry", F.max("_most").over(earlier)).drop("_most")
    return (rows.withColumn("_own", F.max(value).over(inside)).join(spans, [*keys, "_span"])
            .withColumn(out, F.coalesce("_own", "_carry")).drop("_span", "_own", "_carry"))


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add 0, 1, ... within each group in the given order, by a range sort. Written."""
    ordered = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                      .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
                      "numbered")
    runs = ordered.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", (before - F.col("_first")).alias("_shift"))
    return (ordered.join(runs, [group, "_part"]).withColumn(out, F.col("_row") + F.col("_shift"))
            .drop("_part", "_row", "_shift"))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """uid, conv, place, line number, level, content of every line."""
    line = F.col("line")
    mark = F.regexp_extract(line, _QUOTE, 1)
    return (messages.select("uid", "conv", "place", F.posexplode(F.split("text", "\r?\n")).alias("number", "line"))
            .withColumns({"level": F.length(F.regexp_replace(mark, "[^>]", "")),
                          "content": F.when(mark == "", line).otherwise(F.regexp_replace(line, _QUOTE, ""))}))


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def passages(lines: DataFrame) -> DataFrame:
    """Passages: uid, conv, place, level, number of the first line, and the normalised lines."""
    own = W.partitionBy("uid").orderBy("number")
    plain = lines.withColumn("normal", _normal(F.col("content")))
    starts = (F.lag("level").over(own).isNull() | (F.lag("level").over(own) != F.col("level"))
              | (F.lag("normal").over(own) == ""))
    return (plain.withColumn("start", starts.cast("int"))
            .withColumn("passage", F.sum("start").over(own)).where("normal != ''")
            .groupBy("uid", "conv", "place", "level", "passage")
            .agg(F.sort_array(F.collect_list(F.struct("number", "normal"))).alias("lines"))
            .withColumn("lines", F.col("lines.normal")))


def _hashes(found: DataFrame) -> DataFrame:
    """Two kinds of entries per passage: itself (whole) and each of its lines."""
    whole = F.struct(F.xxhash64(F.array_join("lines", " ")).alias("hash"), F.lit(True).alias("whole"))
    each = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("hash"), F.lit(False).alias("whole")))
    return (found.withColumn("entry", F.explode(F.concat(F.array(whole), each)))
            .select("uid", "conv", "place", "level", "passage", "entry.hash", "entry.whole"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per quoted passage, the message it comes from. messages: uid, conv, place, text."""
    entries = written(_hashes(passages(parsed_lines(messages))), "passages")
    quoted = entries.where("level > 0")
    own = (entries.where("level = 0").select("conv", "hash", "place", "uid").distinct()
           .join(quoted.select("hash").distinct(), "hash", "left_semi"))
    said = own.select("conv", "hash", "place", F.struct("place", "uid").alias("said"),
                      *(F.lit(None).cast(t).alias(c) for c, t in
                        (("asker", "long"), ("level", "int"), ("passage", "long"), ("whole", "boolean"))))
    asks = quoted.select("conv", "hash", "place", F.lit(None).cast("struct<place:long,uid:long>").alias("said"),
                         F.col("uid").alias("asker"), "level", "passage", "whole")
    here = latest_before(said.unionByName(asks), ["conv", "hash"], "place", "said", "source").where(
        "asker is not null")
    # The first message of each of the two lowest conversations that say it: one of them is
    # not the asker's own.
    by_conv = own.groupBy("hash", "conv").agg(F.min(F.struct("place", "uid")).getField("uid").alias("from"))
    two = (by_conv.withColumn("turn", F.row_number().over(W.partitionBy("hash").orderBy("conv")))
           .where("turn <= 2").groupBy("hash").agg(F.min(F.struct("conv", "from")).alias("first"),
                                                   F.max(F.struct("conv", "from")).alias("second")))
    both = here.join(two, "hash", "left").withColumn("elsewhere", F.coalesce(
        *(F.when(F.col(f"{c}.conv") != F.col("conv"), F.col(f"{c}.from")) for c in ("first", "second"))))
    # Preferred: the same conversation, then whole passages, then the latest.
    best = F.max(F.when(F.col("source").isNotNull() | F.col("elsewhere").isNotNull(), F.struct(
        F.col("source").isNotNull().alias("same"), "whole", F.col("source.place").alias("place"),
        F.coalesce("source.uid", "elsewhere").alias("source"))))
    return (both.groupBy("conv", "asker", "level", "passage").agg(best.alias("best"))
            .select("conv", F.col("asker").alias("uid"), "level", "passage", "best.same", "best.source",
                    F.when(F.col("best.same"), F.col("best.place")).alias("source_place")))


def reply_depths(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Reply depth per message. messages: uid, conv, place; answers: uid, conv, to (a place).

    Without an answer of its own a message continues the run of the one before; only
    starts of runs that answer an earlier place are followed, by pointer doubling.
    """
    jumps = answers.where("to is not null").select("conv", "uid", "to")
    starts = messages.join(jumps, ["conv", "uid"], "left").withColumn(
        "start", F.when((F.col("place") == 0) | (F.col("to") != F.col("place") - 1), F.struct("place", "to")))
    # The run that a place is in starts at or before it.
    runs = latest_before(starts.withColumn("next", F.col("place") + 1)
                         .select("conv", "uid", "place", "next", "to", "start"),
                         ["conv"], "place", "start", "before")
    runs = written(runs.withColumn("run", F.coalesce("start.place", "before.place"))
                   .select("conv", "uid", "place", "to", "run", F.col("start").isNotNull().alias("starts")), "runs")
    # depth(start) = depth(run of the answered place) + its distance from that start + 1
    of = runs.select("conv", F.col("place").alias("to"), F.col("run").alias("up"))
    heads = runs.where("starts and place > 0").select("conv", "place", "to").join(of, ["conv", "to"]).select(
        "conv", "place", "up", (F.col("to") - F.col("up") + 1).alias("steps"))
    heads = written(heads, "heads")
    while not heads.where("up > 0").isEmpty():
        above = heads.select("conv", F.col("place").alias("up"), F.col("up").alias("higher"),
                             F.col("steps").alias("more"))
        heads = written(heads.join(above, ["conv", "up"], "left").select(
            "conv", "place", F.coalesce("higher", "up").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "heads")
    return (runs.join(heads.select("conv", F.col("place").alias("run"), "steps"), ["conv", "run"], "left")
            .select("conv", "uid", "place",
                    (F.coalesce("steps", F.lit(0)) + F.col("place") - F.col("run")).alias("reply_depth")))


def reply_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, without quotes, with what it quotes, answers, and its place."""
    rows = messages.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(_NULL)).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_NULL)).alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = written(numbered(rows, "conv", ["turn", "text", "role"], "place")
                     .withColumn("uid", F.monotonically_increasing_id()), "messages")
    links = written(link_quotes(placed.select("uid", "conv", "place", "text")), "links")
    answers = (links.groupBy("conv", "uid").agg(
        F.max(F.when(F.col("same"), F.struct((-F.col("level")).alias("near"), "source_place"))).alias("best"),
        F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), F.max("level").alias("quote_depth"))
        .withColumn("to", F.col("best.source_place")))
    depth = reply_depths(placed.select("uid", "conv", "place"), answers)
    says = (parsed_lines(placed).where("level = 0").groupBy("uid")
            .agg(F.sort_array(F.collect_list(F.struct("number", "content"))).alias("lines"))
            .select("uid", F.regexp_replace(F.regexp_replace(F.array_join("lines.content", "\n"),
                                                             r"^(?:[ \t]*\n)+", ""), r"\s+$", "").alias("own_text")))
    full = (placed.join(depth.drop("place"), ["conv", "uid"]).join(answers.drop("best"), ["conv", "uid"], "left")
            .join(says, "uid", "left"))
    turn_at = placed.select("conv", F.col("place").alias("answers"), F.col("turn").alias("answers_turn"))
    full = full.withColumn("answers", F.coalesce("to", F.when(F.col("place") > 0, F.col("place") - 1)))
    full = full.join(turn_at, ["conv", "answers"], "left").drop("answers", "to", "text")
    real = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return numbered(full, "conv", ["reply_depth", "place"], "reply_order").select(
        real("conv").alias("conv_id"), real("turn").alias("turn"), "role",
        F.coalesce("own_text", F.lit("")).alias("own_text"),
        F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        real("answers_turn").alias("answers_turn"), "reply_depth", "reply_order")
