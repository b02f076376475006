"""Phrases of words that belong together, by stripes (operator 12).

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``. A stripe is what one prefix of words keeps: a counter of the words that
follow it, with the prefix' own total under the empty word. Each block of text makes its
stripes; the stripes of a prefix are merged elementwise, and the merged ones give all that is
wanted: the extensions of a prefix (its phrases), prefix totals (the parts of a cut) and the
largest extension of a phrase (what subsumes it).

First the stripes of single words are merged; a merged stripe tells each block which of its
own pairs are frequent. Words that follow a run of frequent pairs alone can make a longer
frequent phrase, so the second stripes, in which a word counts all that follows it for two
to four words, hold little else: the counters of longer prefixes, nested in that of their
first word. Counts are exact: nothing is sampled, hashed or bounded, words are compared as strings.

Blocks and merged partitions hold so many bytes of text. A prefix that begins a large share
of all pairs has its stripes cut into sub-stripes by the following word, as many as its share of
the partitions. These prefixes are at most 1024 words: those of at least that share.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; an
empty table gives no rows; a text longer than a block has a block of its own; columns other
than text and language are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.storage import written
from reviewlake.llm.textbytes import LOWER, Chunk, byte_prefix_hash, chunks, owners, span_hash, spans

MIN_COUNT, LONGEST, TOP = 100, 5, 2000

#: Text bytes of a block, and of a partition of stripes to merge.
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: A word is hot if it is this share of all words or more.
HOT_SHARE = 1 / 1024

CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = CUT.copy()
APART[[0x20, 0x09]] = True

BLOCK_SCHEMA = "block long, lang string, n long, size long, words array<string>, codes binary"
STRIPE_SCHEMA = "lang string, prefix string, salt int, block long, nexts string, counts binary"
MERGED_SCHEMA = "kind int, lang string, prefix string, next string, a long, block long, nexts string"


# -- blocks ------------------------------------------------------------------

def coded(chunk: Chunk) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the texts, and their places: word numbers, -1 between pieces."""
    data = LOWER[chunk.data]
    starts, ends, bounds = spans(~APART[data], chunk.offs)
    offs = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    raw = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs.tobytes()),
                                           pa.py_buffer(data[~APART[data]].tobytes()))
    words = raw.dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    cuts, text = np.cumsum(CUT[data])[starts] if len(starts) else starts, owners(bounds)
    new = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(text) > 0)) + 1
    return words.dictionary.cast(pa.string()), np.insert(codes, new, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def block(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        texts = pa.concat_arrays([t.cast(pa.large_string()) for t in held.pop(lang)])
        del size[lang]
        for chunk in chunks(texts, BLOCK_BYTES):
            words, codes = coded(chunk)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([lang]), pa.array([int((codes >= 0).sum())], pa.int64()),
                pa.array([len(chunk.data)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([codes.tobytes()], pa.binary())], ["block", "lang", "n", "size", "words", "codes"])
            number += 1

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + texts.nbytes
        while sum(size.values()) > BLOCK_BYTES:
            yield from block(max(size, key=size.get))
    for lang in list(held):
        yield from block(lang)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in ("block", "lang", "words", "codes")}
            yield (row["block"].as_py(), row["lang"].as_py(), row["words"].values,
                   np.frombuffer(row["codes"].as_py(), np.int32))


def hot_words(blocks: DataFrame) -> dict[tuple[str, str], float]:
    """(language, word) to share of all words, of the words that make out ``HOT_SHARE`` of them.

    A word of that share has it in some block as well, so a block names no others, at most
    1024; what is named is a lower bound of a word's share, too small by ``HOT_SHARE`` at most.
    """
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, words, codes in _rows(batches):
            count = np.bincount(codes[codes >= 0], minlength=len(words))
            hot = np.flatnonzero(count >= max(1, HOT_SHARE * count.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hot), pa.string()), words.take(pa.array(hot)),
                                              pa.array(count[hot].astype(np.int64))], ["lang", "word", "n"])

    total = blocks.agg(F.sum("n")).first()[0] or 0
    rows = (blocks.select("block", "lang", "words", "codes").mapInArrow(named, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, HOT_SHARE * total)))
    return {(r.lang, r.word): r.n / total for r in rows.collect()}


# -- stripes -----------------------------------------------------------------

class Vocabulary:
    """A block's words, with the empty word after the last one."""

    def __init__(self, lang: str, words: pa.Array, hot: dict, parts: int) -> None:
        self.words = pa.concat_arrays([words.cast(pa.string()), pa.array([""])])
        offs = np.frombuffer(self.words.buffers()[1], np.int32)[
            self.words.offset:self.words.offset + len(self.words) + 1].astype(np.int64)
        raw = self.words.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.hash = span_hash(byte_prefix_hash(data), offs[:-1], offs[1:])
        self.hash[-1] = 0
        self.salts = np.ones(len(self.words), np.int64)
        mine = {w: int(np.ceil(share * parts)) for (of, w), share in hot.items() if of == lang}
        if mine:
            at = pc.index_in(pa.array(list(mine), pa.string()), self.words)
            for n, i in zip(mine.values(), at.to_pylist(), strict=True):
                if i is not None:
                    self.salts[i] = max(1, n)


def stripes(v: Vocabulary, lang: str, block: int, prefix: np.ndarray, second: np.ndarray, nexts: pa.Array,
            following: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """The stripes of a block, from its entries: the prefix' number, that of the word after it, what
    follows it as a whole (a place in ``nexts``) and how often."""
    salt = (v.hash[second] % v.salts[prefix].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((salt, prefix))
    prefix, following, count, salt = prefix[order], following[order], count[order], salt[order]
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (salt[1:] != salt[:-1])
    first = np.flatnonzero(new)
    bounds = np.append(first, len(prefix)).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), nexts.take(pa.array(following))), " ")
    counts = pa.BinaryArray.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(count.astype(np.uint32).tobytes())])
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(first), pa.string()), v.words.take(pa.array(prefix[first])),
        pa.array(salt[first].astype(np.int32)), pa.array(np.full(len(first), block)), joined, counts],
        ["lang", "prefix", "salt", "block", "nexts", "counts"])


def _word_stripes(hot: dict, parts: int):
    """Stripes of single words: what follows each, and how often it is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, words, codes in _rows(batches):
            v, n = Vocabulary(lang, words, hot, parts), len(words)
            if not n:
                continue
            here = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
            pair, count = np.unique(codes[here].astype(np.int64) * n + codes[here + 1], return_counts=True)
            total = np.bincount(codes[codes >= 0], minlength=n)
            following = np.concatenate((pair % n, np.full(n, n)))
            yield stripes(v, lang, block, np.concatenate((pair // n, np.arange(n))), following, v.words, following,
                          np.concatenate((count, total)))
    return run


def _phrase_stripes(hot: dict, parts: int):
    """Stripes of what follows a word for two to four words, of a block and the pairs of it that are
    frequent; the following words stand together, with tabs between."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("salt", pa.int32()), ("block", pa.int64()),
                        ("nexts", pa.string()), ("counts", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, lang, words, codes in _rows(left.to_batches()):
            if not right.num_rows:
                continue
            v, n = Vocabulary(lang, words, hot, parts), len(words)
            lists = pc.split_pattern(right.column("nexts").combine_chunks(), " ")
            own = pc.index_in(right.column("prefix").combine_chunks(), v.words).to_numpy(zero_copy_only=False)
            first = own[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)].astype(np.int64)
            frequent = np.unique(first * n + pc.index_in(pc.list_flatten(lists), v.words)
                                 .to_numpy(zero_copy_only=False))
            codes = codes.astype(np.int64)
            pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * n + codes[1:], -1)
            at = np.minimum(np.searchsorted(frequent, pair), len(frequent) - 1)
            frequent_here = frequent[at] == pair
            # Where a phrase of the length begins whose pairs are frequent, and its number.
            begin, number = np.flatnonzero(frequent_here), at[frequent_here]
            places, counts, nexts = [], [], []
            for length in range(3, LONGEST + 1):
                last = begin + length - 2
                going = last < len(frequent_here)
                going[going] = frequent_here[last[going]]
                begin, number = begin[going], number[going]
                if not len(begin):
                    break
                _, number = np.unique(number, return_inverse=True)
                _, some, number, count = np.unique(number * n + codes[begin + length - 1], return_index=True,
                                                   return_inverse=True, return_counts=True)
                places.append(begin[some])
                counts.append(count)
                nexts.append(pc.binary_join_element_wise(
                    *(v.words.take(pa.array(codes[begin[some] + k])) for k in range(1, length)), "\t"))
            if places:
                place = np.concatenate(places)
                out.append(stripes(v, lang, block, codes[place], codes[place + 1], pa.concat_arrays(nexts),
                                   np.arange(len(place)), np.concatenate(counts)))
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()
    return run


def _merged(min_count: int, reply: bool):
    """Merge the stripes of a partition elementwise: entries of ``min_count`` or more (kind 0), and to
    each block, if asked for, the frequent ones of its own (kind 1)."""
    names = ["kind", "lang", "prefix", "next", "a", "block", "nexts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([
            ("lang", pa.string()), ("prefix", pa.string()), ("block", pa.int64()), ("nexts", pa.string()),
            ("counts", pa.binary())])).combine_chunks()
        if not rows.num_rows:
            return
        column = {c: rows.column(c).combine_chunks() for c in rows.schema.names}
        lists = pc.split_pattern(column["nexts"], " ")
        of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        following = pc.list_flatten(lists).dictionary_encode()
        count = np.frombuffer(b"".join(column["counts"].to_pylist()), np.uint32).astype(np.int64)
        lang, prefix = (column[c].dictionary_encode() for c in ("lang", "prefix"))
        stripe = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(prefix.dictionary)
                  + prefix.indices.to_numpy(zero_copy_only=False))
        stripe = np.unique(stripe, return_inverse=True)[1]
        entry = stripe[of] * len(following.dictionary) + following.indices.to_numpy(zero_copy_only=False)
        _, first, number = np.unique(entry, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number, count)
        keep = np.flatnonzero(total >= min_count)
        at = pa.array(first[keep])
        row = pa.array(of[first[keep]])
        none = pa.nulls(len(keep))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(len(keep), np.int32)), column["lang"].take(row), column["prefix"].take(row),
            following.take(at).cast(pa.string()), pa.array(total[keep]), none.cast(pa.int64()),
            none.cast(pa.string())], names)
        if reply:
            empty = pc.index_in(pa.array([""]), following.dictionary)[0].as_py()
            told = total[number] >= min_count
            if empty is not None:
                told &= following.indices.to_numpy(zero_copy_only=False) != empty
            told = np.flatnonzero(told)
            to, begin = np.unique(of[told], return_index=True)
            bounds = np.append(begin, len(told)).astype(np.int32)
            said = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(bounds), following.take(pa.array(told)).cast(pa.string())), " ")
            row, none = pa.array(to), pa.nulls(len(to))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(len(to), np.int32)), none.cast(pa.string()), column["prefix"].take(row),
                none.cast(pa.string()), none.cast(pa.int64()), column["block"].take(row), said], names)
    return run


def merge_stripes(rows: DataFrame, parts: int, min_count: int, reply: bool, tag: str) -> DataFrame:
    dealt = rows.repartition(parts, "lang", "prefix", "salt").select("lang", "prefix", "block", "nexts", "counts")
    return written(dealt.mapInArrow(_merged(min_count, reply), MERGED_SCHEMA), tag)


# -- phrases -----------------------------------------------------------------

def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
                  min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a): all phrases of one to five words that are there ``min_count`` times or
    more; and (lang, n): the words of each language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = written(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "phrase-blocks")
    hot = hot_words(blocks)
    parts = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    content = blocks.select("block", "lang", "words", "codes")
    one = merge_stripes(content.mapInArrow(_word_stripes(hot, parts), STRIPE_SCHEMA), parts, min_count, True,
                        "stripes-1")
    replies = one.where("kind = 1").select("block", "prefix", "nexts")
    more = merge_stripes(content.groupBy("block").cogroup(replies.groupBy("block"))
                         .applyInArrow(_phrase_stripes(hot, parts), STRIPE_SCHEMA), parts, min_count, False, "stripes-2")
    entries = one.where("kind = 0").union(more.where("kind = 0"))
    phrase = F.when(F.col("next") == "", F.col("prefix")).otherwise(
        F.concat_ws(" ", "prefix", F.translate("next", "\t", " ")))
    counts = entries.select("lang", phrase.alias("phrase"), "a").withColumn("m", F.size(F.split("phrase", " ")))
    return counts, blocks.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (its count), l and r (those of the
    parts of its weakest cut), n (all words), score (floor(1000 a n / (l r)) of that cut).

    Phrases that a longer one holds as often as they are there themselves do not count.
    """
    counts, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, min_count=min_count)
    counts = written(counts, "phrases")
    found = counts.where("m > 1").withColumn("w", F.split("phrase", " "))
    # A phrase of m + 2 words that holds this one as often holds one of m + 1 words that does too.
    parts = F.array(F.slice("w", 1, F.col("m") - 1), F.slice("w", 2, F.col("m") - 1))
    longest = (found.where("m > 2").select("lang", F.explode(parts).alias("inner"), "a")
               .groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("held")))
    kept = (found.join(longest, ["lang", "phrase"], "left")
            .where("held IS NULL OR held < a").select("lang", "phrase", "a", "m", "w"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"), "m", "w")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("tail"))
    of = counts.select("lang", "phrase", "a")
    cuts = (cuts.join(of.withColumnsRenamed({"phrase": "head", "a": "l"}), ["lang", "head"])
            .join(of.withColumnsRenamed({"phrase": "tail", "a": "r"}), ["lang", "tail"]).join(totals, "lang"))
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)))"
                   " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    weakest = (cuts.withColumn("score", score).groupBy("lang", "phrase")
               .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM words_of WHERE len(w) >= {m})"
        for m in range(1, LONGEST + 1))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words_of AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words_of GROUP BY lang),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inner_of AS (
  SELECT lang, a, unnest(list_transform(range(1, m - len_of + 2), lambda i: array_to_string(w[i:i + len_of - 1], ' '))) AS phrase
  FROM (SELECT *, unnest(range(2, m)) AS len_of FROM found)),
held AS (SELECT lang, phrase, max(a) AS held FROM inner_of GROUP BY ALL),
kept AS (SELECT f.* FROM found f LEFT JOIN held h USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * f.a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n,
         ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head
  JOIN counts y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}"""
