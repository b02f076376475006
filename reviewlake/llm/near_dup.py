"""Near-duplicate classes by ProbMinHash, banding and exact verification (operator 1).

A text is the weighted set of its shingles of five words (A-Z lower-cased, split
at ASCII white space), a weight being how often the shingle occurs. Every shingle
is a Poisson process of that rate whose arrivals fall on random registers; a
register keeps the shingle that arrives first, and a text's processes stop once
they are later than all its registers. Two registers agree with the probability
Jaccard similarity of the sets.

Texts that share a band of registers meet in a group; within it, whole signatures
are compared, and only the pairs of a spanning forest and of a few stars go on, at
most two per text, not all. Groups beyond ``GROUP`` texts are cut into parts of about
``GROUP``, and every two parts meet in a task of their own. Pairs are verified on the
whole texts by the exact probability Jaccard similarity; classes are the
connected components of verified pairs. Equal texts meet once, as one node.

Texts of a task whose proposed pairs failed while others are untried are sent whole to a
task that counts what every two of them share, which gives all their similarities at
once; it returns a forest of links, so failing pairs, however many, are never rows.

Defined cases: a null text is empty; texts with fewer than five words have one
shingle of all their words; texts without a word have no links but to equal
texts; a null id is smaller than all others; repeated rows are one class; an empty
table gives no rows; columns other than id and text are never looked at.
Equal texts are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.components import merged_components
from reviewlake.llm.storage import Rounds, written
from reviewlake.llm.textbytes import (LOWER, Chunk, byte_prefix_hash, chunks, distinct, mix, owners,
                                      prefix_hash, salted, span_hash, words)

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with probability 0.9998.
BANDS, BAND_ROWS = 28, 6
REGISTERS = BANDS * BAND_ROWS
#: Four standard deviations of the estimate at similarity 0.8.
MARGIN = 0.125
#: Texts of a part of a group; a task compares two parts at most.
GROUP = 1024
#: How many bands the first rounds take, before all of them.
FIRST_BANDS = (2, 8)
#: Text bytes whose shingles are held at once when pairs are verified, unless a pair has more.
VERIFY_BYTES = 1 << 20

NULL_ID = -(2 ** 63)
#: Text bytes of a part of the texts whose pairs are all told at once; a task holds two parts
#: at most, unless a text has more.
HELD_BYTES = 8 << 20
#: A shingle that a text in so many has is counted by a product of matrices, a rarer one by pairs.
DENSE = 16
#: Columns of such a product, and pairs counted at once.
COLUMNS, PAIRS = 512, 1 << 20
#: A task's band key and parts.
TASK = ["key", "low", "high"]
#: Bytes of a row of a group or of its ends, and of a text's registers and bands.
ROW_BYTES, NODE_BYTES = 40, 16 + 2 * REGISTERS + 8 * BANDS
SKETCH_SCHEMA = "id long, k long, sig binary, bands array<long>"


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, and the texts' bounds."""
    lowered = Chunk(chunk.first, LOWER[chunk.data], chunk.offs)
    starts, ends, bounds = words(lowered)
    prefix = prefix_hash(span_hash(byte_prefix_hash(lowered.data), starts, ends))
    count = np.diff(bounds)
    number = np.where(count >= SHINGLE_WORDS, count - SHINGLE_WORDS + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(number)))
    text = owners(out)
    first = np.arange(out[-1]) - out[text] + bounds[:-1][text]
    return span_hash(prefix, first, np.minimum(first + SHINGLE_WORDS, bounds[1:][text])), out


def weighted(shingle: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, shingle, weight; by text."""
    text = owners(bounds)
    key, first, number = distinct(salted(shingle, text))
    count = np.bincount(number, minlength=len(key))
    head = np.zeros(len(shingle), bool)
    head[first] = True
    return text[head], shingle[head], count[number[head]]


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers (n x REGISTERS) of texts 0..n-1, given by their weighted shingles."""
    arrival = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    time = np.zeros(len(text))
    latest = np.full(n, np.inf)
    step = 0
    while len(text):
        step += 1
        draw = mix(shingle + np.uint64(step * 0x9E3779B97F4A7C15 % 2 ** 64))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(uniform) / weight
        register = (mix(draw) % np.uint64(REGISTERS)).astype(np.int64) + text * REGISTERS
        np.minimum.at(arrival, register, time)
        first = arrival[register] == time
        holder[register[first]] = shingle[first]
        here = text[np.flatnonzero(np.append(True, text[1:] != text[:-1]))]
        latest[here] = arrival.reshape(n, REGISTERS)[here].max(axis=1)
        going = time < latest[text]
        text, shingle, weight, time = text[going], shingle[going], weight[going], time[going]
    return holder.reshape(n, REGISTERS)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets given by distinct ascending keys and weights."""
    every = np.union1d(a, b)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a)], v[np.searchsorted(every, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = u / v
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    both = (u > 0) & (v > 0)
    at = np.searchsorted(ratio, ratio[both])
    above = np.append(np.cumsum(u[::-1])[::-1], 0.0)[at]
    below = np.append(0.0, np.cumsum(v))[at]
    return float((1.0 / (above / u[both] + below / v[both])).sum())


def shared_sums(text: np.ndarray, key: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """n x n sums over the keys that texts i and j both have, of ``left`` of i. A text has
    a key once. Each key costs no more than the cheaper of its pairs and a column."""
    out = np.zeros((n, n), np.int32)
    order = np.argsort(key, kind="stable")
    key, text, left = key[order], text[order], left[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    size = np.diff(np.append(first, len(key)))
    wide = (size > 1) & (size * DENSE >= n)
    kind = np.float32 if left.max(initial=1) * COLUMNS < 1 << 24 else np.float64
    columns = np.flatnonzero(wide)
    for some in (columns[c:c + COLUMNS] for c in range(0, len(columns), COLUMNS)):
        column = np.repeat(np.arange(len(some)), size[some])
        at = np.arange(len(column)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + first[some][column]
        has, values = np.zeros((n, len(some)), kind), np.zeros((n, len(some)), kind)
        has[text[at], column], values[text[at], column] = 1, left[at]
        out += (values @ has.T).astype(np.int32)
    for f in np.unique(size[~wide & (size > 1)]).tolist():
        starts = first[~wide & (size == f)]
        step = max(1, PAIRS // f ** 2)
        for some in (starts[c:c + step, None] for c in range(0, len(starts), step)):
            at = some + np.arange(f)
            pairs = text[at][:, :, None] * n + text[at][:, None, :]
            np.add.at(out.reshape(-1), pairs.reshape(-1), np.repeat(left[at].reshape(-1), f))
    return out


def exact_links(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, label: np.ndarray,
                threshold: float) -> tuple[list[int], list[int]]:
    """Pairs of similarity ``threshold`` or more that connect what all such pairs of the texts
    connect, given by their weighted shingles; members of one ``label`` are connected already.

    With what two texts share, the sum of the lesser weights (least) and of the greater ones
    (most), and all = the sum of both texts' weights without least, the probability Jaccard
    similarity is between least / all and most / all: a shared shingle adds one over the sum of
    max(x_j / x_i, y_j / y_i), and that sum is between all / max(x_i, y_i) and
    all / min(x_i, y_i). The two are one number if no shared shingle's weights differ; if they
    lie on either side of the threshold, the pair itself is compared.
    """
    n, threshold = len(label), threshold - 1e-12
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    item = np.repeat(shingle, weight)
    item[nth > 0] = mix(item[nth > 0] + nth[nth > 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = shared_sums(np.repeat(text, weight), item, np.ones(len(item)), n)
    uneven = bool((weight > 1).any())
    own = shared_sums(text, shingle, weight, n) if uneven else least
    total = np.bincount(text, weight, n)
    bounds = np.searchsorted(text, np.arange(n + 1))
    component = np.unique(label, return_inverse=True)[1]
    out_a: list[int] = []
    out_b: list[int] = []

    def link(i: int, j: int) -> None:
        out_a.append(i)
        out_b.append(j)
        component[component == component[j]] = component[i]

    def every(i: int) -> np.ndarray:
        return np.maximum(total[i] + total - least[i], 1)

    def profile(i: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(bounds[i], bounds[i + 1])
        order = np.argsort(shingle[here])
        return shingle[here][order], weight[here][order]

    for i in range(n):
        for j in np.flatnonzero((component != component[i]) & (least[i] / every(i) >= threshold)).tolist():
            if component[i] != component[j]:
                link(i, j)
    for i in range(n) if uneven else ():
        most = own[i] + own[:, i] - least[i]
        open_ = (component != component[i]) & (most / every(i) >= threshold)
        for j in np.flatnonzero(open_[i + 1:]) + i + 1:
            if component[i] != component[j] and probability_jaccard(*profile(i), *profile(j)) >= threshold:
                link(i, int(j))
    return out_a, out_b


# -- steps -----------------------------------------------------------------

def text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def row_id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            shingle, bounds = shingles(chunk)
            text, shingle, weight = weighted(shingle, bounds)
            full = signatures(text, shingle, weight, len(chunk))
            bands = full.reshape(-1, BANDS, BAND_ROWS)
            key = np.zeros(bands.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(BAND_ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
            some = np.diff(bounds) > 0
            lists = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            short = (mix(full) >> np.uint64(48)).astype(np.uint16)
            here = slice(chunk.first, chunk.first + len(chunk))
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[here], batch.column(1)[here],
                pa.array([s.tobytes() if x else b"" for s, x in zip(short, some, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(key[some].reshape(-1).view(np.int64)))],
                ["id", "k", "sig", "bands"])


def _similar(sig: np.ndarray) -> np.ndarray:
    """Estimated similarities of all members of a group; -1 with itself."""
    if len(sig) < 64:
        equal = (sig[:, None, :] == sig[None]).sum(axis=2)
    else:       # register by register: no more than one byte per pair is held
        equal = np.zeros((len(sig), len(sig)), np.uint8)
        for register in np.ascontiguousarray(sig.T):
            equal += register[:, None] == register[None]
    out = equal.astype(np.float32) / sig.shape[1]
    np.fill_diagonal(out, -1)
    return out


def _group_pairs(sig: np.ndarray, label: np.ndarray, failed: Sequence[Sequence[int]],
                 forests: int = 1) -> tuple[list[int], list[int], list[int]]:
    """Pairs to verify among the members of a group (rows of ``sig``), and its leaders.
    Members of one ``label`` are connected already; ``failed`` pairs are not tried again.

    Classes are connected components, for which a spanning forest of the most
    similar pairs is enough: at any threshold it connects what all pairs do. As
    the similarities are estimates, stars are verified as well: the member that
    resembles most others leads them, then that which resembles most of the
    rest, and so on. At most two pairs per member. Further ``forests`` are taken from
    the pairs that are left, at most one more pair per member each.

    No pair is returned only if none of different labels is left to be tried.
    """
    n = len(sig)
    similar = _similar(sig)
    for i, others in enumerate(failed):
        if len(others):
            similar[i, others] = similar[others, i] = -1
    known = label[:, None] == label[None]
    np.fill_diagonal(known, False)
    similar[known] = 1
    out_a: list[int] = []
    out_b: list[int] = []

    def pair(i: int, j: int) -> None:
        if label[i] != label[j]:
            out_a.append(i)
            out_b.append(j)

    alike = similar >= SIMILARITY
    for _ in range(forests):
        # Prim's tree, without the branches too dissimilar to verify.
        before = len(out_a)
        best, to = similar[0].copy(), np.zeros(n, np.int64)
        outside = np.ones(n, bool)
        outside[0] = False
        for _ in range(n - 1):
            i = int(np.argmax(np.where(outside, best, -2)))
            outside[i] = False
            if best[i] >= SIMILARITY - MARGIN:
                pair(int(to[i]), i)
            closer = outside & (similar[i] > best)
            best[closer], to[closer] = similar[i][closer], i
        taken_a, taken_b = out_a[before:], out_b[before:]
        if not taken_a:
            break
        similar[taken_a, taken_b] = similar[taken_b, taken_a] = -1
    left, leaders = np.ones(n, bool), []
    follows = alike.sum(axis=1)
    while left.any():
        i = int(np.argmax(np.where(left, follows, -1)))
        if follows[i] == 0:
            leaders += np.flatnonzero(left).tolist()
            break
        star = np.flatnonzero(alike[i] & left)
        leaders.append(i)
        for j in star.tolist():
            pair(i, j)
        gone = np.append(star, i)
        left[gone] = False
        follows = follows - alike[:, gone].sum(axis=1)
    return leaders, out_a, out_b


def _task(group: pa.Table, tried: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sequence]:
    """Keys, signatures, labels and, per member, the places of those that it was tried with."""
    k = group.column("k").to_numpy()
    order = np.argsort(k)
    k = k[order]
    sig = np.stack([np.frombuffer(s, np.uint16) for s in group.column("sig").to_pylist()])[order]
    failed = [np.zeros(0, np.int64)] * len(k)
    if tried is not None and tried.num_rows:
        i, j = (np.searchsorted(k, tried.column(c).to_numpy()) for c in ("a", "b"))
        by = np.argsort(i, kind="stable")
        failed = np.split(j[by], np.searchsorted(i[by], np.arange(1, len(k))))
    return k, sig, group.column("label").to_numpy()[order], failed


def _untried(group: pa.Table, tried: pa.Table) -> pa.Table:
    """Members of a task with a pair left to be tried, in a set named by its members."""
    empty = pa.table({"set": pa.array([], pa.int64()), "k": pa.array([], pa.int64())})
    if not group.num_rows:
        return empty
    k, sig, label, failed = _task(group, tried)
    similar = _similar(sig)
    for i, others in enumerate(failed):
        if len(others):
            similar[i, others] = similar[others, i] = -1
    left = k[((similar >= SIMILARITY - MARGIN) & (label[:, None] != label[None])).any(axis=1)]
    name = mix(mix(left.view(np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)
    return pa.table({"set": pa.array(np.repeat(name, len(left))), "k": pa.array(left)})


def _linked(threshold: float):
    """A forest of the links among the texts of a set's two parts."""
    def run(group: pa.Table) -> pa.Table:
        k, label = (group.column(c).to_numpy() for c in ("k", "label"))
        found = []
        for chunk in chunks(group.column("text").combine_chunks()):
            text, shingle, weight = weighted(*shingles(chunk))
            found.append((text + chunk.first, shingle, weight))
        first, second = exact_links(*map(np.concatenate, zip(*found, strict=True)), label, threshold)
        return pa.table({"a": pa.array(k[first], pa.int64()), "b": pa.array(k[second], pa.int64())})
    return run


def _pairs_of_group(forests: int):
    """Pairs of one task by text key; ``tried``: the pairs that it has proposed before."""
    def run(group: pa.Table, tried: pa.Table | None = None) -> pa.Table:
        k, sig, label, failed = _task(group, tried)
        _, first, second = _group_pairs(sig, label, failed, forests)
        first, second = np.array(first, np.int64), np.array(second, np.int64)
        return pa.table({
            **{c: pa.array([group.column(c)[0].as_py()] * len(first), pa.int64()) for c in TASK},
            "a": pa.array(np.minimum(k[first], k[second]), pa.int64()),
            "b": pa.array(np.maximum(k[first], k[second]), pa.int64())})
    return run


def band_groups(nodes: DataFrame) -> DataFrame:
    """(key, band, k, parts, part): the texts that share a band with another, and the part of
    their group that they are in, written. nodes: k, bands."""
    rows = nodes.select("k", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.count("*").alias("n"))
    return written(rows.join(sizes.where("n > 1"), "key")
                   .select("key", "band", "k", "parts", part_of("k", "parts").alias("part")), "bands",
                   ROW_BYTES * BANDS * nodes.count())


def part_of(k: str, parts: str):
    return F.pmod(F.xxhash64(k, F.lit(GROUP)), F.col(parts))


def open_tasks(rows: DataFrame, labels: DataFrame, across: bool) -> DataFrame:
    """(key, low, high): the parts, or if ``across`` the pairs of parts, of each group whose
    members are not connected already. rows: key, k, parts, part; labels: k, label."""
    ends = rows.join(labels, "k").groupBy("key", "parts", "part").agg(
        F.min("label").alias("least"), F.max("label").alias("most"))
    if not across:
        return ends.where("least <> most").select("key", F.col("part").alias("low"), F.col("part").alias("high"))
    ends = written(ends, "parts", ROW_BYTES * rows.count())
    one = ends.where("parts = 1 and least <> most").select(
        "key", F.col("part").alias("low"), F.col("part").alias("high"))
    many = ends.where("parts > 1")
    low = many.select("key", F.col("part").alias("low"), F.col("least").alias("l"), F.col("most").alias("m"))
    high = many.select("key", F.col("part").alias("high"), "least", "most")
    return one.union(low.join(high, "key").where("low < high and least(l, least) <> greatest(m, most)")
                     .select(*TASK))


def dealt(rows: DataFrame, members: DataFrame, tasks: DataFrame):
    """The members of each task, grouped by it."""
    part = F.explode(F.array_distinct(F.array("low", "high"))).alias("part")
    return (rows.join(tasks.select(*TASK, part), ["key", "part"]).join(members, "k")
            .select(*TASK, "k", "sig", "label").groupBy(*TASK))


def tried_by(tasks: DataFrame, tried: DataFrame):
    """The pairs that each task has proposed before, grouped by it."""
    return tried.join(tasks, TASK, "left_semi").select(*TASK, "a", "b").distinct().groupBy(*TASK)


def candidate_pairs(rows: DataFrame, members: DataFrame, forests: int, across: bool = True,
                    tried: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) to verify, with the task (key, low, high) that found them; written.
    rows: key, k, parts, part; members: k, sig, label; tried: what tasks proposed before.

    A task holds two parts at most. Every two members of a group meet in a task if
    ``across``; else those of one part. What a task has tried goes to that task alone.
    """
    # Written, as two sides of what follows begin with them.
    tasks = written(open_tasks(rows, members.select("k", "label"), across), "tasks")
    schema = "key long, low long, high long, a long, b long"
    propose = _pairs_of_group(forests)
    group = dealt(rows, members, tasks)
    if tried is None:
        return written(group.applyInArrow(lambda x: propose(x), schema), "pairs")
    return written(group.cogroup(tried_by(tasks, tried)).applyInArrow(lambda x, y: propose(x, y), schema), "pairs")


def untried_sets(rows: DataFrame, members: DataFrame, last: DataFrame, tried: DataFrame) -> DataFrame:
    """(set, k): the members of each task that have a pair left to be tried; written. Tasks
    with the same such members are one set. A task without a pair among those of ``last``,
    the round before, has none left."""
    tasks = written(open_tasks(rows, members.select("k", "label"), True)
                    .join(last.select(*TASK).distinct(), TASK, "left_semi"), "tasks")
    return written(dealt(rows, members, tasks).cogroup(tried_by(tasks, tried))
                   .applyInArrow(lambda x, y: _untried(x, y), "set long, k long").distinct(), "untried")


def links_of_sets(sets: DataFrame, members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect what all links between two members of a set connect; written.

    Sets are cut into parts by the bytes of their texts and every two parts meet in a task.
    sets: set, k; members: k, label; texts: k, text.
    """
    sized = sets.join(texts.select("k", F.octet_length("text").alias("bytes")), "k")
    before = F.sum("bytes").over(Window.partitionBy("set").orderBy("k")) - F.col("bytes")
    parts = (sized.withColumn("part", F.floor(before / HELD_BYTES))
             .withColumn("parts", F.collect_set("part").over(Window.partitionBy("set"))))
    other = F.when(F.size("parts") == 1, F.col("parts")).otherwise(F.array_except("parts", F.array("part")))
    met = parts.select("set", "k", "part", F.explode(other).alias("other")).select(
        "set", "k", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    link = _linked(threshold)
    return written(met.join(members, "k").join(texts.select("k", F.coalesce("text", F.lit("")).alias("text")), "k")
                   .select("set", "low", "high", "k", "label", "text").groupBy("set", "low", "high")
                   .applyInArrow(lambda x: link(x), "a long, b long").distinct(), "links")


def _verified():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))
                              .fill_null(0).to_numpy(zero_copy_only=False)])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(size, size[start] + VERIFY_BYTES, "right")) - 1)
                sides = []
                for column in (2, 3):
                    profile = []
                    for chunk in chunks(batch.column(column)[start:end]):
                        shingle, bounds = shingles(chunk)
                        profile += [np.unique(shingle[bounds[i]:bounds[i + 1]], return_counts=True)
                                    for i in range(len(chunk))]
                    sides.append(profile)
                similar = [probability_jaccard(*x, *y) for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], batch.column(1)[start:end], pa.array(similar, pa.float64())],
                    ["a", "b", "similarity"])
                start = end
    return run


def near_duplicate_labels(docs: DataFrame, nodes: DataFrame, *, text_col: str,
                          threshold: float = SIMILARITY) -> DataFrame | None:
    """(node, component) of the texts with a verified link, by their keys; None without.

    Pairs are proposed and verified in rounds of pairs of different components. The
    first rounds take some bands only, and the pairs inside a part of a large group, for
    these connect most of a group; the last takes all bands and all pairs of parts. A pair
    is verified once, whichever tasks propose it. Members of a task that still have untried
    pairs then meet with their whole texts, so none is left.
    """
    rows = band_groups(nodes)
    # The text of each node that has a group, whatever the number of its copies.
    some = nodes.select("k", "id").join(rows.select("k").distinct(), "k", "left_semi")
    texts = written(docs.select(text_key(text_col).alias("k"), row_id("_id").alias("id"),
                                F.col(text_col).cast("string").alias("text"))
                    .join(some, ["k", "id"], "left_semi").dropDuplicates(["k"]), "texts")
    left = texts.select(F.col("k").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("text_b"))
    members = nodes.select("k", "sig", F.col("k").alias("label"))
    labels = None
    proposals, verified = Rounds(docs.sparkSession, "proposals"), Rounds(docs.sparkSession, "verified")
    large = not rows.where("parts > 1").isEmpty()
    stages = [(n, not large) for n in (*FIRST_BANDS, BANDS)] + [(BANDS, True)] * large
    for bands, across in stages:
        proposed = candidate_pairs(rows.where(F.col("band") < bands), members, 1, across, proposals.all())
        if proposed.isEmpty():
            continue
        pairs = proposed.select("a", "b").distinct()
        if verified.all() is not None:
            pairs = pairs.join(verified.all().select("a", "b"), ["a", "b"], "left_anti")
        got = verified.add(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
                           .mapInArrow(_verified(), "a long, b long, similarity double"))
        proposals.add(proposed)
        new = got.where(F.col("similarity") >= threshold - 1e-12).select("a", "b")
        if not new.isEmpty():
            labels = merged_components(labels, new)
            members = (nodes.select("k", "sig").join(labels.withColumnRenamed("node", "k"), "k", "left")
                       .select("k", "sig", F.coalesce("component", "k").alias("label")))
    if proposed.isEmpty():
        return labels
    sets = untried_sets(rows, members, proposed, proposals.all())
    if sets.isEmpty():
        return labels
    new = links_of_sets(sets, members.select("k", "label"), texts, threshold)
    return labels if new.isEmpty() else merged_components(labels, new)


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: id, k (key of its text), class_id (least id of its class),
    representative (the one row kept of a class; of repeated rows all carry the mark)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    made = rows.select(row_id("_id").alias("id"), text_key("_text").alias("k"), "_text")
    sketches = written(made.mapInArrow(_sketch, SKETCH_SCHEMA), "sketches")
    nodes = written(sketches.groupBy("k").agg(F.min("id").alias("id"), F.first("sig").alias("sig"),
                                              F.first("bands").alias("bands")), "nodes",
                    NODE_BYTES * sketches.count())
    found = near_duplicate_labels(rows, nodes, text_col="_text", threshold=threshold)
    labelled = nodes.select("k", "id")
    labelled = (labelled.withColumn("component", F.col("k")) if found is None else
                labelled.join(found.select(F.col("node").alias("k"), "component"), "k", "left")
                .withColumn("component", F.coalesce("component", "k")))
    least = labelled.groupBy("component").agg(F.min(F.struct("id", "k")).alias("first"))
    classes = labelled.join(least, "component").select(
        "k", F.col("first.id").alias("class_id"), F.col("first.k").alias("first_k"))
    return sketches.select("id", "k").join(classes, "k").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "k",
        F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"),
        ((F.col("id") == F.col("class_id")) & (F.col("k") == F.col("first_k"))).alias("representative"))


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the least id, with all its columns."""
    kept = (near_duplicate_classes(docs, id_col=id_col, text_col=text_col).where("representative")
            .select(F.coalesce(id_col, F.lit(NULL_ID)).alias("_near_id"), F.col("k").alias("_near_k"))
            .distinct())
    keyed = docs.withColumns({"_near_id": row_id(id_col), "_near_k": text_key(text_col)})
    return (keyed.join(kept, ["_near_id", "_near_k"], "left_semi")
            .dropDuplicates(["_near_id", "_near_k"]).select(*docs.columns))
