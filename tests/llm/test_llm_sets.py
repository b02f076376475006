"""Near-dedup, decontamination, archives, quotations, main text and URL rules."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F


def prose(seed, n):
    r = random.Random(seed)
    syllables = ["ti", "on", "er", "ka", "th", "lu", "mo", "za"]
    return [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(60))
            for _ in range(n)]


def edited(text, at, word="changed"):
    w = text.split()
    w[at] = word
    return " ".join(w)


def test_near_duplicates(spark):
    from reviewlake.llm.near_dup import (keep_representatives, near_duplicate_classes,
                                         probability_jaccard, shingles, weighted)
    base = prose(1, 12)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, edited(base[0], 59)), (102, edited(edited(base[0], 59), 0)),
             (103, base[1].upper()), (104, None), (105, ""), (106, "a b"), (107, "a b"), (108, "a c"),
             (None, base[2]), (100, base[0]), (109, " ".join(base[3].split()[:30] + base[4].split()[30:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    want = {i: i for i, _ in rows} | {100: 0, 101: 0, 102: 0, 103: 1, 107: 106, 105: 104, 2: None}
    assert got == want
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == sorted(
        {v if v is not None else -1 for v in want.values()})
    assert near_duplicate_classes(docs.limit(0)).isEmpty()
    del shingles, weighted, probability_jaccard


def test_probability_jaccard_and_signatures():
    import numpy as np
    import pyarrow as pa

    from reviewlake.llm.near_dup import probability_jaccard, shingles, signatures, weighted
    from reviewlake.llm.textbytes import chunks
    r = random.Random(4)
    for _ in range(50):
        u = {k: r.randint(1, 5) for k in r.sample(range(20), 8)}
        v = {k: r.randint(1, 5) for k in r.sample(range(20), 8)}
        want = sum(1 / sum(max(u.get(y, 0) / u[x], v.get(y, 0) / v[x]) for y in {*u, *v}) for x in {*u} & {*v})
        a, b = (np.array(sorted(m), np.uint64) for m in (u, v))
        got = probability_jaccard(a, np.array([u[int(k)] for k in a]), b, np.array([v[int(k)] for k in b]))
        assert abs(got - want) < 1e-12
    x = prose(7, 1)[0] + " " + prose(8, 1)[0]
    near = []
    for s in range(40):         # the estimate is unbiased
        y = edited(edited(x, s), 100 - s)
        chunk = next(iter(chunks(pa.array([x, y]))))
        sh, bounds = shingles(chunk)
        sig = signatures(*weighted(sh, bounds), 2)
        exact = probability_jaccard(*np.unique(sh[:bounds[1]], return_counts=True),
                                    *np.unique(sh[bounds[1]:], return_counts=True))
        near.append((sig[0] == sig[1]).mean() - exact)
    assert abs(sum(near) / len(near)) < 0.03


def test_group_pairs_keep_components():
    import numpy as np

    from reviewlake.llm.near_dup import REGISTERS, _group_pairs
    r = np.random.default_rng(3)
    centre = r.integers(0, 60000, (5, REGISTERS)).astype(np.uint16)
    which = r.integers(0, 5, 300)
    sig = centre[which]
    noise = r.random(sig.shape) < 0.07
    sig = np.where(noise, r.integers(0, 60000, sig.shape).astype(np.uint16), sig)
    _, a, b = _group_pairs(sig, np.arange(300), [[]] * 300)
    assert len(a) <= 2 * 300
    label = np.arange(300)
    for i, j in zip(a, b, strict=True):
        label[label == label[i]] = label[j]
    assert all(len(set(label[which == c])) == 1 for c in range(5)) and len(set(label)) == 5


def test_near_duplicates_whose_first_pairs_fail(spark):
    from reviewlake.llm.near_dup import near_duplicate_classes
    # Seed 6: A-B and B-C are estimated higher than A-C, and A-C alone is at least 0.8.
    r = random.Random(6)
    a = [f"w{r.randrange(10**9)}" for _ in range(400)]
    at = r.sample(range(10, 390, 10), 9)
    b, c = a[:], a[:]
    for n, i in enumerate(at):
        b[i] = f"b{i}"
        if n < 8:
            c[i] = f"c{i}"
    rows = [(k, " ".join(t)) for k, t in enumerate((a, b, c))]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.class_id for x in got.collect()} == {0: 0, 1: 1, 2: 0}


def _rounds(spark, sigs):
    """Classes of signatures that share one band, pairs verified by the signatures themselves,
    and the largest number of texts among the pairs of a task. No task tries a pair twice."""
    from reviewlake.llm.near_dup import band_groups, candidate_pairs
    n = len(sigs)
    nodes = spark.createDataFrame([(k, bytearray(s.tobytes()), [5]) for k, s in enumerate(sigs)],
                                  "k long, sig binary, bands array<long>")
    rows, label, tried, most, every = band_groups(nodes), list(range(n)), None, 0, Counter()
    while True:
        state = spark.createDataFrame(list(enumerate(label)), "k long, label long")
        proposed = candidate_pairs(rows, nodes.select("k", "sig").join(state, "k"), 4, tried=tried)
        tried = proposed if tried is None else tried.union(proposed)
        got = set(proposed.collect())
        every.update(got)
        assert max(every.values(), default=1) == 1
        if not got:
            return label, most
        tasks = {}
        for x in got:
            tasks.setdefault(tuple(x[:-2]), set()).update((x.a, x.b))
            if (sigs[x.a] == sigs[x.b]).mean() >= 0.8:
                old, new = sorted((label[x.a], label[x.b]), reverse=True)
                label = [new if v == old else v for v in label]
        most = max(most, *map(len, tasks.values()))


def test_large_groups_meet_part_by_part(spark, monkeypatch):
    import numpy as np

    from reviewlake.llm import near_dup
    monkeypatch.setattr(near_dup, "GROUP", 16)
    r = np.random.default_rng(1)

    def changed(sig, registers):
        out = sig.copy()
        out[registers] = r.integers(0, 60000, len(registers))
        return out
    # Two families joined by X and Y alone, which are no leaders of their stars.
    one = r.integers(0, 60000, near_dup.REGISTERS).astype(np.uint16)
    x = changed(one, np.arange(25))
    y = changed(x, np.arange(25, 42))
    two = changed(y, np.arange(42, 67))
    sigs = [changed(one, 70 + r.integers(0, 90, 3)) for _ in range(20)]
    sigs += [changed(two, 70 + r.integers(0, 90, 3)) for _ in range(20)]
    for k in range(4):          # whichever parts X and Y fall in
        label, _ = _rounds(spark, [*sigs, x, *[one] * k, y])
        assert len(set(label)) == 1


def test_tasks_hold_two_parts_at_most(spark, monkeypatch):
    import numpy as np

    from reviewlake.llm import near_dup
    monkeypatch.setattr(near_dup, "GROUP", 16)
    r = np.random.default_rng(2)
    # Copies edited independently from one template, about 0.7 to each other: no pair links.
    template = r.integers(0, 60000, near_dup.REGISTERS)
    sigs = [np.where(r.random(near_dup.REGISTERS) < 0.16, r.integers(0, 60000, near_dup.REGISTERS),
                     template).astype(np.uint16) for _ in range(150)]
    label, most = _rounds(spark, sigs)
    alike = np.array([[(a == b).mean() >= 0.8 for b in sigs] for a in sigs])
    want = np.arange(len(sigs))
    for i, j in np.argwhere(alike):
        want[want == want[i]] = want[j]
    assert Counter(Counter(label).values()) == Counter(Counter(want.tolist()).values())
    parts = Counter(x.part for x in near_dup.band_groups(spark.createDataFrame(
        [(k, [5]) for k in range(len(sigs))], "k long, bands array<long>")).collect())
    assert most <= sum(sorted(parts.values())[-2:]) < 4 * 16


def test_classes_equal_those_of_all_pairs(spark):
    from reviewlake.llm import near_dup
    r = random.Random(12)
    rows = []
    for family in range(6):         # copies edited more and more, some below the threshold
        base = [f"f{family}w{r.randrange(10 ** 6)}" for _ in range(150)]
        for _ in range(25):
            words = base[:]
            for i in r.sample(range(150), r.randint(0, 7)):
                words[i] = f"x{r.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(words)))
    import pyarrow as pa
    chunk = next(iter(near_dup.chunks(pa.array([t for _, t in rows]))))
    shingle, bounds = near_dup.shingles(chunk)
    import numpy as np
    sets = [np.unique(shingle[bounds[i]:bounds[i + 1]], return_counts=True) for i in range(len(rows))]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and near_dup.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if v == old else v for v in want]
    got = near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.class_id for x in got.collect()} == dict(enumerate(want))
    assert 6 < len(set(want)) < len(rows)


def test_links_of_all_pairs_at_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from reviewlake.llm import near_dup
    from reviewlake.llm.near_dup import exact_links, probability_jaccard, shared_sums
    r = np.random.default_rng(7)
    text, key = np.unique(r.integers(0, 60, (2000, 2)) * [1, 7], axis=0).T
    weight = r.integers(1, 9, len(text))
    want = np.zeros((60, 60), np.int64)
    for i in range(60):
        for j in range(60):
            want[i, j] = weight[(text == i) & np.isin(key, key[text == j])].sum()
    for dense in (1, 4, 1000):
        monkeypatch.setattr(near_dup, "DENSE", dense)
        got = shared_sums(text, key.astype(np.uint64), weight, 60)
        np.fill_diagonal(got, 0)
        assert (got == want - np.diag(np.diag(want))).all()
    monkeypatch.setattr(near_dup, "COLUMNS", 7)
    mixed = 0
    for heaviest in (1, 2, 6):  # weights of one, which the bounds settle, and others
        sets = [{int(k): int(r.integers(1, heaviest + 1)) if r.random() < 0.1 else 1
                 for k in r.choice(26, 24, replace=False)} for _ in range(40)]
        cells = [(i, k, w) for i, s in enumerate(sets) for k, w in s.items()]
        text, key, weight = (np.array(c) for c in zip(*cells, strict=True))
        label = np.arange(40)
        label[5] = label[9]
        a, b = exact_links(text, key.astype(np.uint64), weight, label, 0.85)
        got, want = label.copy(), label.copy()
        for i, j in zip(a, b, strict=True):
            got[got == got[j]] = got[i]
        assert len(a) == len(set(label)) - len(set(got))
        flat = [(np.array(sorted(s)), np.array([s[k] for k in sorted(s)])) for s in sets]
        for i in range(40):
            for j in range(i):
                if probability_jaccard(*flat[i], *flat[j]) >= 0.85 - 1e-12:
                    want[want == want[j]] = want[i]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
        mixed += 2 < len(set(got)) < 38
    assert mixed


def test_failing_pairs_of_a_group_are_never_rows(spark, monkeypatch):
    from reviewlake.llm import near_dup
    # Copies edited independently, most below 0.8 to each other: nearly all pairs fail.
    r = random.Random(5)
    base = [f"w{r.randrange(10 ** 9)}" for _ in range(400)]
    rows = []
    for k in range(90):
        words = base[:]
        for i in r.sample(range(0, 400, 5), 6 if k < 86 else 4):
            words[i] = f"x{r.randrange(10 ** 9)}"
        rows.append((k, " ".join(words)))
    made, held, add = [], [], near_dup.Rounds.add
    monkeypatch.setattr(near_dup.Rounds, "add", lambda self, df: made.append(add(self, df)) or made[-1])
    whole = near_dup.links_of_sets
    monkeypatch.setattr(near_dup, "links_of_sets", lambda *x: held.append(x[0]) or whole(*x))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for size in (near_dup.HELD_BYTES, 20_000):      # in one part, and in pairs of parts
        monkeypatch.setattr(near_dup, "HELD_BYTES", size)
        got[size] = {x.doc_id: x.class_id for x in near_dup.near_duplicate_classes(docs).collect()}
    import numpy as np
    import pyarrow as pa
    text, bounds = near_dup.shingles(next(iter(near_dup.chunks(pa.array([t for _, t in rows])))))
    sets = [np.unique(text[bounds[i]:bounds[i + 1]], return_counts=True) for i in range(90)]
    want = list(range(90))
    for i in range(90):
        for j in range(i):
            if want[i] != want[j] and near_dup.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if v == old else v for v in want]
    assert all(x == dict(enumerate(want)) for x in got.values())
    assert 40 < len(set(want)) < 90 and held and held[0].count()
    verified = [x.select("a", "b").distinct().count() for x in made if "similarity" in x.columns]
    # Three rounds a run, whose verified pairs are a small part of all pairs.
    assert len(verified) == 2 * 3 and all(0 < sum(verified[n:n + 3]) < 90 * 89 / 2 / 4 for n in (0, 3))


def test_components(spark):
    from reviewlake.llm.components import components
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, r.randint(101, 130)) for _ in range(20)] + [(7, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_decontamination(spark):
    from reviewlake.llm.decontaminate import drop_contaminated, find_contaminated
    items = [f"{q[:200]}. {a[:80]}." for q, a in zip(prose(11, 8), prose(12, 8), strict=True)]
    clean = prose(13, 30)
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100 + k, f"{clean[k]} {items[k].upper()} {clean[k + 1]}") for k in range(5)]
    docs += [(200, items[5].rsplit(".", 2)[0]),                     # without its answer
             (201, None), (202, ""), (203, clean[0] + " " + " ".join(clean * 20) + " " + items[6]),
             (None, items[7]), (204, " ".join(reversed(items[6].split())))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, items[0])],
                                  "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in find_contaminated(docs, bench).collect())
    assert got == Counter([(100 + k, k) for k in range(5)] + [(100, 52), (203, 6), (None, 7)])
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 7
    assert find_contaminated(docs.limit(0), bench).isEmpty()
    assert find_contaminated(docs, bench.limit(0)).isEmpty()


def test_decontamination_finds_every_planted_item(spark):
    from reviewlake.llm.decontaminate import find_contaminated
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if b.text in t}
    assert want <= {(r.doc_id, r.item_id) for r in find_contaminated(docs, bench).collect()}


def test_loser_tree():
    from reviewlake.llm.warc import LoserTree
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(r.choices(range(50), k=r.randint(0, 9))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(sum(runs, []))


def test_archive_round_trip(spark):
    from reviewlake.llm.warc import archive_round_trip
    rows = [(1, "http://a.b/x", "hi\r\n\r\nWARC/1.1"), (2, None, None), (3, "http://a.b/x", "hi\r\n\r\nWARC/1.1"),
            (4, "HTTP://Q\n.z", ""), (None, "u", "é"), (5, "u", "é"), (6, "http://a.b/x", "é" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = archive_round_trip(pages).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    for r in got:
        h = next((x[2] or "" for x in rows if x[0] == r.page_id)).encode()
        of = first[h.decode()]
        assert (r.payload_bytes, r.payload_digest) == (
            len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if of == r.page_id else ("revisit", of))
    order = sorted(got, key=lambda r: r.place_in_index)
    assert [r.place_in_index for r in order] == list(range(len(rows)))
    keys = [(r.url_key, r.captured_at) for r in order]
    assert keys == sorted(keys)
    small = archive_round_trip(pages, min_bytes=3).where("payload_bytes < 3")
    assert small.where("record_type <> 'response'").isEmpty()
    assert archive_round_trip(pages.limit(0)).isEmpty()


def test_quotations(spark):
    from reviewlake.llm.quotations import reply_conversations
    rows = [(1, 0, "Hello there.\nSecond line\n\nPara two"), (1, 1, "> Hello there.\n> Second line\n\nMy answer"),
            (1, 2, ">> Hello  THERE.\n>> second line\n> My answer\nThanks"), (1, 3, "> para two\nabout it"),
            (1, 4, "ok"), (1, 5, None), (1, 6, "> second line\nhm"), (2, 0, ">Para two\nx"), (2, None, "first"),
            (None, 1, "q"), (None, 0, "p"), (3, 0, "dup"), (3, 0, "dup"), (4, 0, "> never said")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").select(
        "conv_id", "turn", F.lit("user").alias("role"), "text", F.lit(1).alias("reply_depth"))
    got = {(r.conv_id, r.turn, r.reply_order): r for r in reply_conversations(df).collect()}
    assert len(got) == len(rows)
    one = sorted((r for (c, _, _), r in got.items() if c == 1), key=lambda r: r.reply_order)
    assert [(r.turn, r.answers_turn, r.reply_depth) for r in one] == [
        (0, None, 0), (1, 0, 1), (3, 0, 1), (6, 0, 1), (2, 1, 2), (4, 3, 2), (5, 4, 3)]
    assert [r.own_text for r in one] == ["Hello there.\nSecond line\n\nPara two", "My answer", "about it", "hm",
                                         "Thanks", "ok", ""]
    assert [(r.quote_depth, r.n_quotes, r.n_linked) for r in one if r.turn == 2] == [(2, 2, 2)]
    assert [r.n_linked for (c, _, _), r in got.items() if c == 2 and r.n_quotes] == [1]
    assert [r.n_linked for (c, _, _), r in got.items() if c == 4] == [0]
    assert reply_conversations(df.limit(0)).isEmpty()


def test_long_branches(spark):
    from reviewlake.llm.quotations import reply_conversations
    r, rows, said, depth = random.Random(2), [], [], []
    for t in range(60):
        to = r.randrange(t) if t and r.random() < 0.6 else t - 1
        quote = f"> words of turn {to}\n" if to != t - 1 else ""
        depth.append(depth[to] + 1 if t else 0)
        said.append(to)
        rows.append((1, t, "user", f"{quote}words of turn {t}"))
    got = {x.turn: x for x in reply_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_depth for t in range(60)] == depth
    assert [got[t].answers_turn for t in range(1, 60)] == said[1:]
    order = sorted(range(60), key=lambda t: (depth[t], t))
    assert [got[t].reply_order for t in order] == list(range(60))


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>x</a></ul></nav><div id="cookie-notice">We use cookies, really, we do</div>
<div class="layout"><div class=sidebar><p>Side, bar, bar</div><div class="content"><h1>Title</h1>
<p>Para one, with text &amp; more&hellip;<p>Two <b>bold</b>
 text.<br>after<ul><li>item one<li>item two</ul><form><p>Sub</p></form><pre>a  b</pre></div>
<section class="comments"><p>Nice, article, really, good.</p></section></div><footer>f</footer>"""


@pytest.mark.parametrize(("page", "want"), [
    (PAGE, ["Title", "Para one, with text & more…", "Two bold text. after", "item one", "item two", "a b"]),
    ("", []), ("plain text", ["plain text"]), ("<p>a<p>b", ["a", "b"]),
    ("<div>1 < 2 &lt;x&gt;</div><script>var a='<p>'</script>", ["1 < 2 <x>"]),
    ("<article><h1>H</h1><p><b>x.<br><p>y</p></article><footer>z, z, z, z, z, z</footer>", ["H", "x.", "y"])])
def test_main_blocks(page, want):
    from reviewlake.llm.main_text import main_blocks
    assert main_blocks(page) == want


@pytest.mark.parametrize("size", [20, 150])
def test_main_blocks_of_two_wrappers(size):
    from reviewlake.llm.main_text import main_blocks
    text = ["".join(f"{n}{i}" for i in range(size // 2)) + ", x" for n in "abcdef"]
    p = [f"<p>{t}</p>" for t in text]
    menu = "<ul><li><a href=/x>one</a><li><a href=/x>two</a><li><a href=/x>three</a></ul>"
    body = f"<div><div>{''.join(p[:4])}</div></div><div>{''.join(p[4:])}</div><p>Short.</p><ul><li>item</ul>"
    want = [*text, "Short.", "item"]
    assert main_blocks(f"<body>{menu}{body}<div class=sidebar><p>Side, bar, bar</p></div></body>") == want
    assert main_blocks(f"<body>{menu}<div class=page>{menu}{body}</div></body>") == want


def test_main_texts_rows(spark):
    from reviewlake.llm.main_text import main_texts
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>é x</p>"), (2, "v", "<p>" + "w, " * 50000)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")
                     .withColumn("text", F.lit("clash"))).collect()
    assert Counter((r.page_id, r.text[:5], r.n_chars) for r in got) == Counter(
        [(1, "", 0), (1, "", 0), (None, "é x", 3), (2, "w, w,", 3 * 50000 - 1)])


def test_url_rules(spark):
    from reviewlake.llm.url_filter import judge_urls
    rows = [(1, None), (2, "x"), (3, "HTTP://Q.ORG"), (4, "a://b.org/x?y://z"), (5, "https://example.org/es/1"),
            (6, "https://m.example.org/en/12#f"), (7, "http://notexample.org/en/1"), (8, "http://a.com/de/x"),
            (9, "http://A.COM/fr/"), (9, "http://A.COM/fr/"), (10, "http://b.net/fr/x")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)))
    assert got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert [(by[i].host, by[i].path, by[i].rule) for i in range(1, 11)] == [
        ("", "", None), ("", "", None), ("q.org", "", None), ("b.org", "/x", "org/"),
        ("example.org", "/es/1", "example.org/es/"), ("m.example.org", "/en/12", "example.org/en/1"),
        ("notexample.org", "/en/1", "org/"), ("a.com", "/de/x", "com/de/"), ("a.com", "/fr/", "com/fr/"),
        ("b.net", "/fr/x", None)]
    assert [by[i].verdict for i in (4, 5, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert judge_urls(got.select("page_id", F.lit("u").alias("url")).limit(0)).isEmpty()


def test_native_operators_plan_no_python(spark):
    from reviewlake.llm.quotations import reply_conversations
    from reviewlake.llm.url_filter import judge_urls
    d = "/root/testdata/sf0.001"
    for df in (judge_urls(spark.read.parquet(f"{d}/pages.parquet")),
               reply_conversations(spark.read.parquet(f"{d}/conversations.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_pipeline_stages(spark):
    import corpus_pipeline
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
