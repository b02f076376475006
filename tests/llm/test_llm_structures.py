"""Conversation repair, byte-trie dedup and phrase mining against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

BLANK = re.compile(r"[^\x20\x09-\x0D]")


# -- conversations ---------------------------------------------------------

def brute_repair(rows):
    """Counts, cost, audit and digest of one conversation's rows (turn, role, text), in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = BLANK.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else
                      "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1] or "")[:1] + (b[1] or "")[:1] for a, b in itertools.pairwise(rows)]
    # Dijkstra over (rows used, wanted sequence's state), audits in the key.
    go = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for r, name in (("u", "user"), ("a", "assistant")):
            if state in go[r]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, go[r][state], (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                initial = (role or "")[:1]
                if state in go.get(initial, {}):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, go[initial][state],
                                          (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if state in go[r]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, go[r][state],
                                              (*lines, f"{name}:{text}")))
    n = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"],
            n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, text = zlib.crc32(key.encode()) % 20, text or ""
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2].encode()))
    return out


def odd_conversations(n, seed=1):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", " \n\t", "", None, "Same again.", "é 漢.", "Fine.  \n"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.choice([1, 2, 3, 5, 8, 13])):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""])
            rows.append((conv, None if r.random() < .05 else turn + 3 * (r.random() < .1), role,
                         r.choice(texts) if r.random() < .5 else f"{r.random()}" + r.choice([".", ""])))
    return rows + rows[:7]


CONVERSATION = "conv_id long, turn long, role string, text string"


def repaired(frame):
    from reviewlake.llm.conversation_repair import repair_damaged
    return {r[0]: tuple(r)[1:] for r in repair_damaged(frame).collect()}


def test_conversations_are_repaired_as_by_search(spark):
    rows = odd_conversations(150)
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, CONVERSATION).withColumn("cost", F.lit("x"))
    got = repaired(frame.repartition(4))
    assert got == {k: brute_repair(v) for k, v in brute_damage(rows).items()}
    assert repaired(frame.limit(0)) == {}


def test_a_long_conversation_is_spread_over_tasks(spark):
    from reviewlake.llm.conversation_repair import damaged, repair_conversations
    r = random.Random(3)
    rows = [(9, t, r.choice(["user", "assistant", "user", "system"]), f"said {t}" + r.choice([".", ".", ""]))
            for t in range(700)] + [(9, 700, "user", "word " * 60_000 + ".")] + odd_conversations(5)
    frame = spark.createDataFrame(rows, CONVERSATION)
    got = repair_conversations(damaged(frame), parts=13).where("conv_id = 9").collect()
    assert tuple(got[0])[1:] == brute_repair(brute_damage(rows)[9])


def test_repair_sql_agrees(spark):
    import duckdb

    from reviewlake.llm.conversation_repair import oracle_sql
    rows = odd_conversations(40, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {x[0]: x[1:] for x in con.sql(oracle_sql()).fetchall()}
    assert got == {k: brute_repair(v) for k, v in brute_damage(rows).items()}


def test_chart_cells_of_a_split_are_those_of_any_other():
    from reviewlake.llm.conversation_repair import combine, deleted, parse, row_cells
    r = random.Random(4)
    leaves = [row_cells(r.choice("suat"), r.choice(["", "", "truncated", "duplicate"])) for _ in range(9)]
    whole = parse(leaves)
    for k in range(1, 9):
        assert combine(parse(leaves[:k]), parse(leaves[k:])) == whole
    assert deleted(6) == parse([row_cells("", "blank")] * 6)


# -- exact copies ----------------------------------------------------------

def copies(seed=1, n=300):
    r = random.Random(seed)
    base = [None, "", " ", "a", "a b", "a  b", "a\t\nb", " a b", "ab", "abc", "abcd", "é", "e\u0301", "x" * 70_000]
    base += [" ".join(r.choice(["same", "start", "of", "text", "é"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = [(i, r.choice(base[:4] * 9 + base)) for i in range(n)]
    return rows + rows[:20] + [(None, "a b"), (None, "only here"), (None, "only here")]


def brute_copies(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = Counter()
    for text, docs in groups.items():
        docs.sort(key=lambda d: (d is None, d))
        for k, doc in enumerate(docs):
            out[doc, docs[0], len(docs), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("budget", [1 << 26, 3000])
def test_exact_duplicates(spark, monkeypatch, budget):
    from reviewlake.llm import patricia
    monkeypatch.setattr(patricia, "PARTITION_BYTES", 40_000)
    rows = copies()
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("x"))
    got = patricia.exact_duplicates(docs.repartition(5), trie_bytes=budget)
    assert Counter(map(tuple, got.collect())) == brute_copies(rows)
    assert patricia.exact_duplicates(docs.limit(0)).isEmpty()


def test_copies_of_one_text_are_dealt_to_several_tasks(spark, monkeypatch):
    from reviewlake.llm import patricia
    monkeypatch.setattr(patricia, "COPY_BYTES", 100)
    rows = [(i, "the same text of forty bytes or a few more") for i in range(90)] + [(100 + i, f"other {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    texts = spark.createDataFrame([(o, 42, 5, bytearray(b"t" * 42), o, 1) for o in range(40)],
                                  "owner long, length long, hash long, text binary, least long, n long")
    assert patricia.salted_copies(texts).agg(F.max("salts")).first()[0] == 17
    assert {(r.owner, r.least, r.n) for r in patricia.owners(texts, 4).collect()} == {(o, 0, 40) for o in range(40)}
    assert Counter(map(tuple, patricia.exact_duplicates(docs).collect())) == brute_copies(rows)


def test_trie_against_a_dict():
    from reviewlake.llm.patricia import Trie
    r = random.Random(6)
    for budget in (10 ** 9, 6000, 1500):
        trie, inside, outside = Trie(), {}, set()
        for _ in range(3000):
            key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) * r.choice([1, 1, 20])
            got = trie.insert(key, lambda key=key: key)
            assert got in (key, None)
            if got is None:
                outside.add(key)
            else:
                assert key not in outside
                inside[key] = True
            while trie.root.weight > budget:
                gone = list(trie.spill())
                if not gone:
                    break
                for k, v in gone:
                    assert k == v and inside.pop(k)
                    outside.add(k)
        left = list(trie.items())
        assert sorted(left) == sorted(inside) and not outside & set(inside) and left
        assert budget < 10 ** 9 or not outside

        def weight(node):
            from reviewlake.llm.patricia import NODE_BYTES
            assert node.weight == NODE_BYTES + len(node.label) + sum(weight(c) for c in node.children.values())
            return node.weight
        weight(trie.root)


# -- collocations ----------------------------------------------------------

def brute_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", text):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, f in counts.items():
        held, scored = {}, []
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 2 <= j - i < len(p):
                    held[p[i:j]] = max(held.get(p[i:j], 0), a)
        for p, a in found.items():
            if 100 * held.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1): (p.decode(), -a, left, right, n[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])}
    return out


def speech(seed, n):
    r = random.Random(seed)
    words = ["The", "of", "ti", "on", "é", "a\u00a0b", "x" * 30] + [f"w{i}" for i in range(25)]
    weights = [60, 30, 9, 9, 9, 4, 2] + [3] * 25
    langs = ["en", "en", "en", "de", None, "und"]
    rows = []
    for _ in range(n):
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"])
                       for w in r.choices(words, weights, k=r.randint(0, 40)))
        if r.random() < .2:
            text += "as a matter of fact we SAY the the the the."
        rows.append((r.choice(langs), text))
    return rows + rows[:9] + [("en", None), ("en", ""), ("en", " ..\n"), ("xx", "only"), ("xx", "of " * 500)]


@pytest.mark.parametrize("block", [1 << 23, 900])
def test_collocations(spark, monkeypatch, block):
    from reviewlake.llm import collocations as c
    monkeypatch.setattr(c, "BLOCK_BYTES", block)
    monkeypatch.setattr(c, "PART_BYTES", block)
    rows = speech(1, 400)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit("x")).repartition(3)
    for least, top in ((5, 10 ** 6), (12, 20)):
        got = {(r.lang, r["rank"]): tuple(r)[2:] for r in c.collocations(docs, min_count=least, top=top).collect()}
        assert got == brute_collocations(rows, least, top)
    assert c.collocations(docs.limit(0)).isEmpty()


def test_hot_prefixes_are_cut_by_the_following_word(spark, monkeypatch):
    from reviewlake.llm import collocations as c
    monkeypatch.setattr(c, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame(speech(2, 200), "lang string, text string")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = c.written(rows.mapInArrow(c._blocks, c.BLOCK_SCHEMA), "test-blocks")
    hot = c.hot_words(blocks)
    total = Counter()
    for lang, text in rows.collect():
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)
        total.update((lang, w) for w in re.findall("[^\\x20\\x09\\x0A-\\x0D.,;:!?]+", text))
    n = sum(total.values())
    # Every word of twice the share is named, none of less, no share is too large.
    assert {w for w, k in total.items() if k >= 2 * n * c.HOT_SHARE} <= set(hot)
    assert all(share <= total[w] / n + 1e-12 for w, share in hot.items()) and len(hot) <= 1024
    sent = blocks.select("block", "lang", "words", "codes").mapInArrow(c._word_stripes(hot, 64), c.STRIPE_SCHEMA)
    salts = {(r.lang, r.prefix): r.n for r in sent.groupBy("lang", "prefix").agg(F.countDistinct("salt").alias("n")).collect()}
    assert salts["en", "the"] > 3 and salts["en", "w3"] <= 2


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    # What the score computes, at counts of a very large corpus.
    a, n, left, right = 9 * 10 ** 12, 10 ** 14, 10 ** 13, 10 ** 13 - 7
    got = spark.sql(f"SELECT (CAST(1000 * {a}L AS DECIMAL(19, 0)) * CAST({n}L AS DECIMAL(19, 0))) div "
                    f"(CAST({left}L AS DECIMAL(19, 0)) * CAST({right}L AS DECIMAL(19, 0)))").first()[0]
    assert got == 1000 * a * n // (left * right)


# -- contracts of earlier operators ----------------------------------------

def test_a_quote_is_linked_though_its_own_conversation_says_it_later(spark):
    from reviewlake.llm.quotations import reply_conversations
    said = "the quick brown fox jumps over it"
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", f"> {said}\nindeed"), (1, 2, "user", said),
            (2, 0, "user", said), (3, 0, "user", f"> {said}")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.n_linked for r in reply_conversations(frame).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0, (3, 0): 1}
    only = reply_conversations(frame.where("conv_id = 1")).where("turn = 1").first()
    assert only.n_linked == 0


def test_added_tokens_have_their_ids_anywhere(spark):
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from reviewlake.llm.queries import byte_bpe_path
    from reviewlake.llm.textbytes import chunks
    from reviewlake.llm.tokens import encoder
    r = random.Random(8)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "a", "don't", "\n", "é", "12", "<", "word"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(600)] + ["<|endoftext|>", "<|endof", "text|>"]
    tok, enc = Tokenizer.from_file(byte_bpe_path()), encoder(byte_bpe_path())
    chunk = next(iter(chunks(pa.array(texts))))
    ids, offs = enc.encode(chunk)
    for i, t in enumerate(texts):
        assert np.array_equal(ids[offs[i]:offs[i + 1]], tok.encode(t, add_special_tokens=False).ids), t


def test_archive_dates_are_utc_in_any_session_zone(spark):
    from reviewlake.llm.warc import captures
    pages = spark.createDataFrame([(1, "u", "x"), (None, "u", "y"), (90_000, "v", "z")], "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.page_id: r["at"] for r in captures(pages).collect()}
            assert got == {1: "2000-01-01T00:00:01Z", None: "2000-01-01T00:00:00Z", 90_000: "2000-01-02T01:00:00Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_items_and_documents_without_ids_are_judged_by_their_texts(spark):
    from reviewlake.llm.decontaminate import drop_contaminated, find_contaminated
    r = random.Random(9)

    def words(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [words(30) + ". " + words(8) + "." for _ in range(4)]
    clean = [words(120) for _ in range(4)]
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (7, items[2]), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, clean[0]), (None, f"{clean[1]} {items[0]} {clean[2]}"), (None, clean[3]),
                                  (5, f"{items[2]} {clean[1]}"), (5, clean[1]), (6, None)], "doc_id long, text string")
    found = find_contaminated(docs, bench)
    assert sorted(((x.doc_id, x.item_id) for x in found.collect()), key=str) == [(5, 7), (None, None)]
    kept = drop_contaminated(docs.withColumn("_hit", F.lit(1)).drop("_hit"), bench)
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(
        [(None, clean[0]), (None, clean[3]), (5, clean[1]), (6, None)], key=str)


def test_linked_paragraphs_and_further_articles_stay(spark):
    from reviewlake.llm.main_text import main_blocks
    body = "".join(f"<p>{'A sentence of the article, with commas, and more. ' * 4}{i}</p>" for i in range(3))
    linked = "<p>Also told, at length, with <a href='x'>a link</a> inside of a longer paragraph here.</p>"
    nav = "<ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul>"
    links = "<div><a href='y'>Only links here</a> <a href='z'>and more of them</a></div>"
    pages = [f"<body><div><div>{body}</div><div>{linked}</div>{links}</div>{nav}</body>",
             f"<body><main><article>{body}</article><article>{linked}</article>{links}</main></body>",
             f"<body><main><article>{body}</article><section>{linked}</section>{links}</main></body>"]
    for page in pages:
        got = main_blocks(page)
        assert len(got) == 4 and got[3].startswith("Also told") and "Only links" not in " ".join(got)


def test_generated_pages_give_their_article_and_nothing_else(spark):
    """Pages without article or main, from known parts: the text is what was put in."""
    from reviewlake.llm.main_text import main_texts
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + ", " + word() + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(r.randint(3, 7))) + "</ul>"
    junk = [lambda: f"<nav>{menu()}</nav>", lambda: f"<div class='sidebar'>{say(20)}</div>",
            lambda: f"<div id=cookie-notice>{say(9)}</div>", lambda: f"<form><p>{say(12)}</p></form>",
            lambda: f"<script>if (a < b) {{ {word()} }}</script>", lambda: f"<div class=comments><p>{say(30)}</p></div>",
            lambda: f"<footer>{say(6)}</footer>", lambda: "<!-- " + say(5) + " -->", menu]
    rows, want = [], {}
    for i in range(60):
        blocks, parts = [], []
        for _ in range(r.randint(3, 8)):
            text = say(r.randint(25, 60))
            blocks.append(text)
            words = text.split(" ")
            if r.random() < .4:
                words[3] = f"<a href='#'>{words[3]}</a>"
            if r.random() < .4:
                words[5] = f"<b>{words[5].replace('e', '&#101;')}</b>"
            parts.append(r.choice(["<p>%s</p>", "<p>%s", "<blockquote>%s</blockquote>"]) % r.choice([" ", "\n\t "]).join(words))
        before, after = ("".join(f() for f in r.sample(junk, 4)) for _ in range(2))
        wrap = r.choice(["<div>%s</div>", "<div class=post><div>%s</div></div>", "<td>%s</td>"])
        wrap = "<table><tr>" + wrap + "</tr></table>" if wrap.startswith("<td") else wrap
        rows.append((i, f"u{i}", f"<html><head><title>{word()}</title></head><body>{before}{wrap % ''.join(parts)}{after}</body>"))
        want[i] = "\n".join(blocks)
    frame = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in main_texts(frame).collect()}
    assert got == {**want, None: ""} and main_texts(frame.limit(0)).isEmpty()


def test_long_and_broken_pages_take_time_in_proportion():
    import time

    from reviewlake.llm.main_text import main_blocks
    for page in ("<p>text here</p>" + "<a " * 350_000, "a > b " + "<a " * 350_000, "<p>t" + "<!-- " * 200_000):
        start = time.perf_counter()
        main_blocks(page)
        assert time.perf_counter() - start < 2
    assert main_blocks("<p>a</p><!-- b > c") == ["a"] and main_blocks("<p>a</p><![CDATA[x<y") == ["a", "x<y"]


# -- the pipeline on odd tables --------------------------------------------

def test_pipeline_takes_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang = 'en'").orderBy("doc_id").limit(60)
    long = some.agg(F.max("doc_id")).first()[0] + 1
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(30_000))
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (long, "", "en", "s", 0), (long, " \n", None, None, None),
                                 (None, text, "en", "s", len(text)), (None, text, "en", "s", len(text))], some.schema)
    docs = some.union(odd).union(some.limit(5)).withColumns(
        {c: F.lit("x") for c in ("length", "k", "component", "label", "_hit", "block")})
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    frame, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        frame = stage(spark, frame, folder)
        if k < len(cp.STAGES) - 1:
            frame = cp.written(frame, f"test-stage-{k}")
            assert frame.columns == docs.columns
            sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]
    pieces = frame.collect()
    assert max(p.length for p in pieces) <= 2048 and sum(p.doc_id is None for p in pieces) >= 20
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).isEmpty()


def test_components_merge_as_edges_come(spark):
    from reviewlake.llm.components import components, merged_components
    r = random.Random(11)
    edges, labels = [], None
    for _ in range(4):
        new = [tuple(sorted(r.sample(range(60), 2))) for _ in range(9)]
        edges += new
        labels = merged_components(labels, spark.createDataFrame(new, "a long, b long"))
        want = components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(labels.collect()) == sorted(want.collect())
    again = merged_components(labels, spark.createDataFrame(edges[:5], "a long, b long"))
    assert sorted(again.collect()) == sorted(labels.collect())


def test_small_tables_of_components_are_few_files(spark):
    from reviewlake.llm.components import components, merged_components
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    edges = [(i, i + 7) for i in range(0, 1400)]
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        df = spark.createDataFrame(edges, "a long, b long")
        labels = components(df)
        merged = merged_components(labels, spark.createDataFrame([(0, 1), (5000, 5001)], "a long, b long"))
        most = max(8, spark.sparkContext.defaultParallelism)
        assert len(labels.inputFiles()) <= most and len(merged.inputFiles()) <= most
        assert {r.node: r.component for r in labels.collect()} == {n: n % 7 for n in range(1407)}
        want = {n: n % 7 if n % 7 > 1 else 0 for n in range(1407)} | {5000: 5000, 5001: 5000}
        assert {r.node: r.component for r in merged.collect()} == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
