"""Benchmark leaks, spelling variants and the filter audit against plain versions."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest

from tallywork.llm import benchmark_leaks as leaks
from tallywork.llm import filter_audit as audit
from tallywork.llm import spelling
from samples import edge_pages, no_pages, random_pages  # noqa: F401


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def plain_leaks(html, items, window=10):
    words = plain_words(html)
    hit, named = set(), set()
    for item_id, text in items:
        own = plain_words(text)
        size = min(window, len(own))
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if grams else 0):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                named.add(str(item_id))
    return len(words), len(hit), sorted(named - {"None"})


@pytest.mark.parametrize("block_bytes", [1 << 25, 1500])
def test_leaks_against_every_window(spark, random_pages, block_bytes, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block_bytes)
    _, rows = random_pages
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(rows, k=1)[0][1].split(" ")[3:3 + rng.choice([1, 2, 4, 7, 10, 11, 25])])) for i in range(30)]
    items += [(30, "W1 w2"), (31, "w1"), (32, ""), (33, None), (None, rows[5][1]), (4, items[4][1]), (35, items[3][1]), (36, "w7 " * 30)]
    texts = [(i, t) for i, t in rows] + [
        (900, None), (901, ""), (902, "w7 " * 40), (902, "w7 " * 40), (902, "other W1-w2 text"), (None, rows[5][1].upper()), (903, "w1"),
        (904, rows[7][1] + ". " + rows[5][1])]
    pages = spark.createDataFrame(texts, "page_id long, html string").repartition(5)
    found = leaks.find_leaks(pages, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r["page_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=repr)
    assert got == sorted(((i, *plain_leaks(t, items)) for i, t in texts), key=repr)
    assert sum(r[2] > 0 for r in got) > 20


def test_leak_edges(spark, edge_pages, no_pages):
    items = spark.createDataFrame([(1, "two three four five"), (2, "日本語 テキスト"), (3, "so so so")], "item_id long, text string")
    extra = items.selectExpr("*", "'x' AS window", "'y' AS words", "'z' AS page_id")
    got = leaks.find_leaks(edge_pages, extra).collect()
    assert got[0].asDict().keys() == {"page_id", "n_words", "n_hit", "item_ids"} and len(got) == edge_pages.count()
    by_id = {r["page_id"]: (r["n_hit"], r["item_ids"]) for r in got}
    assert by_id[1] == by_id[2] == (4, ["1"]) and by_id[11] == (10, ["3"]) and by_id[12] == (2, ["2"]) and by_id[3] == (0, [])
    assert leaks.find_leaks(no_pages, items).count() == 0
    assert {r["n_hit"] for r in leaks.find_leaks(edge_pages, items.limit(0)).collect()} == {0}


def test_leaks_are_looked_for_by_rare_shingles(spark):
    common = " ".join(f"c{i}" for i in range(8))
    pages = spark.createDataFrame([(i, common) for i in range(50)] + [(99, common + " rare end")], "page_id long, html string")
    windows = leaks.item_windows(spark.createDataFrame([(1, common + " rare end")], "item_id long, text string"))
    shingles = leaks.window_shingles(windows.select("window", "words")).cache()
    words = pages.select(leaks.words_of(leaks.text_of()).alias("words"))
    (anchor,) = leaks.rarest_shingles(words, shingles, [5]).collect()
    assert anchor["offset"] in (4, 5)  # the shingles that hold a rare word


def test_page_scans_meet_no_shuffle_of_texts(spark, random_pages):
    pages, _ = random_pages
    words = pages.select("page_id", leaks.words_of(leaks.text_of()).alias("words"))
    anchors = spark.createDataFrame([("x", ["w1", "w2"], 5, 0, 2)], "window string, item_words array<string>, shingle long, offset int, width int")
    plan = leaks.occurrences(words, anchors, [2], "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange") == plan.count("BroadcastExchange") + plan.count("Exchange RoundRobin")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_groups(counts, times=10):
    forms = {}
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, others in links.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n, len(links[w]), counts.get(forms[w])) for w, n in counts.items()}


def some_vocabulary(rng, count, letters, sizes):
    words = {"".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(count)}
    for w in list(words):
        for _ in range(2):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]))
    return {w: rng.choice([2, 3, 19, 20, 21, 190, 2000, 30000]) for w in sorted(words) if w}


@pytest.mark.parametrize("block_words,letters,sizes", [
    (4096, "abcdeéþ", [7, 8, 9]), (70, "ab", [7, 8, 9, 10]), (4096, "abÿ", [1, 2, 3, 4]), (64, "abcdefgh", [7, 30, 31])])
def test_spelling_against_all_pairs(spark, block_words, letters, sizes, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    counts = some_vocabulary(random.Random(len(letters)), 250, letters, sizes)
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.spelling_groups(vocabulary).collect()]
    assert len(got) == len(counts) and set(got) == plain_groups(counts)


def test_small_chunks_and_other_alphabets(monkeypatch):
    monkeypatch.setattr(spelling, "ITEMS_AT_ONCE", 5)
    counts = some_vocabulary(random.Random(9), 120, "xyz語😀", [4, 5])
    rows = [(w, n, s, side) for w, n in counts.items() for s in (len(w), len(w) - 1) for side in (True, False)]
    table = pa.table({
        "word": [r[0] for r in rows], "n": [r[1] for r in rows], "size": pa.array([r[2] for r in rows], pa.int32()), "front": [r[3] for r in rows],
        "half_hash": [0] * len(rows), "ask_block": [0] * len(rows), "tell_block": [0] * len(rows),  # all halves collide: still counted once
        "asks": [True] * len(rows), "told": [True] * len(rows)})
    found = spelling._near_in_bucket(table).to_pylist()
    total = Counter()
    for r in found:
        total[r["word"]] += r["n_near"]
    assert total == Counter({w: k for w in counts if (k := sum(near(w, v) for v in counts))})


def test_a_long_word_is_one_row_of_bitsets():
    word = "ab" * 20_000
    assert len(np.unique([len(word)])) == 1
    table = pa.table({
        "word": [word, word[:-1], word + "c"], "n": [2, 3, 4], "size": pa.array([len(word)] * 3, pa.int32()), "front": [True] * 3, "half_hash": [1] * 3,
        "ask_block": [0] * 3, "tell_block": [0] * 3, "asks": [True] * 3, "told": [True] * 3}).slice(0, 3)
    two = table.filter(pa.compute.field("word") != word[:-1])
    assert [(r["n_near"], r["near_n"]) for r in spelling._near_in_bucket(two).to_pylist()] == [(1, 4), (1, 2)]


def plain_slips(rows, every):
    counts = Counter()
    for page_id, html in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", html or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            sign = zlib.crc32(f"{'' if page_id is None else page_id}:{run}".encode())
            if every and sign % every == 0:
                at = sign % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("every", [0, 3])
def test_words_against_a_plain_count(spark, edge_pages, every):
    rows = [(r["page_id"], r["html"]) for r in edge_pages.collect()] + [
        (i, "Wörterbuch ÄRGERLICH straßenbahn exactly7 sevenxx x×÷multi " + "verylong" * (i % 3)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' AS run", "1 AS n", "2 AS sign")
    got = {r["word"]: r["n"] for r in spelling.count_words(pages, slip_every=every).collect()}
    assert got == plain_slips(rows, every) and len(got) > 5


def test_spelling_of_nothing(spark, no_pages):
    words = spelling.count_words(no_pages)
    assert spelling.spelling_groups(words).count() == 0


def plain_audit(rows, labels):
    first = {}
    for page_id, html, _ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for page_id, html, site in rows:
        text = html or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = "".join(letter for letter, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            re.search(r"[#$%&*|]", text) is not None,
            text in first and (page_id is None or page_id > first[text]))) if bad)
        judged.append((site or "", fails, page_id in good, page_id in toxic))
    out = set()
    for site in {j[0] for j in judged}:
        some = [j for j in judged if j[0] == site]
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = some
            for k, letter in enumerate(order):
                gone = [j for j in left if letter in j[1]]
                failing = sum(letter in j[1] for j in some)
                left = [j for j in left if letter not in j[1]]
                total[letter] += len(gone)
                steps.append((letter, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(j[1] == letter for j in some),
                              sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out |= {(site, *s[1:], total[s[0]]) for s in steps}
    return out


def test_audit_against_every_order(spark, edge_pages):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(90)] + ["LOUD", "#tag", "a|b"]
    rows = [(r["page_id"], r["html"], r["site"]) for r in edge_pages.collect()]
    for i in range(20, 140):
        text = " ".join(rng.choices(words[:rng.choice([20, 60, 90, 93])], k=rng.choice([10, 49, 50, 60, 100])))
        rows.append((i, rng.choice([text, rows[-1][1] or text, text.upper()]), rng.choice(["s1", "s2", None, ""])))
    rows += [(None, rows[40][1], "s1"), (150, None, "s2"), (151, "", "s2"), (21, rows[30][1], "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, html string, site string").selectExpr("*", "1 AS bits", "'x' AS digest", "2 AS step")
    table = spark.createDataFrame(labels, "page_id long, quality int, toxic int").selectExpr("*", "'x' AS site")
    got = [tuple(r) for r in audit.audit_filters(pages, table).collect()]
    assert len(got) == 600 * len({r[2] or "" for r in rows}) and set(got) == plain_audit(rows, labels)


def test_audit_edges(spark, no_pages):
    labels = spark.createDataFrame([], "page_id long, quality int, toxic int")
    assert audit.audit_filters(no_pages, labels).count() == 0


def test_potentials_add_up(spark):
    rng = random.Random(1)
    patterns = spark.createDataFrame([("s", b, rng.randrange(90), 0, 0) for b in range(32)], "site string, bits int, pages long, good long, toxic long")
    (game,) = audit.potentials(audit.removed_by_coalitions(patterns, 5), 5).collect()
    for s in range(32):  # efficiency: the differences of a coalition's potential add up to what it removes
        parts = [game["potential"][s] - game["potential"][s & ~(1 << i)] for i in range(5) if s >> i & 1]
        assert sum(parts) == 60 * game["removed_pages"][s]
    assert all(game["removed_pages"][a | b] <= game["removed_pages"][a] + game["removed_pages"][b] for a, b in combinations(range(32), 2))
