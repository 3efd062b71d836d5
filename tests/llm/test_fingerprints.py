"""Fingerprints: agreement against the exact generalised Jaccard similarity, and the next page against a plain sort."""

from collections import Counter

import numpy as np

from tallywork.llm import fingerprints as f
from tallywork.llm import shingles
from samples import edge_pages, no_pages, random_pages  # noqa: F401


def plain_shingles(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return [tuple(words)] if 0 < len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def generalised(a, b):
    x, y = Counter(plain_shingles(a)), Counter(plain_shingles(b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_hashes_are_equal_just_where_shingles_are():
    texts = ["a b c d e f a b c d e f", "a b", "", "  ", "ä ö ü ß é è", "x" * 999 + " y", "a b c d e"]
    seen = {}
    for t in texts:
        hashes, terms = shingles.shingle_hashes(t), plain_shingles(t)
        assert len(hashes) == len(terms)
        for h, term in zip(hashes.tolist(), terms):
            assert seen.setdefault(h, term) == term
    assert len(seen) == len({t for x in texts for t in plain_shingles(x)})


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    sampler = f.Sampler(512)
    for share in (0.1, 0.5, 0.9):
        common, own = rng.integers(0, 1 << 62, (2, 300), "uint64")
        n = int(300 * share)
        a = (np.r_[common[:n], own[n:]], rng.integers(1, 6, 300))
        b = (common, rng.integers(1, 6, 300))
        x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
        exact = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        s = sampler.signatures([a, b])
        assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / 512) ** 0.5 + 0.01


def test_fingerprints_of_pages(edge_pages, no_pages):
    got = f.fingerprint_pages(edge_pages).collect()
    texts = {}
    for row, page in zip(sorted(got, key=str), sorted(edge_pages.select("page_id", "html").collect(), key=lambda r: str(r["page_id"]))):
        texts.setdefault(page["html"], set())
    assert len(got) == edge_pages.count() and all(len(r["fingerprint"]) == 256 for r in got)
    by_id = {r["page_id"]: r["fingerprint"] for r in got}
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[8] == "f" * 256 and by_id[6] != by_id[7]
    assert f.fingerprint_pages(no_pages).count() == 0 and f.compare_with_edits(no_pages).count() == 0


def check_edits(pages, rows, ranges):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["page_id"]: r for r in f.compare_with_edits(pages).collect()}
    nexts = {r["page_id"]: r["next_html"] for r in f.with_next_page(pages, rows_a_range=ranges).collect()}
    assert len(got) == len(rows)
    for k, (page_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text, half = text or "", len(text or "") // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[page_id]
        assert r["edited"] == edited and r["n_chars"] == len(text) and nexts[page_id] == following
        assert abs(r["near_edited"] - generalised(text, edited)) < 0.3 and abs(r["near_next"] - generalised(text, following)) < 0.3
        if text == following:
            assert r["near_next"] == 1.0


def test_edited_and_next_page(random_pages, spark):
    pages, rows = random_pages
    check_edits(pages, rows, 10)
    few = [(5, "日本 😀 a b c d e f"), (None, "no id at all here"), (2, None)]
    check_edits(spark.createDataFrame(few, "page_id long, html string"), few, 1)
    one = [(5, "a b c d e f g h")]
    check_edits(spark.createDataFrame(one, "page_id long, html string"), one, 1000)


def test_repeated_rows_and_long_texts(edge_pages):
    assert f.compare_with_edits(edge_pages).count() == edge_pages.count()
    assert f.with_next_page(edge_pages, rows_a_range=2).filter("next_html IS NULL").count() == 0
