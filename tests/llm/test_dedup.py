"""Line dedup and near-duplicate join against brute force."""

from collections import defaultdict
from itertools import combinations

import pytest

from tallywork.llm import boilerplate as b
from tallywork.llm import near_duplicates as n
from samples import edge_pages, no_pages, random_pages  # noqa: F401


def plain_lines(rows, min_sites):
    at = defaultdict(list)
    sites = defaultdict(set)
    for page_id, site, html in rows:
        for place, line in enumerate((html or "").split("\n")):
            if line.strip(" \t\r"):
                at[line.strip(" \t\r")].append((page_id is None, page_id or 0, place))
                if site is not None:
                    sites[line.strip(" \t\r")].add(site)
    out = {}
    for page_id, site, html in rows:
        keep = []
        for place, line in enumerate((html or "").split("\n")):
            key = line.strip(" \t\r")
            if not key or len(sites[key]) < min_sites or min(at[key]) == (page_id is None, page_id or 0, place):
                keep.append(line)
        out[page_id] = "\n".join(keep)
    return out


@pytest.mark.parametrize("lg", [4, 12])
def test_lines_against_a_plain_count(spark, lg):
    rows = [(i, f"s{i % 17}" if i % 11 else None, "\n".join([
        "all sites", f"own {i}", "", f"sites below {i % 9}" if i % 17 < 9 else "  padded\t", "twice", "twice", f"mod {i % 3}"]))
        for i in range(100)]
    rows += [(None, "s3", "all sites\nno id"), (200, "s1", None), (201, "s1", ""), (202, "s2", "all sites")]
    pages = spark.createDataFrame(rows, "page_id long, site string, html string")
    got = {r["page_id"]: r["html"] for r in b.remove_boilerplate(pages, 9, lg).collect()}
    assert got == plain_lines(rows, 9)


def test_line_edges(edge_pages, no_pages):
    got = b.remove_boilerplate(edge_pages, 2).collect()
    assert len(got) == edge_pages.count() and set(got[0].asDict()) - {"n_removed"} == set(edge_pages.columns)
    assert [r["n_removed"] for r in got if r["page_id"] == 2] == [2, 2] and [r["n_removed"] for r in got if r["page_id"] == 1] == [0]
    assert b.remove_boilerplate(no_pages).count() == 0


def plain_classes(rows):
    def sets(text):
        w = (text or "").split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])
    texts = {t or "": sets(t) for _, t in rows}
    linked = defaultdict(set)
    for x, y in combinations(texts, 2):
        union = len(texts[x] | texts[y])
        if union == 0 or len(texts[x] & texts[y]) * 5 >= 4 * union:
            linked[x].add(y)
            linked[y].add(x)
    ids = defaultdict(list)
    for page_id, t in rows:
        ids[t or ""].append(page_id)
    out = {}
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            for y in linked[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[t] = (min((i for y in seen for i in ids[y] if i is not None), default=None), len(linked[t]))
    return sorted((str(p), *map(str, out[t or ""])) for p, t in rows)


def test_classes_against_all_pairs(spark, random_pages, monkeypatch):
    pages, rows = random_pages
    more = [(900, None), (901, ""), (902, " \n"), (None, "lonely text without any id at all"), (903, "a b"), (904, "a  b"), (904, "a  b")]
    whole = pages.unionByName(spark.createDataFrame(more, "page_id long, html string"))
    want = plain_classes(rows + more)
    got = sorted((str(r["page_id"]), str(r["class_id"]), str(r["n_links"])) for r in n.near_duplicates(whole).collect())
    assert got == want
    # small blocks: pairs of blocks are compared in different tasks
    monkeypatch.setattr(n, "BLOCK", 2)
    monkeypatch.setattr(n, "VERIFY_BLOCK", 2)
    got = sorted((str(r["page_id"]), str(r["class_id"]), str(r["n_links"])) for r in n.near_duplicates(whole).collect())
    assert got == want
    kept = n.one_of_each(whole).collect()
    assert sorted(str(r["page_id"]) for r in kept) == sorted({w[1] for w in want})


def test_chain_of_near_copies_is_one_class(spark):
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(30):
        words = words[:3 * i] + ["z"] + words[3 * i + 1:]
        rows.append((i, " ".join(words)))
    got = n.near_duplicates(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((str(r["page_id"]), str(r["class_id"]), str(r["n_links"])) for r in got) == plain_classes(rows)
    assert {r["class_id"] for r in got} == {0}


def test_duplicate_edges(edge_pages, no_pages):
    got = n.near_duplicates(edge_pages).collect()
    assert len(got) == edge_pages.count()
    assert n.near_duplicates(no_pages).count() == 0 and n.one_of_each(no_pages).count() == 0
    assert set(n.one_of_each(edge_pages).columns) == set(edge_pages.columns) - {"text_a"}


def test_posterior_limits():
    from fractions import Fraction

    # the closed form against a sum over a fine grid of the posterior
    for count, least in n.least_matches(0.8, 1e-3, 32, 16):
        def tail(m, count=count):
            grid = [Fraction(i, 2000) + Fraction(1, 4000) for i in range(2000)]
            density = [float(x) ** m * (1 - float(x)) ** (count - m) for x in grid]
            return sum(d for x, d in zip(grid, density, strict=True) if x >= Fraction(4, 5)) / sum(density)
        assert tail(least) >= 1e-3 > tail(least - 1)
