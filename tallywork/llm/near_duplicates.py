"""Join of near-duplicate texts: MinHash candidates pruned by their posterior, the rest verified exactly.

The pruning is that of BayesLSH (Satuluri and Parthasarathy 2012).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm import shingles
from tallywork.llm.common import digest_columns, page_texts
from tallywork.session import write_scratch

register_pickle_by_value(sys.modules[__name__])

BANDS = 24
ROWS_A_BAND = 4
HASHES = BANDS * ROWS_A_BAND
CHECK_EVERY = 16
SIMILARITY = 0.8
TOLERANCE = 1e-6
BLOCK = 1024
VERIFY_BLOCK = 256
VERIFY_SHINGLES = 1 << 21


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, every: int = CHECK_EVERY) -> list[tuple[int, int]]:
    """(n, m): after n compared MinHash values fewer than m matches make a similarity of ``threshold`` too unlikely.

    With a uniform prior, m matches in n give the posterior Beta(m + 1, n - m + 1), whose tail above the threshold is the
    chance that a binomial of n + 1 draws at the threshold gives at most m.
    """
    def tail(n: int, m: int) -> float:
        return sum(math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
    return [(n, next(m for m in range(n + 1) if tail(n, m) >= tolerance)) for n in range(every, hashes + 1, every)]


class MinHasher:
    """Signatures of HASHES 32-bit minima over the shingles of a text."""

    def __init__(self) -> None:
        at = np.arange(1, HASHES + 1, dtype="uint64")
        self.times = shingles.mixed(at) | np.uint64(1)
        self.add = shingles.mixed(at + np.uint64(HASHES))

    def signature(self, terms: np.ndarray) -> np.ndarray:
        out = np.full(HASHES, 0xFFFFFFFF, "uint32")
        for i in range(0, terms.size, 2048):
            h = terms[i:i + 2048, None] * self.times
            h += self.add
            h >>= np.uint64(32)
            out = np.minimum(out, h.min(axis=0).astype("uint32"))
        return out


def sign_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text_a, text_b, set_id, n_shingles, signature) for each row of ``pages(page_id, html)``.

    ``set_id`` is a 128-bit digest of the text's set of shingles (runs of five words; all words of a shorter text), so texts
    of one set_id have similarity 1. Missing and empty texts, and texts of spaces, share the empty set.
    """

    @F.pandas_udf("struct<set_id: binary, n_shingles: int, signature: binary>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = MinHasher()
        for texts in batches:
            rows = []
            for text in texts:
                terms = np.unique(shingles.shingle_hashes(text))
                rows.append((blake2b(terms.tobytes(), digest_size=16).digest(), len(terms), hasher.signature(terms).tobytes()))
            yield pd.DataFrame(rows, columns=["set_id", "n_shingles", "signature"])

    return page_texts(pages).select("page_id", *digest_columns("html"), sign("html").alias("s")).select(
        "page_id", "text_a", "text_b", "s.*")


def in_groups(keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], rows: int = 8192):
    """A mapInPandas function over rows sorted by ``keys``: calls ``work`` with whole groups, many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def codes(frame: pd.DataFrame) -> np.ndarray:
            changed = np.zeros(len(frame), bool)
            for key in keys:
                values = frame[key].to_numpy()
                changed[1:] |= values[1:] != values[:-1]
            return np.cumsum(changed)

        for batch in batches:
            if batch.empty:
                continue
            held.append(batch)
            size += len(batch)
            if size < rows:
                continue
            frame = pd.concat(held, ignore_index=True)
            code = codes(frame)
            last = int(np.searchsorted(code, code[-1]))  # the last group may go on in the next batch
            if last:
                yield from work(frame.iloc[:last], code[:last])
            held, size = [frame.iloc[last:]], len(frame) - last
        if held:
            frame = pd.concat(held, ignore_index=True)
            yield from work(frame, codes(frame))

    return run


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of the nodes that each of ``size`` nodes hangs together with by the links (a, b)."""
    root = np.arange(size)
    while a.size:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _blocks(rows: DataFrame, count: Column, key: Column) -> DataFrame:
    """``rows`` once for each pair of blocks (block_i <= block_j) that they belong to; ``side`` is 0 in i and 1 in j.

    A group of ``count`` blocks is dealt out by a hash of ``key``; every two rows of a group meet in just one pair of blocks.
    """
    dealt = rows.withColumns({"blocks": count, "mine": F.pmod(key, count)})
    pairs = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    return dealt.select("*", pairs).withColumns({
        "block_i": F.least("mine", "other"), "block_j": F.greatest("mine", "other"),
        "side": F.when(F.col("mine") <= F.col("other"), 0).otherwise(1)}).drop("blocks", "mine", "other")


def candidate_edges(sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): links between sets of ``sets(set_id, signature)`` whose MinHash values leave ``threshold`` likely enough.

    Sets that agree in one of BANDS bands of ROWS_A_BAND values meet in a bucket (at a similarity of 0.8 two sets miss each
    other with a chance of 3 in a million). Values are compared CHECK_EVERY at a time, and a pair is dropped as soon as its
    posterior says so. Instead of all pairs that stay, each block of a bucket returns a link from each set to one set of those
    that hang together with it, so that a bucket of n sets doesn't give n squared rows. Buckets of over BLOCK sets are
    compared block against block, in different tasks.
    """
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(
        b, F.substring("signature", b * (4 * ROWS_A_BAND) + 1, F.lit(4 * ROWS_A_BAND))))).alias("band", "bucket")
    in_bands = sets.select("set_id", bands)
    crowded = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = write_scratch(in_bands.join(crowded, "bucket").select("set_id", "bucket", "n"), "bands")
    blocked = _blocks(met, F.ceil(F.col("n") / BLOCK), F.xxhash64("set_id")).select("set_id", "bucket", "block_i", "block_j", "side")
    signed = blocked.join(sets.select("set_id", "signature"), "set_id")
    limits = least_matches(threshold, tolerance)

    def compare(frame: pd.DataFrame, code: np.ndarray) -> Iterator[pd.DataFrame]:
        signature = np.frombuffer(b"".join(frame["signature"]), "<u4").reshape(len(frame), HASHES)
        side, same = frame["side"].to_numpy(), (frame["block_i"] == frame["block_j"]).to_numpy()
        found_a, found_b = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for step in range(1, int(np.bincount(code).max())):
            a = np.flatnonzero((code[step:] == code[:-step]) & (same[step:] | (side[step:] != side[:-step])))
            b, matches = a + step, np.zeros(a.size, "int64")
            for n, m in limits:
                part = slice(n - CHECK_EVERY, n)
                matches = matches + (signature[a, part] == signature[b, part]).sum(axis=1)
                likely = matches >= m
                a, b, matches = a[likely], b[likely], matches[likely]
                if not a.size:
                    break
            found_a.append(a)
            found_b.append(b)
        root = local_roots(len(frame), np.concatenate(found_a), np.concatenate(found_b))
        moved = np.flatnonzero(root != np.arange(len(frame)))
        ids = frame["set_id"].to_numpy()
        out = pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})
        yield out[[x != y for x, y in zip(out["a"], out["b"], strict=True)]].drop_duplicates()

    keys = ["bucket", "block_i", "block_j"]
    near = signed.repartition(*keys).sortWithinPartitions(*keys)
    return near.mapInPandas(in_groups(keys, compare), "a binary, b binary").distinct()


def connected_sets(edges: DataFrame, label: str) -> DataFrame:
    """(set_id, root): the smallest set that each set of ``edges(a, b)`` hangs together with, its own root left out.

    Alternating stars (Kiveris and others 2014): larger neighbours move to the smallest neighbour, then smaller ones too, until
    nothing moves. Each round is a written table, so a lost executor repeats one round at most.
    """
    now = write_scratch(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)

    def mark(links: DataFrame) -> tuple[int, int]:
        # sums of 32-bit hashes: no overflow below four thousand million links
        row = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.crc32(F.concat("a", "b"))), F.lit(0))).first()
        return row[0], row[1]

    marked = mark(now)
    while marked[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
            "a <> b").distinct()
        large = write_scratch(large, label)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smallest.withColumnRenamed("a", "n"), large.a == F.col("n"))
        small = joined.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select(
            "e.*").filter("a <> b").distinct()
        after = write_scratch(small, label)
        now, previous, marked = after, marked, mark(after)
        if marked == previous:
            break
    return now.select(F.col("a").alias("set_id"), F.col("b").alias("root"))


def verified_links(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(set_id, n_links, root): for each set of ``members(set_id, component, n_texts, n_shingles)`` the texts linked to it.

    ``texts(set_id, html)`` has one text a set. Within a component of candidates every two sets are compared exactly, by the
    shingles of their texts: shared ones divided by those of either. ``n_links`` sums the texts of linked sets;
    ``root`` is one set of those that hang together with it by verified links in this block. A component is
    cut into blocks of about VERIFY_BLOCK sets or VERIFY_SHINGLES shingles, and pairs of blocks are compared in different
    tasks; each returns a row a set, not a row a pair.
    """
    least = Fraction(str(threshold))
    p, q = least.numerator, least.denominator
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("shingles")).select(
        "component", F.greatest(F.ceil(F.col("sets") / VERIFY_BLOCK), F.ceil(F.col("shingles") / VERIFY_SHINGLES), F.lit(1)).alias("count"))
    blocked = _blocks(members.join(sizes, "component"), F.col("count"), F.xxhash64("set_id")).select(
        "component", "block_i", "block_j", "side", "set_id", "n_texts")
    shown = blocked.join(texts, "set_id")

    def verify(frame: pd.DataFrame, code: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(frame)]
        ids, weights = frame["set_id"].to_numpy(), frame["n_texts"].to_numpy("int64")
        side, same = frame["side"].to_numpy(), (frame["block_i"] == frame["block_j"]).to_numpy()
        html = frame["html"].to_numpy()
        out = []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if end - start < 2:
                continue
            terms = [np.unique(shingles.shingle_hashes(t)) for t in html[start:end]]
            size = np.array([len(t) for t in terms])
            _, numbers = np.unique(np.concatenate(terms), return_inverse=True)
            ends = np.cumsum(size)
            links, left, right = np.zeros(end - start, "int64"), [], []
            marked = np.zeros(numbers.max(initial=-1) + 1, bool)
            for i in range(end - start - 1):
                rest = np.arange(i + 1, end - start)
                if not same[start]:
                    rest = rest[side[start + i + 1:end] != side[start + i]]
                if not rest.size or not size[i]:
                    continue
                mine = numbers[ends[i] - size[i]:ends[i]]
                marked[mine] = True
                hit = np.concatenate([[0], np.cumsum(marked[numbers[ends[i]:]])])
                shared = hit[ends[rest] - ends[i]] - hit[ends[rest] - size[rest] - ends[i]]
                marked[mine] = False
                linked = rest[q * shared >= p * (size[i] + size[rest] - shared)]
                links[i] += weights[start + linked].sum()
                links[linked] += weights[start + i]
                left.append(np.full(linked.size, i))
                right.append(linked)
            if not left:
                continue
            root = local_roots(end - start, np.concatenate(left), np.concatenate(right))
            found = np.flatnonzero(links)
            out.append(pd.DataFrame({
                "set_id": ids[start:end][found], "n_links": links[found], "root": ids[start:end][root[found]]}))
        if out:
            yield pd.concat(out, ignore_index=True)

    keys = ["component", "block_i", "block_j"]
    near = shown.repartition(*keys).sortWithinPartitions(*keys)
    return near.mapInPandas(in_groups(keys, verify, rows=2048), "set_id binary, n_links long, root binary")


def near_duplicates(pages: DataFrame, threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, text_a, text_b, set_id, class_key, class_id, n_links) for each row of ``pages(page_id, html)``.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of ``threshold`` or more.
    ``class_key`` names the texts that hang together by links, ``class_id`` is the smallest page_id among their pages (missing only
    if all are), ``n_links`` counts the different texts that the page's text is linked to; copies of it aren't counted.
    ``text_a`` and ``text_b`` are the digest of the text. Missing and empty texts, and texts of spaces, form one
    class. Repeated rows stay repeated. An empty table gives an empty one.

    Equal sets collapse first, in the map tasks, so copies cost a row each whatever their number. Then
    :func:`candidate_edges`, whose components hold every likely link; :func:`verified_links` inside them; and the components
    of verified links. Texts are read twice and shuffled once; a text travels again only to its component's
    blocks. The work within a group of n different near copies is n squared comparisons (the number of links must be
    exact), its rows are n times the number of its blocks.
    """
    signed = write_scratch(sign_pages(pages), "signatures")
    texts = signed.groupBy("set_id", "text_a", "text_b").agg(
        F.min("page_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    one = F.min(F.struct(F.col("least").isNull().alias("missing"), F.col("least").alias("page_id"), "text_a", "text_b"))
    sets = write_scratch(texts.groupBy("set_id").agg(
        one.alias("one"), F.count(F.lit(1)).alias("n_texts"), F.first("n_shingles").alias("n_shingles")).select(
        "set_id", "one.page_id", "one.text_a", "one.text_b", "n_texts", "n_shingles"), "sets")
    signatures = signed.select("set_id", "signature").dropDuplicates(["set_id"])
    edges = candidate_edges(signatures, threshold, tolerance)
    linked = connected_sets(edges, "candidates")
    in_component = write_scratch(linked.select("set_id", F.col("root").alias("component")).unionByName(
        linked.select(F.col("root").alias("set_id"), F.col("root").alias("component")).distinct()), "components")
    members = in_component.join(sets, "set_id").select(
        "set_id", "component", "n_texts", "n_shingles", "page_id", "text_a", "text_b")
    wanted = members.select(F.col("page_id").alias("w_id"), F.col("text_a").alias("w_a"), F.col("text_b").alias("w_b"), "set_id")
    keyed = page_texts(pages).select("page_id", *digest_columns("html"), "html")
    shown = keyed.join(wanted, (F.col("text_a") == F.col("w_a")) & (F.col("text_b") == F.col("w_b")) & F.expr("page_id <=> w_id"))
    one_text = shown.select("set_id", "html").dropDuplicates(["set_id"])  # rows repeated in the table
    links = write_scratch(verified_links(
        members.select("set_id", "component", "n_texts", "n_shingles"), one_text, threshold), "links")
    roots = connected_sets(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")), "classes")
    counted = links.groupBy("set_id").agg(F.sum("n_links").alias("linked"))
    classes = sets.join(roots, "set_id", "left").join(counted, "set_id", "left").select(
        "set_id", "page_id", F.coalesce("root", "set_id").alias("class_key"),
        (F.coalesce("linked", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    named = classes.groupBy("class_key").agg(F.min("page_id").alias("class_id"))
    described = write_scratch(classes.join(named, "class_key").select("set_id", "class_key", "class_id", "n_links"), "classes")
    return signed.select("page_id", "text_a", "text_b", "set_id").join(described, "set_id").select(
        "page_id", "text_a", "text_b", "set_id", "class_key", "class_id", "n_links")


def one_of_each(pages: DataFrame, threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of ``pages`` for each class of :func:`near_duplicates`: the page that the class is named after.

    Of rows that repeat its id and text any one stays. All columns are kept, but those named text_a, text_b and class_key.
    """
    classes = near_duplicates(pages, threshold, tolerance).filter("page_id <=> class_id").groupBy("class_key").agg(
        F.min(F.struct("page_id", "text_a", "text_b")).alias("one")).select("class_key", "one.*").withColumnsRenamed(
        {"page_id": "k_id", "text_a": "k_a", "text_b": "k_b"})
    kept = [c for c in pages.columns if c not in ("text_a", "text_b", "class_key")]
    keyed = pages.select(*kept, *digest_columns(F.coalesce("html", F.lit(""))))
    chosen = keyed.join(classes, (F.col("text_a") == F.col("k_a")) & (F.col("text_b") == F.col("k_b")) & F.expr("page_id <=> k_id"))
    return chosen.dropDuplicates(["class_key"]).select(*kept)
