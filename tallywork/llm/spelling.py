"""Spelling variants: words one letter apart, found on bit-sliced indexes, and the frequent form that each belongs to."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import ascii_lower, page_texts
from tallywork.session import write_scratch

register_pickle_by_value(sys.modules[__name__])

#: Letters of a run, as a Java character class.
LETTERS = r"[A-Za-zÀ-ÿ]"
LANE = 64  # words under one machine word of an index
BLOCK_WORDS = 4096
BUCKET_LETTERS = 1 << 20
ITEMS_AT_ONCE = 1 << 17
LETTERS_AT_ONCE = 1 << 22

NEAR = "word string, n_near long, near_n long, near_word string"


def count_words(pages: DataFrame, min_letters: int = 7, min_count: int = 2, slip_every: int = 0) -> DataFrame:
    """(word, n) for the words of ``pages(page_id, html)``: runs of letters, A to Z in lower case, by how often they stand there.

    Only words of at least ``min_letters`` letters and ``min_count`` places. With ``slip_every`` slips of the pen are planted: a run
    loses a letter if ``slip_every`` divides the checksum of "page_id:run", the letter at the checksum modulo the run's length.
    Missing texts have no words, a missing page_id is an empty one in the checksum, repeated rows count each. Counted in the map
    tasks first, so a word with a third of all places arrives as a row a task.
    """
    runs = page_texts(pages).select("page_id", F.explode(F.regexp_extract_all(
        "html", F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))).alias("run")).select("page_id", ascii_lower(F.col("run")).alias("run"))
    if slip_every:
        sign = F.crc32(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        runs = runs.withColumn("sign", sign).withColumn("at", F.when(
            F.col("sign") % slip_every == 0, (F.col("sign") % F.length("run")).cast("int")))
        slipped = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
        words = runs.select(F.when(F.col("at").isNull(), F.col("run")).otherwise(slipped).alias("word")).filter(
            F.length("word") >= min_letters)
    else:
        words = runs.select(F.col("run").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _classes(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary(word, n)`` with the groups in which a word can meet its near words: size, half and its hash.

    Two near words of lengths s and s or s + 1 share their first s // 2 letters or their last s - s // 2, as one error
    can't lie in both halves. A word stands in the groups of size s for s its length and one less.
    """
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda s: s > 0)
    each = vocabulary.withColumn("size", F.explode(sizes)).withColumn("half", F.expr("size div 2").cast("int"))
    sides = F.array(
        F.struct(F.lit(True).alias("front"), F.substr("word", F.lit(1), F.col("half")).alias("part")),
        F.struct(F.lit(False).alias("front"), F.substr(
            "word", length - F.col("size") + F.col("half") + 1, F.col("size") - F.col("half")).alias("part")))
    return each.withColumn("side", F.explode(sides)).select(
        "word", "n", "size", "side.front", F.xxhash64("side.part").alias("half_hash"))


def _index_rows(letters: np.ndarray, lanes: np.ndarray, bits: np.ndarray, n_lanes: int, alphabet: int, at: int) -> np.ndarray:
    """The bitsets of a position: for each lane and letter those of the lane's words that have the letter there."""
    table = np.zeros((n_lanes, alphabet + 1), "uint64")
    if at < letters.shape[1]:
        np.bitwise_or.at(table, (lanes, letters[:, at]), bits)
    table[:, alphabet] = 0  # no letter equals the end of a word
    return table


def one_error_sets(
    letters: np.ndarray, lengths: np.ndarray, size: int, alphabet: int, indexed: np.ndarray, lanes: np.ndarray, places: np.ndarray,
    n_lanes: int, item_row: np.ndarray, item_lane: np.ndarray, front: np.ndarray,
) -> np.ndarray:
    """For each item (a row's word against a lane) the bits of the lane's words that are one error from it.

    ``letters`` has the words of lengths ``size`` and ``size`` + 1, ``indexed`` those in lanes, at ``lanes`` and ``places``. All
    words of a lane go forward together, a letter of the query at a time: ``same`` those without error so far, ``other``
    those with one letter replaced, ``more`` those that have one letter more and are read one place further, ``fewer``
    those that have one less and are read one place back. Of words that share the first half only items of ``front`` report.
    """
    bits = np.uint64(1) << places.astype("uint64")
    inside = letters[indexed]

    def index(at: int) -> np.ndarray:
        return _index_rows(inside, lanes, bits, n_lanes, alphabet, at)

    long_words = lengths[indexed] == size + 1
    is_long, is_short = np.zeros(n_lanes, "uint64"), np.zeros(n_lanes, "uint64")
    np.bitwise_or.at(is_long, lanes[long_words], bits[long_words])
    np.bitwise_or.at(is_short, lanes[~long_words], bits[~long_words])
    same = (is_long | is_short)[item_lane]
    first_half = same.copy()
    other, more, fewer = (np.zeros_like(same) for _ in range(3))
    back, here = np.zeros((n_lanes, alphabet + 1), "uint64"), index(0)
    for at in range(size):
        letter = letters[item_row, at]
        ahead = index(at + 1)
        fits = here[item_lane, letter]
        more = (more | same) & ahead[item_lane, letter]
        fewer = (fewer & back[item_lane, letter]) | same
        other = (other & fits) | (same & ~fits)
        same = same & fits
        if at + 1 == size // 2:
            first_half = same.copy()
        back, here = here, ahead
    shorts = (other & is_short[item_lane]) | ((more | same) & is_long[item_lane])
    letter = letters[item_row, np.minimum(size, letters.shape[1] - 1)]
    longs = ((fewer & back[item_lane, letter]) | same) & is_short[item_lane]
    found = np.where(lengths[item_row] == size + 1, longs, shorts)
    return np.where(front, found & first_half, found & ~first_half)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each of ``counts``, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - counts, counts)


def _near_in_class(words: list[str], size: int, group: np.ndarray, front: np.ndarray, asks: np.ndarray, told: np.ndarray, rank: np.ndarray):
    """(row, number of near words, the smallest rank among them) for rows of one size, sorted by ``group``."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "uint32")
    alphabet, codes = np.unique(points, return_inverse=True)
    letters = np.full((len(words), size + 1), alphabet.size, "int32")
    letters[np.repeat(np.arange(len(words)), lengths), _ranges(lengths)] = codes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(words)]
    n_told = np.add.reduceat(told.astype("int64"), starts)
    n_lanes = -(-n_told // LANE)
    n_items = n_lanes * np.add.reduceat(asks.astype("int64"), starts)
    n_near, best = np.zeros(len(words), "int64"), np.full(len(words), np.iinfo("int64").max)
    first = 0
    while first < len(starts):
        # some groups at a time: bounded numbers of items, and of letters of their words
        load = np.maximum(np.cumsum(n_items[first:]) / ITEMS_AT_ONCE, (ends[first:] - starts[first]) * (size + 1) / LETTERS_AT_ONCE)
        last = first + max(1, int(np.searchsorted(load, 1, side="right")))
        rows = np.arange(starts[first], ends[last - 1])
        lane_base = np.cumsum(n_lanes[first:last]) - n_lanes[first:last]
        of_group = np.repeat(np.arange(last - first), (ends - starts)[first:last])
        indexed = rows[told[rows]]
        place = _ranges(n_told[first:last])
        lanes, places = lane_base[of_group[told[rows]]] + place // LANE, place % LANE
        asking, their_group = rows[asks[rows]], of_group[asks[rows]]
        each = n_lanes[first:last][their_group]
        item_row, item_lane = np.repeat(asking, each), np.repeat(lane_base[their_group], each) + _ranges(each)
        if item_row.size:
            found = one_error_sets(letters, lengths, size, alphabet.size, indexed, lanes, places, int(n_lanes[first:last].sum()),
                                   item_row, item_lane, front[item_row])
            some = np.flatnonzero(found)
            if some.size:
                at, bit = np.nonzero(np.unpackbits(found[some].astype("<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little"))
                row_at = np.full((int(n_lanes[first:last].sum()), LANE), -1)
                row_at[lanes, places] = indexed
                row, other = item_row[some[at]], row_at[item_lane[some[at]], bit]
                np.add.at(n_near, row, 1)
                np.minimum.at(best, row, rank[other])
        first = last
    return n_near, best


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """For each asking word of the bucket's groups: how many near words it has there, and the most frequent of them."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    size, front, asks, told = (table.column(c).to_numpy(zero_copy_only=False) for c in ("size", "front", "asks", "told"))
    group = [table.column(c).to_numpy() for c in ("size", "half_hash", "ask_block", "tell_block")] + [front]
    order = np.lexsort(group[::-1])
    by_word = np.argsort(np.array(words, dtype=object), kind="stable")
    out: dict[str, list] = {"word": [], "n_near": [], "near_n": [], "near_word": []}
    # the most frequent word ranks first, ties by code points
    ranked = by_word[np.argsort(-n[by_word], kind="stable")]
    rank = np.empty(len(words), "int64")
    rank[ranked] = np.arange(len(words))
    for one_size in np.unique(size):
        rows = order[size[order] == one_size]
        changed = np.zeros(rows.size, bool)
        for key in group:
            changed[1:] |= key[rows[1:]] != key[rows[:-1]]
        n_near, best = _near_in_class([words[i] for i in rows], int(one_size), np.cumsum(changed), front[rows], asks[rows], told[rows], rank[rows])
        for i in np.flatnonzero(n_near):
            near = ranked[best[i]]
            for name, value in zip(out, (words[rows[i]], int(n_near[i]), int(n[near]), words[near]), strict=True):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([
        ("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near_word", pa.string())]))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near_word) for each word of ``vocabulary(word, n)`` that has near words.

    Near words differ by one letter inserted, deleted or replaced. ``near_word`` is the most frequent of them, ties by code points.
    Words must be distinct. Words meet in groups that share half of their letters (:func:`_classes`). Within a group each word
    is compared with 64 others at a time; no pair of words is written. A group of more than BLOCK_WORDS words is cut into
    blocks, and each block is compared with each in a task's bucket of its own: work that grows with a group's square, a 64th
    of it, in pieces of even size. Each word gives at most a row for each of its groups and blocks.
    """
    keys = ["size", "front", "half_hash"]
    classes = write_scratch(_classes(vocabulary), "spelling_classes")
    counts = write_scratch(classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).filter("words > 1").withColumn(
        "blocks", F.ceil(F.col("words") / BLOCK_WORDS).cast("int")), "spelling_groups")
    letters = counts.agg(F.sum(F.expr("words * greatest(1, 2 * blocks - 1) * (size + 1)")).alias("letters")).first()["letters"] or 0
    buckets = int(letters // BUCKET_LETTERS) + 1
    joined = classes.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: t != F.col("block"))

    def part(ask, tell, asks: bool, told: bool):
        return F.struct(ask.alias("ask_block"), tell.alias("tell_block"), F.lit(asks).alias("asks"), F.lit(told).alias("told"))

    block = F.col("block")
    parts = F.concat(F.array(part(block, block, True, True)), F.transform(others, lambda t: part(block, t, True, False)),
                     F.transform(others, lambda t: part(t, block, False, True)))
    rows = joined.select("word", "n", *keys, F.inline(parts)).withColumn(
        "bucket", F.pmod(F.xxhash64(*keys, "ask_block", "tell_block"), F.lit(buckets)))
    found = rows.groupBy("bucket").applyInArrow(_near_in_bucket, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near_word"))


def spelling_groups(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``vocabulary(word, n)``, as :func:`count_words` gives it.

    A word's ``form`` is the most frequent of its near words (ties by code points) if that has at least ``times`` its own count,
    else null; ``n_near`` counts its near words, ``form_n`` is the form's count. ``root`` is reached from the word by going from form to
    form, the word itself if it has none. Each step multiplies the count, so that chains are short: their length is bounded by
    the largest count, and pointers jump twice as far each round. An empty vocabulary gives no rows. A root that very many
    words share is one row on its side of each join.
    """
    near = near_words(vocabulary).withColumnsRenamed({"word": "own", "near_n": "most_n"})
    judged = write_scratch(vocabulary.select("word", "n").join(near, F.col("word") == F.col("own"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("most_n") >= times * F.col("n"), F.col("near_word")).alias("form"),
        F.when(F.col("most_n") >= times * F.col("n"), F.col("most_n")).alias("form_n")), "spelling_forms")
    chains = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = judged.agg(F.max("n").alias("n")).first()["n"] or 1
    links = max(1, math.floor(math.log(max(int(most), 1), times)) + 1)
    for _ in range(math.ceil(math.log2(links))):
        chains = write_scratch(chains, "spelling_chains")
        ahead = chains.select(F.col("word").alias("via"), F.col("root").alias("further"))
        chains = chains.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"))
    ends = chains.select(F.col("word").alias("own"), "root")
    return judged.join(ends, F.col("word") == F.col("own"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
