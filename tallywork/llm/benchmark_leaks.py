"""Passages of benchmark items in pages, by a prefix-filtered join of word shingles; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import ascii_lower, digest_columns, page_texts, text_of
from tallywork.session import write_scratch

WINDOW = 10
SHINGLE = 5
#: What a block of item shingles or windows that is broadcast may hold.
BLOCK_BYTES = 32 << 20
ROW_BYTES = 128

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters; A to Z in lower case, no other letter changed."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, words) for each window of ``items(item_id, text)``: ``window`` words in a row, or all of a shorter item.

    ``window`` is the digest of the words. Items without words have none.
    """
    split = items.select("item_id", words_of(text_of("text")).alias("all_words")).filter(F.size("all_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - window, F.lit(0)))
    each = split.withColumn("start", F.explode(starts)).select(
        "item_id", F.slice("all_words", F.col("start") + 1, window).alias("words"))
    return each.select("item_id", F.md5(F.array_join("words", " ")).alias("window"), "words").distinct()


def shingle_at(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + k) for k in range(width)))


def window_shingles(windows: DataFrame, widest: int = SHINGLE) -> DataFrame:
    """``windows(window, words)`` with a row for each of their shingles: width, offset and shingle.

    Shingles have ``widest`` words; a window of fewer has one, of its own width.
    """
    def of(width: int) -> DataFrame:
        enough = F.size("words") >= width if width == widest else F.size("words") == width
        return windows.filter(enough).withColumn(
            "offset", F.explode(F.sequence(F.lit(0), F.size("words") - width))).withColumns(
            {"width": F.lit(width), "shingle": shingle_at(F.col("words"), F.col("offset"), width)})

    rows = of(widest)
    for width in range(1, widest):
        rows = rows.unionByName(of(width))
    return rows


def page_shingles(pages: DataFrame, width: int, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``pages(words)``, words, at and shingle for each place of each page."""
    return pages.filter(F.size("words") >= width).select(
        *keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at")).withColumn(
        "shingle", shingle_at(F.col("words"), F.col("at"), width))


def _in_blocks(small: DataFrame, key: str, row_bytes: Column, one_block: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``one_block(part)`` for parts of the written table ``small`` that may be broadcast, together.

    The table's bytes are summed first. Beyond BLOCK_BYTES it is dealt by ``key`` into as many parts as it takes, and the
    pages are gone through once for each: rows of pages never move for the join, however large the table.
    """
    size = small.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    parts = [small if blocks == 1 else small.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]
    together = one_block(F.broadcast(parts[0]))
    for part in parts[1:]:
        together = together.unionByName(one_block(F.broadcast(part)))
    return together


def rarest_shingles(pages: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """The rarest shingle of each window of ``shingles``, by its places in all of ``pages(words)``; ties go to the smaller hash.

    A window stands in a page only if all its shingles do, so the necessary prefix in the order of rarity is one shingle
    long. Windows of which a shingle stands nowhere are left out.
    """
    known = write_scratch(shingles.select("shingle").distinct(), "item_shingles")

    def places(part: DataFrame) -> DataFrame:
        found = None
        for width in widths:
            some = page_shingles(pages, width).select("shingle").join(part, "shingle")
            found = some if found is None else found.unionByName(some)
        return found

    # each block has shingles of its own, so counts by block are whole
    counted = write_scratch(_in_blocks(known, "shingle", F.lit(16), lambda part: places(part).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n_places"))), "shingle_places")
    ranked = shingles.join(counted, "shingle", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n_places"), "shingle", "offset", "width")).alias("rarest"),
        F.first("words").alias("item_words"))
    return ranked.filter("rarest.n_places > 0").select(
        "window", "item_words", "rarest.shingle", "rarest.offset", "rarest.width")


def occurrences(pages: DataFrame, anchors: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """(the columns ``keep``, window, start, end) for each place where a window stands in a page of ``pages(words)``.

    A page's shingle that equals a window's rarest one gives a candidate. Its start must not lie before the page's and its end
    not behind it; then the window's words are compared with the page's, one by one.
    """
    def of_block(part: DataFrame) -> DataFrame:
        found = None
        for width in widths:
            start = F.col("at") - F.col("offset")
            some = page_shingles(pages, width, *keep).join(part.filter(F.col("width") == width).drop("width"), "shingle").filter(
                (start >= 0) & (start + F.size("item_words") <= F.size("words"))).filter(
                F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("item_words")) == F.col("item_words")).select(
                *keep, "window", start.alias("start"), (start + F.size("item_words")).alias("end"))
            found = some if found is None else found.unionByName(some)
        return found

    size = F.octet_length(F.array_join("item_words", " ")) + 16 * F.size("item_words") + ROW_BYTES
    return _in_blocks(anchors, "window", size, of_block)


def _covered(spans: Column) -> Column:
    """Places covered by spans (start, end) that are sorted."""
    start = F.struct(F.lit(0).alias("reached"), F.lit(0).alias("words"))
    return F.aggregate(spans, start, lambda so_far, s: F.struct(
        F.greatest(so_far["reached"], s["end"]).alias("reached"),
        (so_far["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(so_far["reached"], s["start"]))).alias("words")))["words"]


def find_leaks(pages: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(page_id, n_words, n_hit, item_ids) for each row of ``pages(page_id, html)``: which benchmark items stand in its text.

    The library has no records of benchmark items, so ``items(item_id, text)`` are general: any texts that no page may hold.
    Words are those of :func:`words_of`. A word of a page is hit if it lies in ``window`` words in a row that an item has as well,
    or in the whole of an item that is shorter. ``item_ids`` are those of items with such a place, as strings, sorted.

    Only windows in which every shingle stands somewhere are looked for, each by its rarest shingle, and every candidate is
    compared word by word; see :func:`rarest_shingles` and :func:`occurrences`. Pages are gone through three times and never
    shuffled; what moves are the places found. Pages that hold the same windows share one set of them, so that a passage
    which stands in very many pages meets its items once.

    A missing text has no words, an empty one neither; repeated rows give repeated results; rows of one page_id and
    different texts are apart. A missing item_id isn't named, but its words are hit; repeated items count once. Without items, or
    without pages, nothing is hit. Further columns aren't read. A very long text is one row of words.
    """
    windows = write_scratch(item_windows(items, window), "item_windows")
    texts = windows.select("window", "words").dropDuplicates(["window"])
    shingles = write_scratch(window_shingles(texts, min(SHINGLE, window)), "window_shingles")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect()) or [min(SHINGLE, window)]  # five at most
    split = page_texts(pages).select("page_id", *digest_columns(), words_of(F.col("html")).alias("words"))
    key = ("page_id", "text_a", "text_b")
    anchors = write_scratch(rarest_shingles(split.select("words"), shingles, widths), "window_anchors")
    found = occurrences(split, anchors, widths, *key)
    by_page = found.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("window")).alias("held"))
    hits = write_scratch(by_page.select(
        *key, _covered(F.col("spans")).cast("long").alias("n_hit"), "held",
        F.md5(F.array_join("held", " ")).alias("set_id")), "page_hits")
    owners = windows.select(F.col("window").alias("one"), F.col("item_id").cast("string").alias("item_id"))
    named = hits.groupBy("set_id").agg(F.first("held").alias("held")).select("set_id", F.explode("held").alias("one")).join(
        owners, "one").groupBy("set_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    told = hits.join(named, "set_id").select(*(F.col(c).alias(f"hit_{c}") for c in key), "n_hit", "item_ids")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"hit_{c}"))
    return split.select(*key, F.size("words").cast("long").alias("n_words")).join(told, same, "left").select(
        "page_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
