"""Removal of lines that many sites share, by sketches of the sites of each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import digest_columns, let, page_texts
from tallywork.session import write_scratch

MIN_SITES = 10
LG_REGISTERS = 12


def _page_key(page_id: Column, html: Column) -> list[Column]:
    """128 bits for the content of a row: rows of the same id and text are handled alike."""
    return [F.xxhash64(page_id, html).alias("page_a"), F.xxhash64(F.lit("page"), page_id, html).alias("page_b")]


def _lines(pages: DataFrame) -> DataFrame:
    """(page_a, page_b, page_id, site, place, line_a, line_b): each line that isn't blank, by its digest.

    Spaces, tabs and carriage returns around a line don't count.
    """
    at = F.posexplode(F.transform(F.split("html", "\n"), lambda line: F.btrim(line, F.lit(" \t\r")))).alias("place", "line")
    rows = page_texts(pages, "site").select(
        *_page_key(F.col("page_id"), F.col("html")), "page_id", F.col("site").cast("string").alias("site"), at)
    return rows.filter("line <> ''").select(
        "page_a", "page_b", "page_id", "site", "place", *digest_columns("line", "line"))


def cross_site_lines(pages: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """The occurrences of lines on at least ``min_sites`` sites: (page_a, page_b, place, first), a written table.

    Every line gets a HyperLogLog sketch of its sites; sketches are built in the map tasks and merged, so that a line on a third
    of all pages arrives as one sketch a task. An estimate three standard errors above the bound settles that a line is
    boilerplate, one as far below that it isn't; the lines in between, and no others, get an exact distinct count of their
    sites. ``first`` marks the line's first place: the page of smallest id (missing ids last; equal ids by the page's
    digest), and there the topmost one.
    """
    error = 3 * 1.04 / (1 << lg_registers) ** 0.5
    sketched = _lines(pages).groupBy("line_a", "line_b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_registers)).alias("estimate"))
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    candidates = sketched.filter(F.col("estimate") >= low).select(
        F.col("line_a").alias("c_a"), F.col("line_b").alias("c_b"), (F.col("estimate") > high).alias("sure"))
    lines = _lines(pages)
    found = write_scratch(lines.join(
        candidates, (lines.line_a == candidates.c_a) & (lines.line_b == candidates.c_b)).drop("c_a", "c_b"), "shared_lines")
    near = found.filter("NOT sure").groupBy("line_a", "line_b", "site").agg(F.lit(1).alias("one")).groupBy(
        "line_a", "line_b").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites).select("line_a", "line_b")
    spread = found.filter("sure").select("line_a", "line_b").distinct().unionByName(near)
    place = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "page_a", "page_b", "place")
    firsts = found.groupBy("line_a", "line_b").agg(F.min(place).alias("at"))
    shared = spread.join(firsts, ["line_a", "line_b"])
    mine = F.struct("page_a", "page_b", "place")
    first = mine == F.struct(F.col("at.page_a").alias("page_a"), F.col("at.page_b").alias("page_b"), F.col("at.place").alias("place"))
    return write_scratch(found.join(shared, ["line_a", "line_b"]).select(
        "page_a", "page_b", "place", first.alias("first")), "boilerplate")


def remove_boilerplate(pages: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``pages(page_id, site, html)`` without the lines that at least ``min_sites`` sites share, with ``n_removed``.

    ``site`` is the host of the page's url or any other name of where it comes from. A shared line stays at its first place
    (:func:`cross_site_lines`), so that no content is lost from the whole; elsewhere it goes, with its line break. Blank lines
    stay. A missing site is counted as no site, missing html is an empty text. Repeated rows are treated alike. A
    page whose lines all go keeps its row with an empty text. All columns of ``pages`` are kept, those named ``n_removed``,
    ``page_a`` and ``page_b`` excepted.

    Texts are read three times and shuffled once, by a digest of id and text; besides move line digests.
    """
    drops = cross_site_lines(pages, min_sites, lg_registers).filter("NOT first").groupBy("page_a", "page_b").agg(
        F.collect_set("place").alias("drop_places"))  # places of one page
    kept = [c for c in pages.columns if c not in ("html", "n_removed", "page_a", "page_b")]
    texts = pages.select(*kept, F.coalesce("html", F.lit("")).alias("html"))
    keyed = texts.select("*", *_page_key(F.col("page_id"), F.col("html")))
    joined = keyed.join(drops, ["page_a", "page_b"], "left")

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop_places"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("drop_places").isNull(), F.col("html")).otherwise(let(F.split("html", "\n"), without))
    return joined.select(
        *kept, text.alias("html"), F.coalesce(F.size("drop_places"), F.lit(0)).cast("long").alias("n_removed"))
