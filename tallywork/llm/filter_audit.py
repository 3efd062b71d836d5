"""How filters of pages interact: what each removes in any order, and its Shapley share; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import text_of
from tallywork.session import write_scratch

#: A letter for each filter and the SQL condition under which a page fails it, on the measurements of :func:`measure`.
#: ``is_copy`` says that a page of smaller id has the same text.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct_words < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
COUNTS = ("pages", "good", "toxic")


def measure(pages: DataFrame) -> DataFrame:
    """(page_id, site, digest, n_words, n_distinct_words, n_capitals, n_chars, has_symbol) of each row of ``pages``.

    Words are runs without space, tab and line break characters, and differ by case; capitals are A to Z. A missing text is
    an empty one, a missing site the empty string. All within the row, without a shuffle.
    """
    rows = pages.select("page_id", F.coalesce("site", F.lit("")).alias("site"), text_of().alias("html"))
    split = rows.withColumn("words", F.array_remove(F.split("html", r"[\x20\x09-\x0D]+"), ""))
    return split.select(
        "page_id", "site", F.sha2("html", 256).alias("digest"),
        F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct_words"),
        (F.length("html") - F.length(F.regexp_replace("html", "[A-Z]+", ""))).alias("n_capitals"),
        F.length("html").alias("n_chars"), F.col("html").rlike(r"[#$%&*|]").alias("has_symbol"))


def failures(pages: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """(page_id, site, bits) for each row of ``pages(page_id, html, site)``: bit k is set where filter k fails the page.

    Of pages with the same text, all but those of the smallest page_id are copies, wherever they stand and whether or not
    another filter removes them; a missing page_id counts as larger than any other. The measurements are written once,
    without texts; digests of texts that stand once leave the join before the shuffle's other side is built, and a
    digest shared by very many pages is split by adaptive execution, since its other side has one row.
    """
    ledger = write_scratch(measure(pages), "filter_ledger")
    first = ledger.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages")).filter(
        "pages > 1").select(F.col("digest").alias("shared_digest"), "first_id")
    joined = ledger.join(first, F.col("digest") == F.col("shared_digest"), "left").withColumn(
        "is_copy", F.expr("first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id)"))
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)))
    return joined.select("page_id", "site", bits.alias("bits"))


def _labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with ``good`` and ``toxic``; repeated labels of a page count as one, which says yes if any of them does."""
    known = labels.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("label_id")).agg(
        F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    no = F.lit(False)
    return failed.join(known, F.col("page_id") == F.col("label_id"), "left").select(
        "site", "bits", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def removed_by_coalitions(patterns: DataFrame, n_filters: int) -> DataFrame:
    """(site, all_pages, removed_pages, removed_good, removed_toxic): arrays with a number for each coalition of filters.

    ``patterns(site, bits, pages, good, toxic)`` counts pages by what they fail. A coalition, a set of filters as bits, removes
    the pages that fail any of its filters.
    """
    everyone = range(1 << n_filters)

    def removed(count: str) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(s)) != 0, F.col(count))), F.lit(0)).cast("long")
                         for s in everyone)).alias(f"removed_{count}")

    return patterns.groupBy("site").agg(F.sum("pages").alias("all_pages"), *(removed(c) for c in COUNTS))


def potentials(removed: DataFrame, n_filters: int) -> DataFrame:
    """``removed`` with ``potential``: the removal game's potential of each coalition, times the least common multiple of 1 to n.

    The potential of no filter is 0, and that of S is (removed by S + the sum of the potentials of S without one of its
    filters) / |S|: the only function whose differences, potential of S less that of S without i, add up to what S
    removes. Times the multiple all of them are whole numbers. Each size of coalition is a step, built on the one before.
    """
    scale = math.lcm(*range(1, n_filters + 1))
    step = removed.withColumn("potential_0", F.lit(0).cast("long"))
    for size in range(1, n_filters + 1):
        step = step.withColumns({f"potential_{s}": F.expr(
            f"({scale} * removed_pages[{s}] + "
            + " + ".join(f"potential_{s & ~(1 << i)}" for i in range(n_filters) if s >> i & 1) + f") div {size}")
            for s in range(1 << n_filters) if s.bit_count() == size})
    names = [f"potential_{s}" for s in range(1 << n_filters)]
    return step.withColumn("potential", F.array(*names)).drop(*names)


def audit_filters(pages: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """What each filter does in each order of the filters, by site.

    ``pages(page_id, html, site)`` are judged as whole texts, ``labels(page_id, quality, toxic)`` says which are good (quality 1) or
    toxic (1). One row for each site, order of the filters' letters (``filter_order``, all of them) and step: kept, removed,
    redundant (fail this step's filter, but went before), unique_fails (fail no other filter), good_lost, toxic_lost and
    shapley, the filter's removals summed over all orders, which is n! times its Shapley share of all removals.

    Pages shrink to counts by site and failure bits in the map tasks, at most 32 a site; everything else is arithmetic on 32
    coalitions: a step removes what its filters together remove less what those before it did, and the Shapley share
    is the grand coalition's potential less that of the coalition without the filter.

    Missing and empty texts have no words, repeated rows count each and aren't copies of each other, missing sites are one site
    named by the empty string, an empty table gives no rows. Labels of pages that aren't there, or of no page, change nothing.
    Further columns aren't read. Very long texts need memory for their words, in one row.
    """
    letters, n = "".join(filters), len(filters)
    failed = _labelled(failures(pages, filters), labels)
    patterns = failed.groupBy("site", "bits").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("good").cast("long")).alias("good"),
        F.sum(F.col("toxic").cast("long")).alias("toxic"))
    games = potentials(removed_by_coalitions(patterns, n), n)
    orders = ",".join("".join(order) for order in permutations(letters))
    each = games.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bit(place: str) -> str:
        return f"shiftleft(1, instr('{letters}', substr(filter_order, {place}, 1)) - 1)"

    before = f"aggregate(filter(sequence(1, {n}), j -> j < step), 0, (so_far, j) -> so_far | {bit('j')})"
    here = each.withColumns({"own": F.expr(bit("step")), "before": F.expr(before)}).withColumn("after", F.expr("before | own"))
    grand = (1 << n) - 1

    def gone(count: str) -> str:
        return f"removed_{count}[after] - removed_{count}[before]"

    columns = {
        "kept": "all_pages - removed_pages[after]", "removed": gone("pages"),
        "redundant": f"removed_pages[own] - ({gone('pages')})",
        "unique_fails": f"removed_pages[{grand}] - removed_pages[{grand} ^ own]",
        "good_lost": gone("good"), "toxic_lost": gone("toxic"),
        "shapley": f"{math.factorial(n) // math.lcm(*range(1, n + 1))} * (potential[{grand}] - potential[{grand} ^ own])",
    }
    return here.select("site", "filter_order", "step", *(F.expr(e).alias(name) for name, e in columns.items()))
