"""Exact quantiles with linear interpolation, safe for groups of any size.

The built-in ``percentile`` keeps all distinct values of a group in one task. Here a mergeable sketch first gives two
values between which a wanted rank should lie. A counting pass proves it: it counts the values below and those inside. If
the rank isn't among those inside, the bracket is widened to all values and counted again, so a sketch can cost
time but never a right result. Then only the values inside a bracket, some thousandths of all, are counted by value and
put in order. No copy of the data is written.

Should the values inside a bracket still be very many, they are range-partitioned by (group, value) and written in
order, and the rank is narrowed down by adding up counts: to the partition that holds it, to a chunk of neighbouring
values in it, and to the value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.operators.joins import join_on
from tallywork.operators.numbering import PART, PLACE, store_in_order
from tallywork.session import write_scratch

WEIGHT = "__weight"
CHUNK = "__chunk"
CHUNK_ROWS = 512  # neighbouring values that one task puts in order for each rank in the end
SKETCH_ACCURACY = 1000  # a sketch's rank is off by no more than a row in so many
# values up to which the built-in percentile may hold them: of one table, and of each group, of which a task may hold 128
SMALL_TABLE = 1 << 22
SMALL_GROUP = 1 << 14
BRACKET_ROWS = 1 << 20  # rows inside a bracket up to which one task puts its distinct values in order
QUARTILES = (0.25, 0.5, 0.75)


def count_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, WEIGHT): how often each non-missing value occurs."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(WEIGHT))


def store_histogram(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, WEIGHT, PART, CHUNK): value counts written in order."""
    placed = store_in_order(counts, [*keys, value], "histogram")
    return placed.withColumn(CHUNK, F.floor(F.col(PLACE) / CHUNK_ROWS)).drop(PLACE)


def _holding(ranks: Column, first: Column, size: Column) -> Column:
    """Those of the wanted ranks that fall among ``size`` rows from rank ``first`` on."""
    return F.filter(ranks, lambda r: (r["rank"] >= first) & (r["rank"] < first + size))


def _before(amount: str, within: Sequence[str], order: str) -> Column:
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def _ranks(prob: Column, n: Column) -> list[Column]:
    """The two ranks between which a quantile lies among ``n`` values, each with the way from the first to the second."""
    at = prob * (n - 1)
    low = F.floor(at)
    return [F.struct(prob.alias("prob"), rank.alias("rank"), (at - low).alias("part"))
            for rank in (low, F.least(low + 1, n - 1))]


def histogram_quantiles(
    stored: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """(keys, prob, quantile) from a stored histogram; ``wanted`` (keys, __ranks) names other ranks than those of ``probs``."""
    keys = list(keys)
    chunks = stored.groupBy(*keys, PART, CHUNK).agg(F.sum(WEIGHT).alias("__size"))

    # partitions: a group has at most one row per partition of the written table
    parts = chunks.groupBy(*keys, PART).agg(F.sum("__size").alias("__size"))
    parts = parts.withColumns({
        "__first": _before("__size", keys, PART),
        "__n": F.sum("__size").over(Window.partitionBy(*keys)),
    })
    if wanted is None:
        ranks = F.array(*(r for p in probs for r in _ranks(F.lit(float(p)), F.col("__n"))))
    else:
        parts, ranks = join_on(parts, wanted, keys), F.col("__ranks")
    wants = _holding(ranks, F.col("__first"), F.col("__size"))
    parts = parts.select(*keys, PART, F.col("__first").alias("__part_first"), wants.alias("__wants"))
    parts = parts.filter(F.size("__wants") > 0)

    # chunks within the partitions that hold a wanted rank
    within = join_on(chunks, parts, [*keys, PART])
    within = within.withColumn("__first", F.col("__part_first") + _before("__size", [*keys, PART], CHUNK))
    wants = _holding(F.col("__wants"), F.col("__first"), F.col("__size"))
    within = within.select(*keys, PART, CHUNK, "__first", wants.alias("__wants"))
    # written, so that its size decides how it is joined, and it is worked out once
    within = write_scratch(within.filter(F.size("__wants") > 0), "ranks")

    # values within the chunks that do
    values = join_on(stored, within, [*keys, PART, CHUNK])
    values = values.withColumn("__at", F.col("__first") + _before(WEIGHT, [*keys, PART, CHUNK], value))
    wants = _holding(F.col("__wants"), F.col("__at"), F.col(WEIGHT))
    found = values.select(*keys, F.col(value).cast("double").alias("__value"),
                          F.inline(wants).alias("prob", "rank", "part"))
    low, high = F.min("__value"), F.max("__value")
    return found.groupBy(*keys, "prob").agg((low + (high - low) * F.first("part")).alias("quantile"))


def _sketch(col: str, probs: Sequence[float], accuracy: int) -> Column:
    """Values below and above each wanted rank, two for each of ``probs``, by a mergeable sketch.

    The distance from the rank is a share of the values: the smallest of three at which it is some rows more than the
    sketch may be off. Fewer than a dozen values have no bracket.
    """
    reaches = [3.0 / accuracy, 30.0 / accuracy, 300.0 / accuracy]
    edges = [edge for reach in reaches for p in probs for edge in (max(0.0, p - reach), min(1.0, p + reach))]
    every, n, size = F.percentile_approx(col, edges, accuracy), F.count(col), 2 * len(probs)
    chosen = F.when(n * reaches[2] >= 3 + 2 * n / accuracy, F.slice(every, 2 * size + 1, size))
    for k in (1, 0):
        chosen = F.when(n * reaches[k] >= 3 + 2 * n / accuracy, F.slice(every, k * size + 1, size)).otherwise(chosen)
    return chosen


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """(keys, no, prob, quantile) of several numeric columns, ``no`` being their place in ``cols``; missing values left out.

    Narrow passes over ``df``: sketch and proof for all columns together, then the values inside the brackets of each. Columns
    of one call must have one type. The rows of each group are counted first: if there are few enough, the built-in
    percentile is as exact and holds no more than these at once.
    """
    keys, places = list(keys), [(no, c, i, float(p)) for no, c in enumerate(cols) for i, p in enumerate(probs)]
    narrow = df.select(*keys, *cols)
    largest = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest * len(cols) <= (SMALL_GROUP if keys else SMALL_TABLE):
        shares = [float(p) for p in probs]
        found = narrow.groupBy(*keys).agg(*(F.percentile(c, shares).alias(f"__q{no}") for no, c in enumerate(cols)))
        cells = F.array(*(F.struct(F.lit(no).alias("no"), F.lit(p).alias("prob"), F.get(f"__q{no}", F.lit(i)).cast("double").alias("quantile"))
                          for no, _, i, p in places))
        return found.select(*keys, F.inline(cells)).filter(F.col("quantile").isNotNull())
    names = [f"`{c.replace('`', '``')}`" for c in cols]
    sketches = [f"__sketch{no}" for no in range(len(cols))]
    brackets = narrow.groupBy(*keys).agg(*(_sketch(c, probs, accuracy).alias(s) for c, s in zip(cols, sketches, strict=True)))
    if keys:
        brackets = write_scratch(brackets, "brackets")
    else:
        row = brackets.first()  # two numbers for each column and wanted quantile
        nothing = [F.lit(None).cast(f.dataType) for f in brackets.schema.fields]
        edges_of = [F.lit(list(x)) if x is not None else n for x, n in zip(row, nothing, strict=True)]

    def bracketed(no: int | None = None) -> DataFrame:
        of = range(len(cols)) if no is None else [no]
        rows, found = narrow.select(*keys, *(cols[k] for k in of)), [sketches[k] for k in of]
        if keys:
            return join_on(rows, brackets.select(*keys, *found), keys)
        return rows.withColumns({s: edges_of[k] for k, s in zip(of, found, strict=True)})

    def inside(no: int, i: int) -> str:
        value, edges = names[no], sketches[no]  # no edges: everything is inside
        return f"({value} IS NOT NULL AND coalesce({value} BETWEEN {edges}[{2 * i}] AND {edges}[{2 * i + 1}], true))"

    def proof() -> DataFrame:
        sums = [F.expr(f"count({c}) AS __n{no}") for no, c in enumerate(names)]
        for no, c, i, _ in places:
            sums += [F.expr(f"count_if({names[no]} < {sketches[no]}[{2 * i}]) AS __below{no}_{i}"), F.expr(f"count_if({inside(no, i)}) AS __inside{no}_{i}")]
        rows = ", ".join(f"struct({no} AS no, {p!r}D AS prob, __n{no} AS __n, __below{no}_{i} AS __below, __inside{no}_{i} AS __inside)" for no, _, i, p in places)
        found = bracketed().groupBy(*keys).agg(*sums).select(*keys, F.expr(f"inline(array({rows}))")).filter("__n > 0")
        ranked = found.withColumn("__ranks", F.array(*_ranks(F.col("prob"), F.col("__n"))))
        return write_scratch(ranked.withColumn("__proven", F.expr("forall(__ranks, r -> r.rank >= __below AND r.rank < __below + __inside)")), "proof")

    proven = proof()
    said = proven.agg(F.count_if(~F.col("__proven")).alias("wrong"), F.max("__inside").alias("most")).first()
    if said["wrong"]:
        if keys:
            wrong = proven.filter(~F.col("__proven")).select(*keys).distinct().withColumn("__wrong", F.lit(True))
            brackets = write_scratch(join_on(brackets, wrong, keys, "left").withColumns(
                {s: F.expr(f"CASE WHEN __wrong IS NULL THEN {s} END") for s in sketches}).drop("__wrong"), "brackets")
        else:
            edges_of = nothing
        proven = proof()
        said = proven.agg(F.max("__inside").alias("most")).first()

    of = [*keys, "no", "prob"]
    parts = []  # each column on its own, a narrow scan; values inside any of its brackets are counted once
    for no, c in enumerate(names):
        counted = bracketed(no).filter(" OR ".join(inside(no, i) for i in range(len(probs)))).groupBy(*keys, cols[no]).agg(
            F.count(F.lit(1)).alias(WEIGHT), F.first(sketches[no]).alias(sketches[no]))
        held = ", ".join(f"CASE WHEN {inside(no, i)} THEN {p!r}D END" for k, _, i, p in places if k == no)
        parts.append(counted.select(*keys, F.lit(no).alias("no"), F.expr(f"explode(array_compact(array({held}))) AS prob"), F.expr(f"{c} AS __found"), WEIGHT))
    found = reduce(DataFrame.unionByName, parts)
    ranks = proven.select(*of, F.expr("transform(__ranks, r -> struct(r.prob AS prob, r.rank - __below AS rank, r.part AS part)) AS __ranks"))
    if (said["most"] or 0) > BRACKET_ROWS:
        kept = {c: f"__key{i}" for i, c in enumerate(of)}
        stored = store_histogram(found.withColumnsRenamed(kept), "__found", list(kept.values()))
        told = histogram_quantiles(stored, "__found", probs, list(kept.values()), ranks.withColumnsRenamed(kept))
        return told.drop("prob").withColumnsRenamed({new: c for c, new in kept.items()}).select(*of, "quantile")
    placed = found.withColumn("__first", _before(WEIGHT, of, "__found"))
    wants = _holding(F.col("__ranks"), F.col("__first"), F.col(WEIGHT))
    hit = join_on(placed, ranks, of).select(*of, F.col("__found").cast("double").alias("__value"), F.explode(wants).alias("__want"))
    low, high = F.min("__value"), F.max("__value")
    return hit.groupBy(*of).agg((low + (high - low) * F.first("__want.part")).alias("quantile"))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float] = QUARTILES,
    keys: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """(keys, prob, quantile) of a numeric column, missing values left out.

    ``approx`` trades exactness for a single pass with a mergeable sketch per group.
    """
    if approx:
        sketch = F.percentile_approx(value, [float(p) for p in probs], accuracy)
        grouped = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(sketch.alias("__q"))
        both = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("__q"))
        return grouped.select(*keys, F.inline(both).alias("prob", "quantile")).withColumn(
            "quantile", F.col("quantile").cast("double"))
    return column_quantiles(df, [value], probs, keys).drop("no")


def widen(quantile_rows: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One row per group with a column per probability."""
    picked = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
              for p, name in names.items()]
    return quantile_rows.groupBy(*keys).agg(*picked)
