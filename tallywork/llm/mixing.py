"""Mixing records to target weights over a tree of their categories; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.session import write_scratch

BUCKETS = 4096  # three hexadecimal digits of the draw
SMALL_ROWS = 100_000  # leaves up to which their table is sent to every task; their names are bounded by NAME_BYTES each
NAME_BYTES = 256
SALTS = 64


def _same(a: Sequence[str], b: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    condition = F.lit(True)
    for x, y in zip(a, b, strict=True):
        condition = condition & left[x].eqNullSafe(right[y])
    return condition


def _weight_of(level: str, weights: Mapping[str, int]) -> Column:
    weight = F.lit(1)
    for value, w in weights.items():
        weight = F.when(F.col(level) == value, F.lit(int(w))).otherwise(weight)
    return weight


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``children`` (parent columns, node, capacity, weight, parent_budget) with ``budget``.

    A parent's budget goes to its children by weight. A child whose capacity is less than its share gets its capacity, and
    what it leaves goes to its siblings, again by weight. With the children in ascending order of capacity / weight those
    that fill up come first, so running sums settle all rounds of this at once. Shares are rounded down.
    """
    by_parent = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ahead = by_parent.orderBy(F.expr("cast(capacity AS double) / weight"), "node").rowsBetween(Window.unboundedPreceding, -1)

    def summed(c: str | Column, window) -> Column:
        return F.coalesce(F.sum(c).over(window), F.lit(0)).cast("decimal(38,0)")

    wide = children.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("capacity", "weight", "parent_budget")})
    judged = wide.withColumns({
        "w_ahead": summed("weight", ahead), "c_ahead": summed("capacity", ahead), "w_all": summed("weight", by_parent),
    }).withColumn("full", F.expr("capacity * (w_all - w_ahead) <= (parent_budget - c_ahead) * weight"))
    rest = judged.withColumns({
        "c_full": summed(F.when(F.col("full"), F.col("capacity")), by_parent),
        "w_open": F.col("w_all") - summed(F.when(F.col("full"), F.col("weight")), by_parent)})
    budget = F.when(F.col("full"), F.col("capacity").cast("long")).otherwise(
        F.expr("((parent_budget - c_full) * weight) div nullif(w_open, 0)"))
    return rest.select(*children.columns, budget.alias("budget"))


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], budget: int | None = None,
    share: tuple[int, int] = (1, 2), max_epochs: int = 1,
) -> DataFrame:
    """``leaves`` (levels, size) with ``budget``: the tree's budget handed down from level to level.

    ``weights`` has a mapping for each level, from a value to its weight among its siblings; other values weigh 1, and 0
    leaves a value out. A leaf can give ``max_epochs`` times its size, a node what its leaves can. Handing a budget down by
    :func:`share_out` makes up for a shortage among siblings first, and only what a whole subtree can't give goes to the
    subtree's own siblings. ``budget`` is in units of size; without it the part ``share`` of the total is taken.
    """
    tree = leaves.select(*levels, (F.col("size") * max_epochs).alias("capacity"))
    for level, of_level in zip(levels, weights, strict=True):
        tree = tree.withColumn("capacity", F.when(_weight_of(level, of_level) > 0, F.col("capacity")).otherwise(F.lit(0)))
    if budget is None:
        top = leaves.agg((F.coalesce(F.sum("size"), F.lit(0)) * share[0]).alias("s")).select(
            F.expr(f"s div {int(share[1])}").alias("budget"))
    else:
        top = leaves.agg(F.lit(int(budget)).cast("long").alias("budget"))
    # one row, the aggregate's: a scalar for every node of the first level
    known, parents = None, []
    for k, level in enumerate(levels):
        nodes = tree.groupBy(*levels[:k + 1]).agg(F.sum("capacity").alias("capacity"))
        if known is None:
            nodes = nodes.withColumn("parent_budget", top.scalar())
        else:
            up = known.select(*(F.col(c).alias(f"up_{c}") for c in parents), F.col("budget").alias("parent_budget"))
            nodes = nodes.join(up, _same(parents, [f"up_{c}" for c in parents], nodes, up)).select(*nodes.columns, "parent_budget")
        # a weight of 0 has capacity 0 and any weight will do
        children = nodes.withColumns({"weight": F.greatest(_weight_of(level, weights[k]), F.lit(1)), "node": F.col(level)})
        known = share_out(children, parents).select(*levels[:k + 1], "budget")
        parents = list(levels[:k + 1])
    return known


def mix_to_weights(
    records: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], key: Sequence[str], size: str,
    budget: int | None = None, share: tuple[int, int] = (1, 2), max_epochs: int = 1, seed: int = 0,
) -> DataFrame:
    """``records`` chosen so that the categories' sizes meet their target weights, with ``epoch`` (1, 2, ...).

    For the library's rides: ``levels=("rideable_type", "member_casual", "weekday")``, ``key=("ride_id",)`` and
    ``size="ride_length"``; for texts: domain, language and source, and a count of tokens. Budgets come from
    :func:`leaf_budgets`. A leaf with a budget of f times its size and a rest gives all its records f times, as epochs 1 to f,
    and in epoch f + 1 a prefix: records in the order of a hash of (seed, epoch, key) until the rest is reached, the
    record that reaches it included.

    Missing level values are a category of their own, a missing or negative size counts 0. Rows of equal key have the same
    draw and stay together; repeated rows stay repeated. An empty table gives an empty one. All columns of ``records`` are
    kept; names that start with ``mix_`` are the operator's own.

    Leaf sizes are grouped in the map tasks. The prefix of a leaf, however large, is found by sums over 4096 ranges of
    the draw and then within the one range in which the rest runs out. Records themselves aren't moved: they are compared
    with their leaf's last draw, which the tasks know (:func:`_with_leaves`; beyond SMALL_ROWS leaves records are
    shuffled, hot leaves in parts). Written tables hold (levels, key, size) and a row a leaf.
    """
    own = [f"mix_{i}" for i in range(len(levels))]
    light = write_scratch(records.select(
        *(F.col(c).alias(n) for n, c in zip(own, levels, strict=True)),
        F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).alias("mix_key"),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("mix_size")), "mix")
    leaves = light.groupBy(*own).agg(F.sum("mix_size").alias("size"))
    shares = leaf_budgets(leaves, own, weights, budget, share, max_epochs)
    sized = leaves.join(shares.withColumnsRenamed({c: f"b_{c}" for c in own}), F.expr(
        " AND ".join(f"{c} <=> b_{c}" for c in own))).select(*own, "size", "budget")
    plan = write_scratch(sized.select(
        *own, F.when(F.col("size") > 0, F.expr("budget div nullif(size, 0)")).otherwise(0).alias("full"),
        F.when(F.col("size") > 0, F.expr("budget % nullif(size, 0)")).otherwise(0).alias("rest")), "mix_plan")

    def draw(key: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("full") + 1).cast("string"), key))

    drawn = _with_plan(light, plan, own).filter("rest > 0").withColumn("draw", draw(F.col("mix_key"))).withColumn(
        "bucket", F.substring("draw", 1, 3))
    in_order = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy(*own, "rest", "bucket").agg(F.sum("mix_size").alias("size"))
    edge = sums.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0))).filter(
        "before < rest AND before + size >= rest").select(
        *(F.col(c).alias(f"e_{c}") for c in own), F.col("bucket").alias("e_bucket"), "before")
    within = Window.partitionBy(*own).orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = drawn.join(edge, F.expr(" AND ".join(f"{c} <=> e_{c}" for c in own) + " AND bucket = e_bucket")).withColumn(
        "reached", F.col("before") + F.sum("mix_size").over(within)).filter("reached >= rest").groupBy(*own).agg(
        F.min("draw").alias("last"))
    ends = plan.join(last.withColumnsRenamed({c: f"l_{c}" for c in own}), F.expr(
        " AND ".join(f"{c} <=> l_{c}" for c in own)), "left").select(*own, "full", "last")
    named = ends.withColumnsRenamed({"full": "mix_full", "last": "mix_last", **{c: f"n_{c}" for c in own}})
    renamed = {f"n_{c}": f"`{level}`" for c, level in zip(own, levels, strict=True)}
    joined = _with_leaves(records, write_scratch(named, "mix_ends"), renamed, F.concat_ws("|", *(F.col(c).cast("string") for c in key)))
    text_key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    own_draw = F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("mix_full") + 1).cast("string"), text_key))
    times = F.col("mix_full") + F.when(own_draw <= F.col("mix_last"), 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))
    return joined.withColumn("mix_epochs", epochs).select(*records.columns, F.explode("mix_epochs").alias("epoch"))


def _with_leaves(rows: DataFrame, leaves: DataFrame, names: Mapping[str, str], spread: Column) -> DataFrame:
    """``rows`` joined with the written table ``leaves``, a row a leaf; ``names`` maps its columns to those of the rows.

    Up to SMALL_ROWS leaves with names that fit in NAME_BYTES it is sent to the tasks, and rows stay where they are. Otherwise rows
    of a leaf are spread over SALTS tasks by ``spread``, and the leaf is repeated for each.
    """
    size = leaves.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum((
        F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in names), F.lit(0))).alias("bytes")).first()
    same = " AND ".join(f"{b} <=> {a}" for a, b in names.items())
    if size["rows"] <= SMALL_ROWS and (size["bytes"] or 0) <= SMALL_ROWS * NAME_BYTES:
        return rows.join(F.broadcast(leaves), F.expr(same)).drop(*names)
    salted = rows.withColumn("mix_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = leaves.withColumn("mix_leaf_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, F.expr(f"{same} AND mix_salt = mix_leaf_salt")).drop(*names, "mix_salt", "mix_leaf_salt")


def _with_plan(light: DataFrame, plan: DataFrame, own: Sequence[str]) -> DataFrame:
    return _with_leaves(light, plan.withColumnsRenamed({c: f"p_{c}" for c in own}), {f"p_{c}": c for c in own}, F.col("mix_key"))


def word_count(text: Column) -> Column:
    """Words of a text, the size by which texts are mixed; 0 for missing ones."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
