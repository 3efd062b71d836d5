import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallywork.operators import ordering as O
from tallywork.operators import quantiles as Q
from tallywork.operators import stats as S
from tallywork.operators.numbering import renumber


def test_wide_correlations(spark):
    draw = np.random.default_rng(7)
    values = draw.normal(size=(400, 40)) * 10.0 ** draw.integers(-3, 4, 40) + 1e6 * draw.normal(size=40)
    values[:, 1] = values[:, 0] * -2                                    # the very opposite
    values[draw.random(values.shape) < 0.2] = np.nan
    values[:, 2] = 5.0                                                  # no spread
    values[:, 3] = np.nan                                               # no values
    values[0, 4] = np.inf
    names = [f"col.{i}" if i == 5 else f"c{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in values], names).repartition(7)
    df = df.withColumnRenamed("col.5", "c5").withColumn("extra", F.lit("x"))
    names[5] = "c5"
    got = {(x, y): r for x, y, r in S.wide_correlations(df, names).collect()}
    assert len(got) == 1600
    values[0, 4] = np.nan
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            a, b = values[both, i], values[both, j]
            if {i, j} & {2, 3}:
                assert got[x, y] is None
            else:
                assert abs(got[x, y] - np.corrcoef(a, b)[0, 1]) < 1e-9, (x, y)
    assert S.wide_correlations(df.limit(0), ["c0", "c1"]).filter("r is not null").count() == 0
    single = spark.createDataFrame([(1.0, 2.0), (2.0, None)], "a double, b double")
    assert {(x, y): r for x, y, r in S.wide_correlations(single, ["a", "b"]).collect()}["a", "b"] is None


def test_correlations_skip_incomplete_pairs(spark):
    data = [(1.0, 2.0, None), (2.0, 4.1, 3.0), (3.0, 5.9, 1.0), (4.0, 8.2, 2.0), (None, 1.0, 9.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(x, y): r for x, y, r in rows(S.correlation_matrix(df, ["a", "b", "c"]))}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"] and abs(got["a", "a"] - 1) < 1e-12
    assert abs(got["a", "b"] - np.corrcoef([1, 2, 3, 4], [2, 4.1, 5.9, 8.2])[0, 1]) < 1e-12
    assert abs(rows(S.pair_correlation(df, "a", "c"))[0][0] - np.corrcoef([2, 3, 4], [3, 1, 2])[0, 1]) < 1e-12


def test_regression_line(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    slope, intercept, r2 = rows(S.regression_line(df, "x", "y"))[0]
    assert (round(slope, 9), round(intercept, 9), round(r2, 9)) == (2.0, 1.0, 1.0)


@pytest.mark.parametrize("probs", [(0.25, 0.5, 0.75), (0.0, 1.0), (0.1, 0.37, 0.99)])
def test_quantiles_are_exact(spark, probs):
    rng = np.random.default_rng(5)
    values = {"hot": np.r_[np.round(rng.normal(size=3000), 3), np.full(1500, 0.25)], "few": np.array([3.0, 9.0]), "one": np.array([7.0])}
    data = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {(k, p): q for k, p, q in rows(Q.quantiles(df, "v", probs, ["k"]))}
    assert set(got) == {(k, p) for k in values for p in probs}
    for (k, p), q in got.items():
        assert abs(q - np.quantile(values[k], p)) < 1e-9, (k, p)
    overall = np.concatenate(list(values.values()))
    for p, q in rows(Q.quantiles(df, "v", probs)):
        assert abs(q - np.quantile(overall, p)) < 1e-9


def test_a_group_is_spread_over_many_pieces(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), (F.hash("id") % 9973).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = Q.store_histogram(Q.count_values(df, "v", ["k"]), "v", ["k"])
        pieces = stored.groupBy("__part").count().collect()
        assert len(pieces) >= 6 and max(p["count"] for p in pieces) < 2 * stored.count() / len(pieces)
        got = rows(Q.histogram_quantiles(stored, "v", [0.5], ["k"]))[0][2]
        assert got == np.quantile([r[0] for r in df.select("v").collect()], 0.5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_box_summary_and_outliers(spark):
    data = [(1, float(v)) for v in (1, 2, 3, 4, 5, 100)] + [(0, 2.0), (0, 2.0), (0, None), (None, 5.0)]
    df = spark.createDataFrame(data, "g int, v double")
    got = rows(S.box_summary(df, "g", "v"))
    assert got == [(0, 2, 2.0, 2.0, 2.0, 2.0, 2.0, 0), (1, 6, 2.25, 3.5, 4.75, 1.0, 5.0, 1)]
    assert rows(S.outliers(df, "g", "v")) == [(1, 100.0)]


def test_histogram(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 9.9), ("a", 10.0), ("b", -0.1), ("b", None)], "k string, v double")
    assert rows(S.histogram(df, "v", 10.0, ["k"])) == [("a", 0, 0.0, 2), ("a", 1, 10.0, 1), ("b", -1, -10.0, 1)]


def test_poisson_weights_have_mean_and_variance_one():
    cells, one = np.arange(20000, dtype="uint64") * np.uint64(7919), np.ones(20000, "int64")
    weights = S._cell_weights(cells, one, 0, 40)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    assert np.array_equal(weights[:, 20:24], S._cell_weights(cells, one, 20, 4))
    assert abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.03


def test_cells_weigh_as_much_as_their_rows():
    count = np.array([1, 2, 5, 8, 9, 400])
    cells = np.arange(1, 7, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    weight = S._cell_weights(cells, count, 0, 4000)
    assert np.allclose(weight.mean(1), count, rtol=0.05) and np.allclose(weight.var(1), count, rtol=0.12)
    assert np.array_equal(weight, S._cell_weights(cells, count, 0, 4000))
    assert np.array_equal(weight[1:4, 200:208], S._cell_weights(cells[1:4], count[1:4], 200, 8))


def test_band_of_repeated_values_fits_the_standard_error(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    mean, low, high = rows(S.mean_with_ci(df, ["k"], "v").select("mean", "low", "high"))[0]
    assert mean == 4.5 and 0.85 < (high - low) / (2 * 1.96 * (8.25 / 4000) ** 0.5) < 1.15


def test_bootstrap_band_ignores_partitioning(spark):
    rng = np.random.default_rng(3)
    data = [(i, "a" if i < 900 else "b", float(v)) for i, v in enumerate(rng.normal(10, 2, 1000))] + [(1000, "c", 4.0), (1001, "c", None)]
    df = spark.createDataFrame(data, "id int, k string, v double")
    one, many = (S.mean_with_ci(df.repartition(n), ["k"], "v", n_boot=500) for n in (1, 9))
    a, b = rows(one), rows(many)
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in a] == [
        [round(x, 9) if isinstance(x, float) else x for x in r] for r in b]
    by_key = {r[0]: r[1:] for r in a}
    assert by_key["c"] == (4.0, 4.0, 4.0)  # a single observation has no spread
    mean, low, high = by_key["a"]
    se = 2 / 900 ** 0.5
    assert low < mean < high and 0.8 < (high - low) / (2 * 1.96 * se) < 1.2


def test_renumber_in_any_partitioning(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "g int, i int").repartition(11)
    want = sorted((i % 7, -i) for i in range(500))
    for partitions in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = sorted((n, g, -i) for g, i, n in rows(renumber(df, ["g", F.desc("i")], "n")))
        assert [(g, i) for _, g, i in got] == want and [n for n, _, _ in got] == list(range(1, 501))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_renumber_without_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(renumber(spark.range(3000).withColumn("k", F.hash("id")), ["k", "id"], "n", start=0))
        assert [n for _, _, n in sorted(got, key=lambda r: (r[1], r[0]))] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows(renumber(spark.range(0), ["id"])) == []


def test_sorting(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert rows(O.sort(df, "a"), True) == [(1,), (2,), (None,)]
    assert rows(O.sort(df, "a", descending=True), True) == [(2,), (1,), (None,)]
    days = spark.createDataFrame([("Monday",), ("Sunday",), ("Someday",)], "d string")
    assert rows(O.sort_by_levels(days, "d", ["Sunday", "Monday"]), True) == [("Sunday", 1), ("Monday", 2), ("Someday", None)]


def test_head_and_tail(spark):
    df = spark.createDataFrame([(i, i * 10) for i in (5, 1, 4, 2, 3)], "a int, b int")
    assert rows(O.head(df, 2, ["a"], "rank"), True) == [(1, 10, 1), (2, 20, 2)]
    assert rows(O.tail(df, 2, ["a"], "rank"), True) == [(4, 40, 1), (5, 50, 2)]
    assert "TakeOrderedAndProject" in O.head(df, 2, ["a"])._jdf.queryExecution().executedPlan().toString()


def test_ranks_by_count(spark):
    df = spark.createDataFrame([(v,) for v in "aabbbcd"] + [(None,)], "v string")
    assert sorted(rows(O.rank_by_count(df, "v")), key=lambda r: r[2]) == [("b", 3, 0), ("a", 2, 1), ("c", 1, 2), ("d", 1, 3)]
    assert rows(O.values_at_ranks(df, "v", [1, 3, 9])) == [(1, "a"), (3, "d")]


def _skewed(spark, rows_=20_000):
    df = spark.range(rows_).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 30 = 2 THEN NULL ELSE concat('k', id % 7) END AS k",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN 5.0D ELSE (hash(id) % 100000) / 7.0D END AS v")
    groups = {}
    for k, v in df.collect():
        groups.setdefault(k, []).extend([] if v is None else [v])
    return df, {k: g for k, g in groups.items() if g}


@pytest.mark.parametrize("wrong", ["right", "too high", "too low", "narrow", "nothing"])
@pytest.mark.parametrize("bracket_rows", [1 << 20, 10])
def test_quantiles_whatever_the_sketch_says(spark, monkeypatch, wrong, bracket_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "BRACKET_ROWS", bracket_rows)
    monkeypatch.setattr(Q, "SMALL_GROUP", 0)
    monkeypatch.setattr(Q, "SMALL_TABLE", 0)
    sketch = Q._sketch
    edges = {"right": sketch, "too high": lambda c, probs, a: F.transform(sketch(c, probs, a), lambda x: x + 1e6),
             "too low": lambda c, probs, a: F.transform(sketch(c, probs, a), lambda x: x - 1e6),
             "narrow": lambda c, probs, a: F.transform(sketch(c, probs, a), lambda x: F.lit(5.0)),
             "nothing": lambda c, probs, a: F.transform(sketch(c, probs, a), lambda x: F.lit(None).cast("double"))}
    monkeypatch.setattr(Q, "_sketch", edges[wrong])
    df, groups = _skewed(spark)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(k, p): q for k, p, q in rows(Q.quantiles(df, "v", probs, ["k"]))}
    assert set(got) == {(k, p) for k in groups for p in probs}
    assert all(abs(q - np.quantile(groups[k], p)) < 1e-9 for (k, p), q in got.items())
    everything = [v for g in groups.values() for v in g]
    overall = rows(Q.column_quantiles(df.selectExpr("v", "-v AS w"), ["v", "w"], probs))
    assert len(overall) == 10
    assert all(abs(q - np.quantile(everything if no == 0 else [-v for v in everything], p)) < 1e-9 for no, p, q in overall)


def test_quantiles_write_little(spark, tmp_path):
    from tallywork.session import SCRATCH_SETTING

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    spark.range(400_000).selectExpr("id % 3 AS k", "rand(7) AS v").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(SCRATCH_SETTING, None)
    spark.conf.set(SCRATCH_SETTING, str(tmp_path / "scratch"))
    try:
        S.box_summary(spark.read.parquet(str(tmp_path / "in")), "k", "v").collect()
    finally:
        spark.conf.unset(SCRATCH_SETTING) if before is None else spark.conf.set(SCRATCH_SETTING, before)
    assert 0 < size(tmp_path / "scratch") < 0.1 * size(tmp_path / "in")
