"""Bin edges, kernel density, quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaflow.functions.frames import exact_quantiles, exact_quantiles_of, numbered, zscore
from areaflow.operators import density as D


def col(spark, xs, name="v"):
    return spark.createDataFrame([(float(x),) for x in xs], f"{name} double")


def test_linear_bins_last_one_closed_and_empty_present(spark):
    h = D.histogram(col(spark, [0, 0.5, 1, 99.5, 100, 100.5, -1]), "v", D.linear_edges(0, 100, 100)).collect()
    n = {r.bin: r.n for r in h}
    assert len(n) == 100 and n[0] == 2 and n[1] == 1 and n[99] == 2 and sum(n.values()) == 5
    assert sum(r.density for r in h) == pytest.approx(1.0)


@pytest.mark.parametrize("closed", [True, False])
def test_bins_agree_with_numpy(spark, closed):
    edges = D.log_edges(0.5, 500, 54)
    rng = np.random.default_rng(1)
    xs = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 1e9), rng.lognormal(2, 2, 500), [0.0, -1.0]])
    got = [r.b for r in col(spark, xs).select(D.bin_of("v", edges, True, closed).alias("b")).collect()]
    idx = np.searchsorted(edges, xs, side="right") - 1
    for x, g, i in zip(xs, got, idx):
        want = None if i < 0 or x > edges[-1] or (x == edges[-1] and not closed) else min(i, 53)
        assert g == want, x


def test_kde_against_direct_sum(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(5, 2, 400), 1), rng.exponential(3, 50)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("same", 1.0)] * 9 + [("few", 1.0), ("few", 2.0)]
    df = spark.createDataFrame([*rows, ("a", float("nan")), ("a", None)], "g string, v double")
    for factor in ("scott", 0.15):
        got = D.kde(df, "v", -5.0, 20.0, 101, ["g"], factor, 5).toPandas()
        assert set(got["g"]) == {"a", "b"}
        for g, xs in (("a", a), ("b", b)):
            h = (len(xs) ** -0.2 if factor == "scott" else factor) * xs.std(ddof=1)
            grid = np.linspace(-5, 20, 101)
            want = np.exp(-0.5 * ((grid[:, None] - xs) / h) ** 2).sum(1) / (len(xs) * h * math.sqrt(2 * math.pi))
            have = got[got["g"] == g].sort_values("x")
            assert np.allclose(have["x"], grid) and np.allclose(have["density"], want, atol=1e-14)


def test_kde_weights_equal_repeats(spark):
    base = spark.createDataFrame([(1.0, 3), (2.0, 1), (4.0, 2)], "v double, w int")
    flat = col(spark, [1, 1, 1, 2, 4, 4])
    key = lambda df: {round(r.x, 9): r.density for r in df.collect()}
    assert key(D.kde(base, "v", 0.0, 5.0, 11, weight="w")) == pytest.approx(key(D.kde(flat, "v", 0.0, 5.0, 11)))


def test_quantiles_move_no_row_before_it_is_counted(spark):
    """Neither side of the bounds is shuffled to meet the rows, and a group without a name is a group."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS g", "id * 7919 % 30000 AS v")
    out = exact_quantiles(df, "v", {"q": 0.5}, ["g"], accuracy=1_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.g: r.q for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert got == {g: float(np.median([i * 7919 % 30000 for i in range(30_000) if i % 3 == (g or 0)])) for g in (None, 1, 2)}



@pytest.mark.parametrize("accuracy", [25, 10_000])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(5)
    groups = {"one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 50, "wide": list(rng.normal(0, 1e6, 999)),
              # one value holds most of the rows
              "hot": [5.0] * 700 + list(rng.uniform(0, 10, 300))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None)], "g string, v double")
    probs = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.98, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy).collect()}
    for g, xs in groups.items():
        for k, p in probs.items():
            assert got[g][k] == pytest.approx(np.percentile(xs, 100 * p), abs=1e-9), (g, k)
    single = exact_quantiles(df, "v", {"m": 0.5}).first().m
    assert single == pytest.approx(np.median([x for xs in groups.values() for x in xs]))


def test_quantiles_of_several_columns_in_two_passes(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("g" if i % 3 else "h", float(rng.integers(0, 400)), float(rng.normal()) if i % 5 else None) for i in range(9000)]
    rows += [("only", 4.0, None), ("none", None, float("nan"))]
    spark.createDataFrame(rows, "g string, a double, b double").repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = exact_quantiles_of(df, {"a": {"a2": 0.02, "a5": 0.5}, "b": {"b5": 0.5, "b98": 0.98}}, ["g"], accuracy=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    got = {r.g: r for r in out.collect()}
    for g in "gh":
        a, b = ([r[k] for r in rows if r[0] == g and r[k] is not None] for k in (1, 2))
        want = [np.percentile(a, 2), np.percentile(a, 50), np.percentile(b, 50), np.percentile(b, 98)]
        assert [got[g].a2, got[g].a5, got[g].b5, got[g].b98] == pytest.approx(want, abs=1e-12)
    assert (got["only"].a5, got["only"].b5) == (4.0, None) and "none" not in got


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.97, 1.0])
def test_one_quantile_of_groups_of_any_size(spark, p):
    groups = {n: np.random.default_rng(n).normal(size=n) for n in (1, 2, 3, 4, 49, 50, 51, 333, 2000)}
    df = spark.createDataFrame([(n, float(v)) for n, vs in groups.items() for v in vs], "g int, v double")
    got = {r.g: r.q for r in exact_quantiles(df, "v", {"q": p}, ["g"], accuracy=50).collect()}
    assert got == {n: pytest.approx(np.percentile(vs, 100 * p), abs=1e-12) for n, vs in groups.items()}


def test_weighted_quantile_counts_people(spark):
    df = spark.createDataFrame([(10.0, 1), (20.0, 5), (30.0, 1), (None, 9)], "v double, n int")
    assert exact_quantiles(df, "v", {"m": 0.5}, weight="n").first().m == 20.0


def test_binned_share_opens_a_bin_at_the_upper_end(spark):
    got = {r.x: r.y for r in D.binned_share(col(spark, [0, 0.1, 0.5, 24, 24.1]), "v", 0.5, 24.0).collect()}
    assert got == {0.25: pytest.approx(1 / 3), 0.75: pytest.approx(1 / 3), 24.25: pytest.approx(1 / 3)}


def test_breaks_fall_back_to_even_steps(spark):
    cells = spark.createDataFrame([(1,), (1,), (1,), (6,)], "n long")
    assert [r.boundary for r in D.class_breaks(cells).orderBy("k").collect()] == [1, 2, 3, 4, 5, 6]
    cells = spark.createDataFrame([(i,) for i in range(1, 12)], "n long")
    assert [r.boundary for r in D.class_breaks(cells).orderBy("k").collect()] == [1, 3, 5, 7, 9, 11]


def test_hexbin_keeps_every_point(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.normal(size=(300, 2))], "x double, y double")
    assert D.hexbin(df, "x", "y").agg(F.sum("n")).first()[0] == 300


def test_zscore_without_variation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    z = sorted((r.g, r.v_z) for r in zscore(df, ["v"], ["g"]).collect())
    assert z == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]
    assert {r.v_z for r in zscore(df.filter("g = 'b'"), ["v"], flat=None).collect()} == {None}


def test_numbered(spark):
    assert sorted(r.bin for r in numbered(spark.range(1), 3).collect()) == [0, 1, 2]
