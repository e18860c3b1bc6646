"""Regressions against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation

from areaflow.operators import connectedness as K
from areaflow.operators import regress as R


def robust(x, y, w=None, kind="HC3"):
    x = np.column_stack([np.ones(len(y)), x])
    w = np.ones(len(y)) if w is None else w
    xs, ys = x * np.sqrt(w)[:, None], y * np.sqrt(w)
    g = np.linalg.pinv(xs.T @ xs)
    b = g @ xs.T @ ys
    e = ys - xs @ b
    h = np.einsum("ij,jk,ik->i", xs, g, xs)
    s = e ** 2 / (1 - h) ** 2 if kind == "HC3" else e ** 2 * len(y) / (len(y) - x.shape[1])
    v = g @ (xs.T * s) @ xs @ g
    return b, np.sqrt(np.diag(v))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 60
    x1, x2 = rng.normal(size=n), rng.uniform(size=n)
    y = 1 + 2 * x1 - x2 + rng.normal(size=n) * (1 + x2)
    w = rng.integers(1, 20, n).astype(float)
    g = np.where(np.arange(n) < 25, "a", "b")
    return g, x1, x2, y, w


@pytest.mark.parametrize("kind,weighted", [("HC1", False), ("HC3", False), ("HC3", True)])
def test_fit_matches_numpy(spark, data, kind, weighted):
    g, x1, x2, y, w = data
    df = spark.createDataFrame([(str(a), float(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(*data)],
                               "g string, x1 double, x2 double, y double, w double")
    fit = R.fit_linear(df, "y", ["x1", "x2"], ["g"], "w" if weighted else None, kind).collect()
    for name in "ab":
        m = g == name
        b, se = robust(np.column_stack([x1, x2])[m], y[m], w[m] if weighted else None, kind)
        for i, t in enumerate(["const", "x1", "x2"]):
            r = next(r for r in fit if r.g == name and r.term == t)
            assert r.coef == pytest.approx(b[i], abs=1e-10) and r.se == pytest.approx(se[i], abs=1e-10)
            assert r.p == pytest.approx(math.erfc(abs(b[i] / se[i]) / math.sqrt(2))) and r.n == m.sum()


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0)], "g string, x double, y double")
    assert R.fit_linear(df, "y", ["x"], ["g"], min_rows=3).count() == 0


def test_absent_event_does_not_disturb_the_fit(spark):
    rng = np.random.default_rng(9)
    rows = [(d, t, "hi", float(rng.normal() + (t >= 0) + (d == "S2"))) for d in ("S1", "S2") for t in range(-7, 8)]
    df = spark.createDataFrame(rows, "disaster string, t int, int_bin string, mean_rog double")
    got = R.panel_by_bin(df, ["S1", "S2", "S3"]).first()
    post = np.array([r[1] >= 0 for r in rows], float)
    b, se = robust(np.column_stack([post, [r[0] == "S2" for r in rows]]), np.array([r[3] for r in rows]))
    assert got.alpha1_km == pytest.approx(b[1]) and got.std_err == pytest.approx(se[1]) and got.n == 30
    one_side = df.filter("t >= 0")
    assert R.panel_by_bin(one_side, ["S1", "S2"]).count() == 0


def test_residuals_are_orthogonal(spark, data):
    _, x1, _, y, _ = data
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x1, y)], "x double, y double")
    r = np.array([(q.x, q.y_r) for q in R.residualise(df, ["y"], "x").collect()])
    assert abs(r[:, 1].sum()) < 1e-9 and abs((r[:, 0] * r[:, 1]).sum()) < 1e-9


@pytest.mark.parametrize("limit,rows", [(2, 3), (3, 5)])
def test_refit_only_with_enough_areas(spark, limit, rows):
    df = spark.createDataFrame([("a", 1.0, 1.0, 9.0), ("b", 2.0, 2.5, 9.0), ("c", 3.0, 3.0, 9.0), ("d", 4.0, 9.0, 9.0),
                                ("e", 5.0, 0.0, 9.0)], "k string, x double, y double, res double")
    out = R.residual_refit(df, df.filter("k < 'd'"), "k", "y", "x", "res", limit).collect()
    assert len(out) == rows
    if rows == 3:
        assert sum(r.res for r in out) == pytest.approx(0.0) and max(abs(r.res) for r in out) < 1
    else:
        assert {r.res for r in out} == {9.0}


def test_variance_shares_match_stepwise_fits(spark, data):
    _, inc, ec, y, w = data
    ec = ec + 0.3 * inc
    df = spark.createDataFrame([("S", float(a), float(b), float(c), float(d)) for a, b, c, d in zip(inc, ec, y, w)],
                               "event string, median_income double, ec double, out double, n_damaged double")
    got = R.variance_decomposition(df, ["out"], "ec").first()

    def r2(x):
        x = np.column_stack([np.ones(len(y)), x])
        s = np.sqrt(w)
        b = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
        e = y - x @ b
        return 1 - (w * e ** 2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum()

    joint = r2(np.column_stack([inc, ec]))
    assert got.r2_income_only == pytest.approx(r2(inc)) and got.r2_ec_only == pytest.approx(r2(ec))
    assert got.r2_income_plus_ec == pytest.approx(joint) and got.delta_r2_ec == pytest.approx(joint - r2(inc))
    assert got.adj_r2_joint == pytest.approx(1 - (1 - joint) * 59 / 57)


def test_group_shares_by_hand(spark):
    person = spark.createDataFrame(
        [(1, "S", "a", 1, 60.0), (2, "S", "a", 1, None), (3, "S", "b", 0, 500.0), (4, "S", "b", 1, 20.0), (5, "S", None, 1, 20.0)],
        "pid long, disaster string, home_area string, evacuated int, distance_km double")
    ec = spark.createDataFrame([("a", 10.0, -1.0), ("b", 20.0, 1.0)], "home_area string, median_income double, ec_residual double")
    got = {(r.group, r.threshold_km): (r.mean_share, r.n_area) for r in K.group_shares(person, ec).collect()}
    low, high = K.GROUP_LABELS[0], K.GROUP_LABELS[3]
    assert got[(low, 10)] == (0.5, 1) and got[(low, 50)] == (0.5, 1) and got[(low, 100)] == (0.0, 1)
    assert got[(high, 10)] == (0.5, 1) and got[(high, 50)] == (0.0, 1)
    assert K.ec_effect(person, ec).count() == 0  # two areas are too few


def test_destination_excess(spark):
    od = spark.createDataFrame([("a", "a", 9.0), ("a", "b", 1.0), ("b", "a", 5.0)], "home_area string, dest_area string, weight double")
    person = spark.createDataFrame([("S", "a", "b", 1, 60.0), ("S", "a", "b", 1, 20.0), ("S", "a", "z", 1, 60.0), ("S", "a", "b", 0, 60.0)],
                                   "disaster string, home_area string, dest_area string, evacuated int, distance_km double")
    got = {r.threshold_km: (r.people, r.excess) for r in K.destination_excess(person, od).collect()}
    assert got == {10: (2, pytest.approx(math.log(2 / 6))), 50: (1, pytest.approx(math.log(2 / 6)))}
    other = {r.home_area: r.baseline for r in K.origin_baseline(od, include_self=False).collect()}
    assert other == {"a": 1.0, "b": 5.0}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_standardised_columns_follow_from_one_pass(spark, data, tmp_path):
    g, x1, x2, y, w = data
    df = spark.createDataFrame([(str(a), float(b), float(c) * 1e6 + 4e8, float(d), int(e), 5.0) for a, b, c, d, e in zip(*data)],
                               "event string, metric double, income double, out1 double, n_damaged int, out2 double")
    df.withColumn("spare", df.out1 * 2).write.parquet(f"{tmp_path}/recovery")
    rows = spark.read.parquet(f"{tmp_path}/recovery")
    fit = R.recovery_regression(rows, ["out1", "out2"], ["metric"], "income", min_rows=26)
    got = {(r.event, r.outcome, r.term): (r.coef, r.se) for r in fit.collect()}
    m = g == "b"  # the other group is too small, and out2 does not vary
    z = lambda v: (v - v.mean()) / v.std()
    income = x2[m] * 1e6 + 4e8
    slope, cut = np.polyfit(income - income.mean(), x1[m], 1)
    free = x1[m] - slope * (income - income.mean()) - cut
    b, se = robust(np.column_stack([z(income), z(free)]), z(y[m]), w[m].astype(int).astype(float))
    assert {k[:2] for k in got} == {("b", "out1")}
    for i, t in enumerate(["const", "income_z", "metric_r_z"]):
        assert got["b", "out1", t] == pytest.approx((b[i], se[i]), abs=1e-10)
    assert scans(fit) == 3
    parts = R.variance_decomposition(rows, ["out1"], "metric", "income", min_rows=26)
    assert scans(parts) == 2
    ww = w[m].astype(int).astype(float)

    def r2(cols):
        xs = np.column_stack([np.ones(m.sum()), *cols]) * np.sqrt(ww)[:, None]
        e = z(y[m]) * np.sqrt(ww) - xs @ np.linalg.lstsq(xs, z(y[m]) * np.sqrt(ww), rcond=None)[0]
        centred = z(y[m]) - np.average(z(y[m]), weights=ww)
        return 1 - (e ** 2).sum() / (ww * centred ** 2).sum()

    row = parts.first()
    assert row.r2_income_only == pytest.approx(r2([z(income)]), abs=1e-10)
    assert row.r2_income_plus_ec == pytest.approx(r2([z(income), z(x1[m])]), abs=1e-10)


def test_effect_where_nothing_varies(spark):
    rows = [("S", f"p{i}", f"a{i % 4}", 1 if i % 3 else 0, 60.0) for i in range(40)]
    person = spark.createDataFrame(rows, "disaster string, pid string, home_area string, evacuated int, distance_km double")
    ec = spark.createDataFrame([(f"a{i}", 0.5) for i in range(4)], "home_area string, ec_residual double")
    out = K.ec_effect(person, ec, [10]).collect()
    assert [(r.beta_pp, r.n_area) for r in out] == [(0.0, 4)]


def test_omitted_groups_are_counted(spark):
    rows = [("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, 2.0), ("b", 2.0, 2.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    counts = Observation()
    out = R.fit_linear(df, "y", ["x"], ["g"], min_rows=3, counts=counts).collect()
    assert {r.g for r in out} == {"a"} and counts.get == {"n_groups": 2, "n_omitted": 1}
