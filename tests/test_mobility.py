"""Homes from calls, activity, ranks, expansion, cohort enrichment, random pairs."""

from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from areaflow.functions import columns as C
from areaflow.operators import density, mobility, ties


def test_code_rules(spark):
    df = spark.createDataFrame([("501.0",), (" 501 ",), ("123456",), (None,), ("-5",), ("501.0 ",)], "c string")
    assert [r.v for r in df.select(C.norm_area_code("c").alias("v")).collect()] == [
        "00501", "00501", "123456", None, "-0005", "501.0"]
    assert df.select(C.norm_geoid(F.lit("48-201 31.0"))).first()[0] == "00048201310"
    assert spark.createDataFrame([(501.0,)], "c double").select(C.norm_area_code("c")).first()[0] == "00501"


def test_missing_number_rules(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.v for r in df.select(C.finite_or_null("x").alias("v")).collect()] == [1.5, None, None, None]
    assert spark.sql("select 1").select(C.ratio(F.lit(1), F.lit(0))).first()[0] is None
    assert df.select(C.clip("x", 0, 1).alias("v")).first().v == 1.0


def test_stars_cutoffs(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.07,), (0.2,), (float("nan"),), (None,)], "p double")
    rows = df.select(C.stars("p").alias("t"), C.stars("p", C.FOREST_CUTS).alias("f")).collect()
    assert [(r.t, r.f) for r in rows] == [("***", "***"), ("***", "**"), ("**", "*"), ("*", ""), ("", ""), ("", ""), ("", "")]


def test_home_cell(spark):
    at = datetime(2019, 1, 10, 5)  # 21:00 the evening before in Los Angeles
    rows = [(1, at, "7"), (1, at, "7.0"), (1, at, "8"), (1, at, "bad"), (1, datetime(2019, 1, 10, 20), "8"), (1, at, "99"),
            (2, at, "8"), (2, at, "7"), (3, datetime(2019, 7, 10, 12, 59), "7"), (3, datetime(2019, 7, 10, 13, 0), "8"), (4, at, None)]
    calls = spark.createDataFrame(rows, "a_id long, ts timestamp_ntz, cell_raw string")
    cell_map = spark.createDataFrame([(7, 70), (8, 80)], "raw_cell long, cell_id long")
    homes = mobility.home_cell(mobility.night_visits(calls, cell_map))
    got = {r.user_id: (r.home_cell, r.n_night_events) for r in homes.collect()}
    assert got == {1: (70, 2), 2: (70, 1), 3: (70, 1)}
    assert [(r.threshold_events, r.n_homes) for r in mobility.homes_by_threshold(homes, [1, 2, 9]).collect()] == [(1, 3), (2, 1), (9, 0)]
    area = spark.createDataFrame([(80, "A")], "cell_id long, area_id string")
    assert mobility.home_area(homes, area, 1).count() == 0
    rate = mobility.unmapped_rate(homes, area, 1).first()
    assert (rate.n_homes, rate.unmapped_rate) == (3, 1.0)
    counts = Observation()
    assert len(mobility.home_area(homes, area.unionByName(area.selectExpr("70L AS cell_id", "'B' AS area_id")), 2, counts).collect()) == 1
    assert counts.get == {"n_homes": 1, "n_unmapped": 0}
    counts = Observation()
    assert mobility.home_area(homes, area, 1, counts).collect() == [] and counts.get == {"n_homes": 3, "n_unmapped": 3}
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    assert {r.user_id: r.n_places for r in mobility.unique_places(calls, cell_map, users).collect()} == {1: 2, 2: 2}


def test_location_rank_dense(spark):
    rows = [("p", "a")] * 3 + [("p", "b")] * 3 + [("p", "c")] + [("q", "a")] * 2
    got = {r.x: r.y for r in mobility.location_rank(spark.createDataFrame(rows, "pid string, place_id string")).collect()}
    assert got == {1.0: pytest.approx((3 / 7 + 3 / 7 + 1) / 3), 2.0: pytest.approx(1 / 7)}


def test_spans_and_quality(spark):
    rows = [("p", datetime(2024, 1, 1), datetime(2024, 1, 1, 1)), ("p", datetime(2024, 1, 2), datetime(2024, 1, 3, 11))]
    spans = mobility.user_spans(spark.createDataFrame(rows, "pid string, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    r = spans.first()
    assert (r.num_stays, r.duration_days) == (2, 2)
    assert mobility.quality_users(spans, (2, 2), (2, 3)).count() == 1 and mobility.quality_users(spans).count() == 0
    m = density.span_matrix(mobility.activity_levels(spans), "duration_days", "num_stays", "count", [2, 3]).first()
    assert m.s2 == pytest.approx(0.30103, abs=1e-5) and m.s3 == 0.0


def test_expansion_factor(spark):
    users = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "user_id long, area_id string")
    pop = spark.createDataFrame([("A", 100), ("C", 5)], "area_id string, population long")
    assert [(r.area_id, r.expansion_factor) for r in mobility.expansion_factor(users, pop).collect()] == [("A", 50.0)]


def test_income_split_is_person_weighted(spark):
    cohort = spark.createDataFrame([(1, "S", "a"), (2, "S", "a"), (3, "S", "a"), (4, "S", "b"), (5, "S", "n")],
                                   "pid long, disaster string, home_area string")
    intensity = spark.createDataFrame([("S", "a", "hi"), ("S", "a", "hi")], "disaster string, home_area string, int_bin string")
    income = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "home_area string, median_income double")
    got = {r.pid: (r.int_bin, r.income_group) for r in mobility.enrich_cohort(cohort, intensity, income).collect()}
    assert got == {1: ("hi", "High"), 2: ("hi", "High"), 3: ("hi", "High"), 4: (None, "High"), 5: (None, None)}


def test_smoothing_shortens_at_the_ends(spark):
    panel = spark.createDataFrame([("S", t, "b", "High", float(v), 1) for t, v in ((0, 3), (1, 6), (2, 9))],
                                  "disaster string, t int, int_bin string, income_group string, mean_rog double, n int")
    assert [r.mean_rog for r in mobility.smooth_panel(panel).orderBy("t").collect()] == [4.5, 6.0, 7.5]


def test_random_pairs_follow_cell_sizes(spark):
    # one cell holds most users; slots cut its range so no single key carries it
    users = spark.createDataFrame([(i, 5 if i < 80 else 300 + i) for i in range(100)], "user_id long, home_cell long")
    got = ties.random_pairs(spark, users, 20000, 7, slots=16).toPandas()
    n = got["n"].sum()
    assert 19600 < n < 20000  # about one in a hundred is a self pair
    both = got[(got.cell_a == 5) & (got.cell_b == 5)]["n"].sum() / n
    assert both == pytest.approx(80 * 79 / (100 * 99), abs=0.02)
    lone = got[(got.cell_a == got.cell_b) & (got.cell_a != 5)]
    assert lone.empty
    again = ties.random_pairs(spark, users, 20000, 7, slots=16).toPandas()
    assert got.sort_values(["cell_a", "cell_b"]).reset_index(drop=True).equals(
        again.sort_values(["cell_a", "cell_b"]).reset_index(drop=True))


def test_haversine(spark):
    row = spark.sql("select 1").select(C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
                                       C.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero")).first()
    assert row.half == pytest.approx(6371 * 3.141592653589793) and row.zero == 0.0
