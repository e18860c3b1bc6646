"""Hand-computed dwell, evacuation, gyration and displacement cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from areaflow.functions.columns import event_windows
from areaflow.operators import dwell
from areaflow.operators.dwell import Event

MIN = 60_000_000


def stays_of(spark, rows):
    """rows: pid, place, local time, minutes"""
    df = spark.createDataFrame([(p, pl, t, t.hour, int(m * MIN)) for p, pl, t, m in rows],
                               "pid string, place_id string, local_time timestamp_ntz, hour_of_day int, stay_us long")
    return df


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([("a", "01"), ("b", "02"), ("c", "01"), ("z", None)], "place_id string, area_id string")


EVENT = Event("S", date(2024, 1, 24))


def test_windows():
    w = event_windows(date(2024, 1, 24))
    assert w["week_start"] == date(2024, 1, 22) and w["pre_start"] == date(2023, 12, 25)
    assert w["post_start"] == date(2024, 1, 29) and w["post_end"] == date(2024, 3, 25)


def test_early_hours_belong_to_the_evening_before(spark):
    s = stays_of(spark, [("p", "a", datetime(2024, 1, 22, 6, 59), 60), ("p", "a", datetime(2024, 1, 22, 7, 0), 60),
                         ("p", "a", datetime(2024, 1, 22, 20, 0), 30), ("p", "a", datetime(2024, 1, 23, 1, 0), 30),
                         ("p", None, datetime(2024, 1, 23, 1, 0), 30), ("p", "a", datetime(2024, 1, 23, 1, 0), 0)])
    got = {(str(r.period), r.mins) for r in dwell.night_dwell(s, "night").collect()}
    assert got == {("2024-01-21", 60.0), ("2024-01-22", 60.0)}
    week = {(str(r.period), r.mins) for r in dwell.night_dwell(s, "week").collect()}
    assert week == {("2024-01-15", 60.0), ("2024-01-22", 60.0)}


def test_evacuation_status_by_hand(spark, areas):
    night = lambda d, h=22: datetime(2024, 1, d, h)
    s = stays_of(spark, [
        # stays home: area 01 through two places, neither enough alone for 300 minutes
        ("home", "a", night(9), 200), ("home", "c", night(9), 200), ("home", "a", night(23), 300),
        # moves to area 02 in the event week, whose last night ends on the next Monday morning
        ("moved", "a", night(10), 400), ("moved", "b", datetime(2024, 1, 29, 6), 500),
        # not seen in the event week: in the base, not evacuated
        ("gone", "b", night(11), 300),
        # only seen in the event week: counted as observed, never in the base
        ("late", "a", night(24), 400),
        # tie between areas in one week goes to the smaller id
        ("tie", "b", night(12), 300), ("tie", "a", night(13), 300), ("tie", "b", night(24), 300),
        # a place below the place minimum never counts; an unmapped place is dropped
        ("small", "a", night(9), 59), ("small", "z", night(9), 900)])
    places = dwell.evacuation_places(s, [EVENT], areas, (240, 480))
    got = {(r.pid, r.threshold_minutes): (r.pre_area, r.crisis_area) for r in places.collect()}
    assert got[("home", 240)] == ("01", "01") and ("home", 480) not in got
    assert got[("moved", 240)] == ("01", "02") and got[("moved", 480)] == (None, "02")
    assert got[("gone", 240)] == ("02", None) and got[("late", 240)] == (None, "01")
    assert got[("tie", 240)] == ("01", "02") and not any(p == "small" for p, _ in got)
    row = {r.threshold_minutes: r for r in dwell.evacuation_summary(places, [EVENT], (240, 480, 9999)).collect()}
    assert (row[240].n_users_with_pre_home, row[240].n_users_with_disaster_week_location, row[240].n_evacuated) == (4, 4, 2)
    assert row[240].evacuation_rate == 0.5
    assert row[480].n_users_with_pre_home == 0 and row[480].evacuation_rate is None
    assert row[9999].n_evacuated == 0 and row[9999].evacuation_rate is None
    xy = spark.createDataFrame([("01", 0.0, 0.0), ("02", 3000.0, 4000.0)], "area_id string, x double, y double")
    c = {r.pid: r.distance_km for r in dwell.cohort(places, xy, 240).collect()}
    assert c == {"home": 0.0, "moved": 5.0, "gone": None, "tie": 5.0}


def test_events_select_their_panel(spark, areas):
    s = stays_of(spark, [("p", "a", datetime(2024, 1, 9, 22), 300)]).withColumn("panel", F.lit("x"))
    events = [Event("S", date(2024, 1, 24), "x"), Event("T", date(2024, 1, 24), "y")]
    got = [r.disaster for r in dwell.evacuation_places(s, events, areas, (240,)).collect()]
    assert got == ["S"]


def test_radius_of_gyration(spark, areas):
    xy = spark.createDataFrame([("01", 1.0e7, 4.0e6), ("02", 1.0e7 + 4000.0, 4.0e6)], "area_id string, x double, y double")
    s = stays_of(spark, [("p", "a", datetime(2024, 1, 24, 10), 60), ("p", "b", datetime(2024, 1, 24, 15), 180),
                         ("q", "a", datetime(2024, 1, 17, 3), 70), ("q", "a", datetime(2024, 1, 16, 3), 70)])
    got = {(r.pid, r.t): r.rg_km for r in dwell.radius_of_gyration(s, [EVENT], areas, xy).collect()}
    # weights 1/4 and 3/4 at distance 4 km: sqrt(3/16) * 4
    assert got[("p", 0)] == pytest.approx(4 * (3 / 16) ** 0.5) and got[("q", -7)] == 0.0 and len(got) == 2


def test_displacement_curve(spark, areas):
    night = lambda d: datetime(2024, 1, d, 22)
    s = stays_of(spark, [("p", "a", night(5), 100), ("p", "a", night(20), 100), ("p", "b", night(22), 100),
                         ("p", "a", night(25), 100), ("q", "a", night(5), 100), ("q", "a", night(25), 100),
                         ("new", "a", night(25), 100)])
    pos = dwell.nightly_positions(s, [EVENT], areas)
    assert {r.pid for r in pos.collect()} == {"p", "q"}
    groups = dwell.damage_group(spark.createDataFrame([("S", "01", 3)], "event string, area_id string, n_damaged int"))
    curve = dwell.displacement_curve(pos, groups)
    got = {r.rel_day: (r.p, r.n) for r in curve.collect()}
    assert got == {-4: (0.0, 1), -2: (1.0, 1), 1: (0.5, 2)}
    rebased = {r.rel_day: r.p for r in dwell.rebase_curve(curve, -4).collect()}
    assert rebased == {-4: 0.0, -2: 1.0, 1: 0.5}
    assert all(r.p is None and r.lo is None for r in dwell.rebase_curve(curve, -10).collect())


def test_only_the_windows_are_read(spark, areas, tmp_path):
    events = [Event("S", date(2020, 8, 26), "x"), Event("T", date(2020, 8, 28), "x"), Event("U", date(2024, 1, 24), "y")]
    s = stays_of(spark, [("p", "a", datetime(2020, 8, 5, 22), 600), ("p", "b", datetime(2020, 8, 26, 22), 600),
                         ("p", "a", datetime(2022, 1, 9, 22), 600), ("q", "a", datetime(2024, 1, 9, 22), 600)])
    s.withColumn("panel", F.when(F.col("pid") == "p", "x").otherwise("y")).write.parquet(f"{tmp_path}/stays")
    read = spark.read.parquet(f"{tmp_path}/stays")
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    places = dwell.evacuation_places(read, events, areas, (240,))
    pushed = [x for x in places._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in x]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [x[x.index("PushedFilters"):] for x in pushed]
    assert pushed and all(x.count("GreaterThanOrEqual(local_time") == 2 and x.count("EqualTo(panel,") == 2 for x in pushed)
    assert {(r.disaster, r.pid) for r in places.collect()} == {("S", "p"), ("T", "p"), ("U", "q")}
