"""Stay-point operators: dwell time, dominant areas, displacement status and curves.

Input ``stays``: ``pid``, ``place_id``, ``local_time`` (wall time, no zone), ``hour_of_day``,
``stay_us`` (microseconds) and, with several panels, ``panel``.
``place_area``: ``place_id``, ``area_id`` (one row per mapped place).

All events are handled in one job. The only wide stages over raw rows are partial
aggregations; a person then has at most one row per period and area, so the later steps
are partitioned by person once and share that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.columns import (between_dates, clip, event_windows, is_night, night_anchor,
                                        planar_km, relative_day, thresholds_met, week_start)
from areaflow.functions.frames import complete, top_one

# Defaults of the evacuation and displacement definitions.
EVAC_THRESHOLDS_MIN = (240, 480, 720, 960, 1200, 1440, 1680, 1920)
MAIN_THRESHOLD_MIN = 480
MIN_PLACE_MINUTES = 60
US_PER_MINUTE = 60_000_000


@dataclass(frozen=True)
class Event:
    """One dated event; ``panel`` limits it to the stays of one panel."""

    label: str
    day: date
    panel: str | None = None


def valid_stays(stays: DataFrame) -> DataFrame:
    return stays.filter((F.col("stay_us") > 0) & F.col("place_id").isNotNull())


def scan_ranges(events: Sequence[Event], lo: dict[str, date], hi: dict[str, date]) -> Column:
    """Rows that any event's window (inclusive local dates) needs, as ranges on the raw timestamp and the panel.

    Windows of one panel that overlap or follow each other become one range. The ranges are joined by OR, which
    reaches Parquet's row groups: what lies between events far apart is not read.
    """
    spans: dict[str | None, list[tuple[date, date]]] = {}
    for e in sorted(events, key=lambda e: lo[e.label]):
        known = spans.setdefault(e.panel, [])
        start, end = lo[e.label], hi[e.label]
        if known and start <= known[-1][1] + timedelta(days=1):
            known[-1] = known[-1][0], max(known[-1][1], end)
        else:
            known.append((start, end))
    out = F.lit(False)
    for k, (panel, span) in enumerate((p, s) for p, ranges in spans.items() for s in ranges):
        inside = between_dates("local_time", *span)
        if panel is not None:
            inside = inside & (F.col("panel") == panel)
        out = inside if k == 0 else out | inside
    return out


def _tag_events(stays: DataFrame, events: Sequence[Event], lo: dict[str, date], hi: dict[str, date],
                columns: Sequence[Column]) -> DataFrame:
    """One copy of a row for every event whose window (inclusive local dates) holds it.

    The events are a short literal list, so this is row-local; :func:`scan_ranges` keeps all else from being read.
    """
    hits = []
    for e in events:
        inside = between_dates("local_time", lo[e.label], hi[e.label])
        if e.panel is not None:
            inside = inside & (F.col("panel") == e.panel)
        tag = F.struct(F.lit(e.label).alias("disaster"), F.lit(e.day).alias("event_day"))
        hits.append(F.when(inside, tag))
    return (
        stays.filter(scan_ranges(events, lo, hi))
        .withColumn("_e", F.explode(F.array_compact(F.array(*hits))))
        .select(F.col("_e.disaster").alias("disaster"), F.col("_e.event_day").alias("event_day"), *columns)
    )


def night_rows(stays: DataFrame, start: int = 20, end: int = 7) -> DataFrame:
    """Valid night rows with the date of the evening they belong to."""
    return (
        valid_stays(stays).filter(is_night("hour_of_day", start, end))
        .withColumn("night_date", night_anchor("local_time", "hour_of_day", end))
        .withColumn("mins", F.col("stay_us").cast("double") / US_PER_MINUTE)
    )


def night_dwell(stays: DataFrame, period: str = "week", start: int = 20, end: int = 7) -> DataFrame:
    """Night minutes per person, period (``week`` or ``night``) and place."""
    rows = night_rows(stays, start, end)
    key = week_start("night_date") if period == "week" else F.col("night_date")
    return rows.groupBy("pid", key.alias("period"), "place_id").agg(F.sum("mins").alias("mins"))


def dominant_area(dwell: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area with most minutes per key; ties go to the smaller area id."""
    return top_one(dwell, keys, [F.desc("mins"), F.asc("area_id")])


def to_areas(dwell: DataFrame, place_area: DataFrame, keys: Sequence[str],
             extra: Sequence[str] = ()) -> DataFrame:
    """Place minutes to area minutes, then partitioned by person for everything that follows.

    The sum comes first: it spreads a hot person over many tasks, and afterwards a person has at
    most one row per key and area.
    """
    return (
        dwell.join(place_area, "place_id", "inner").filter(F.col("area_id").isNotNull())
        .groupBy(*keys, "area_id", *extra).agg(F.sum("mins").alias("mins"))
        .repartition("pid")
    )


# --- evacuation status ------------------------------------------------------

def evacuation_places(stays: DataFrame, events: Sequence[Event], place_area: DataFrame,
                      thresholds: Sequence[int] = EVAC_THRESHOLDS_MIN, pre_weeks: int = 4,
                      min_place_minutes: float = MIN_PLACE_MINUTES) -> DataFrame:
    """Usual area before and dominant area in the event week, per person and threshold.

    Rows exist for everyone seen in either window; ``pre_area`` or ``crisis_area`` may be null.
    Weeks after the event week take no part in the result, so they are not scanned.
    """
    win = {e.label: event_windows(e.day, pre_weeks) for e in events}
    lo = {k: w["pre_start"] for k, w in win.items()}
    hi = {k: w["post_start"] for k, w in win.items()}  # holds the last night's early hours
    event_week = week_start("event_day")
    tagged = _tag_events(
        night_rows(stays), events, lo, hi,
        [F.col("pid"), F.col("place_id"), week_start("night_date").alias("week"), F.col("mins")],
    ).withColumn("event_week", event_week).filter(
        F.col("week").between(F.date_sub("event_week", 7 * pre_weeks), F.col("event_week")))
    keys = ["disaster", "pid", "week"]
    weekly = (
        tagged.groupBy(*keys, (F.col("week") < F.col("event_week")).alias("is_pre"), "place_id")
        .agg(F.sum("mins").alias("mins")).filter(F.col("mins") >= min_place_minutes)
    )
    areas = to_areas(weekly, place_area, [*keys, "is_pre"]).filter(F.col("mins") >= min(thresholds))
    swept = areas.withColumn("threshold_minutes", F.explode(thresholds_met("mins", thresholds)))
    who = ["disaster", "threshold_minutes", "pid"]
    top_weeks = dominant_area(swept, [*who, "week"])
    places = dominant_area(
        top_weeks.groupBy(*who, "is_pre", "area_id").agg(F.sum("mins").alias("mins")),
        [*who, "is_pre"])
    return places.groupBy(*who).agg(
        F.max(F.when(F.col("is_pre"), F.col("area_id"))).alias("pre_area"),
        F.max(F.when(~F.col("is_pre"), F.col("area_id"))).alias("crisis_area"),
    )


def moved() -> Column:
    return F.coalesce(F.col("crisis_area") != F.col("pre_area"), F.lit(False)).cast("long")


def evacuation_status(places: DataFrame) -> DataFrame:
    """Everyone with a usual area; people not observed in the event week count as not moved."""
    return places.filter(F.col("pre_area").isNotNull()).withColumn("evacuated", moved())


def evacuation_summary(places: DataFrame, events: Sequence[Event], thresholds: Sequence[int]) -> DataFrame:
    """Counts and rate per event and threshold; zeros and no rate where nobody reaches a threshold."""
    moved_n = F.sum(F.when(F.col("pre_area").isNotNull(), moved()).otherwise(0))
    counts = places.groupBy("disaster", "threshold_minutes").agg(
        F.count("pre_area").alias("n_users_with_pre_home"),
        F.count("crisis_area").alias("n_users_with_disaster_week_location"),
        moved_n.cast("long").alias("n_evacuated"),
    )
    listed = places.sparkSession.createDataFrame(
        [(e.label, int(t)) for e in events for t in thresholds], "disaster string, threshold_minutes int")
    names = ["n_users_with_pre_home", "n_users_with_disaster_week_location", "n_evacuated"]
    return complete(counts, listed, ["disaster", "threshold_minutes"], dict.fromkeys(names, 0)).withColumn("evacuation_rate", F.try_divide(
        F.col("n_evacuated").cast("double"), F.col("n_users_with_pre_home").cast("double")))


def cohort(places: DataFrame, area_xy: DataFrame, threshold: int = MAIN_THRESHOLD_MIN) -> DataFrame:
    """Per-person record at one threshold, with the distance between the two areas.

    ``area_xy``: ``area_id``, ``x``, ``y`` in planar metres. Distance is null without both ends.
    """
    status = evacuation_status(places.filter(F.col("threshold_minutes") == threshold))
    o = area_xy.select(F.col("area_id").alias("pre_area"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    d = area_xy.select(F.col("area_id").alias("crisis_area"), F.col("x").alias("_dx"), F.col("y").alias("_dy"))
    return (
        status.join(o, "pre_area", "left").join(d, "crisis_area", "left")
        .select("pid", "disaster", "threshold_minutes", F.col("pre_area").alias("home_area"),
                F.col("crisis_area").alias("dest_area"), "evacuated",
                planar_km("_ox", "_oy", "_dx", "_dy").alias("distance_km"))
    )


# --- radius of gyration --------------------------------------------------------

def radius_of_gyration(stays: DataFrame, events: Sequence[Event], place_area: DataFrame,
                       area_xy: DataFrame, days: tuple[int, int] = (-7, 7),
                       min_place_minutes: float = MIN_PLACE_MINUTES) -> DataFrame:
    """Daily dwell-weighted RMS distance (km) from the day's centre of mass, per person.

    Coordinates are around 1e7 m, so the centre is taken first and squared offsets are
    summed after it; raw second moments would lose the result to cancellation.
    """
    lo = {e.label: e.day + timedelta(days=days[0]) for e in events}
    hi = {e.label: e.day + timedelta(days=days[1]) for e in events}
    tagged = _tag_events(
        valid_stays(stays), events, lo, hi,
        [F.col("pid"), F.col("place_id"), F.to_date("local_time").alias("stay_date"),
         (F.col("stay_us").cast("double") / US_PER_MINUTE).alias("mins")])
    daily = (
        tagged.groupBy("disaster", "event_day", "pid", "stay_date", "place_id")
        .agg(F.sum("mins").alias("mins")).filter(F.col("mins") >= min_place_minutes)
    )
    located = place_area.join(area_xy, "area_id").filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()).select("place_id", "area_id", "x", "y")
    keys = ["disaster", "event_day", "pid", "stay_date"]
    by_area = to_areas(daily, located, keys, ["x", "y"])
    day = Window.partitionBy(*keys)
    weighted = by_area.withColumn("w", F.col("mins") / F.sum("mins").over(day))
    centred = weighted.withColumn("cx", F.sum(F.col("w") * F.col("x")).over(day)).withColumn(
        "cy", F.sum(F.col("w") * F.col("y")).over(day))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return centred.groupBy(*keys).agg(
        (F.sqrt(F.sum(F.col("w") * (dx * dx + dy * dy))) / 1000.0).alias("rg_km")
    ).select("disaster", "pid", relative_day("stay_date", "event_day").cast("long").alias("t"), "rg_km")


# --- displacement curve -----------------------------------------------------------

def nightly_positions(stays: DataFrame, events: Sequence[Event], place_area: DataFrame,
                      days: tuple[int, int] = (-10, 15), home_days: int = 30,
                      min_place_minutes: float = MIN_PLACE_MINUTES) -> DataFrame:
    """Dominant area per person-night with the person's usual area before the event.

    The usual area has most summed dominant-night minutes before the panel starts. A
    person has at most one row per night, so the windows below stay small.
    """
    lo = {e.label: e.day + timedelta(days=days[0] - home_days) for e in events}
    hi = {e.label: e.day + timedelta(days=days[1]) for e in events}
    tagged = _tag_events(night_rows(stays), events, lo, hi,
                         [F.col("pid"), F.col("place_id"), F.col("night_date"), F.col("mins")])
    nightly = (
        tagged.groupBy("disaster", "event_day", "pid", "night_date", "place_id")
        .agg(F.sum("mins").alias("mins")).filter(F.col("mins") >= min_place_minutes)
    )
    keys = ["disaster", "event_day", "pid", "night_date"]
    top = dominant_area(to_areas(nightly, place_area, keys), keys).withColumn(
        "rel_day", relative_day("night_date", "event_day"))
    person = ["disaster", "event_day", "pid"]
    before = F.sum(F.when(F.col("rel_day") < days[0], F.col("mins"))).over(
        Window.partitionBy(*person, "area_id"))
    usual = Window.partitionBy(*person).orderBy(F.desc_nulls_last("_pre"), F.asc("area_id")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("_pre").isNotNull(), F.col("area_id"))).over(usual)
    return (
        top.withColumn("_pre", before).withColumn("home_area", first)
        .filter(F.col("home_area").isNotNull() & F.col("rel_day").between(*days))
        .select("disaster", "pid", "night_date", F.col("rel_day").cast("long").alias("rel_day"),
                "area_id", "home_area")
    )


def damage_group(coverage: DataFrame) -> DataFrame:
    """Surveyed areas as Damaged or Undamaged. ``coverage``: ``event``, ``area_id``, ``n_damaged``."""
    return coverage.select(
        F.col("event").alias("disaster"), F.col("area_id").alias("home_area"),
        F.when(F.col("n_damaged") > 0, "Damaged").otherwise("Undamaged").alias("damage_grp"))


def displacement_curve(positions: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of people displaced on or before each night, by damage group, with interval.

    ``groups``: ``disaster``, ``home_area``, ``damage_grp``. The base of a night is the people
    seen on that night.
    """
    run = Window.partitionBy("disaster", "pid").orderBy("rel_day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ever = F.max((F.col("area_id") != F.col("home_area")).cast("int")).over(run)
    series = (
        positions.withColumn("ever", ever)
        .join(groups, ["disaster", "home_area"], "inner")
        .groupBy("disaster", "damage_grp", "rel_day")
        .agg(F.avg("ever").alias("p"), F.count("ever").alias("n"))
    )
    return with_binomial_interval(series)


def with_binomial_interval(df: DataFrame, p: str = "p", n: str = "n") -> DataFrame:
    spread = F.greatest(F.col(p) * (1 - F.col(p)) / F.greatest(F.col(n), F.lit(1)), F.lit(0.0))
    half = F.lit(1.96) * F.sqrt(spread)
    return df.withColumn("lo", clip(F.col(p) - half, 0, 1)).withColumn("hi", clip(F.col(p) + half, 0, 1))


def rebase_curve(curve: DataFrame, start: int = -10) -> DataFrame:
    """Curve and interval relative to the group's first day, floored at zero; null without one."""
    base = curve.filter(F.col("rel_day") == start).select("disaster", "damage_grp", F.col("p").alias("_base"))
    out = curve.join(base, ["disaster", "damage_grp"], "left")
    for c in ("p", "lo", "hi"):
        out = out.withColumn(c, clip(F.col(c) - F.col("_base"), 0))
    return out.drop("_base")
