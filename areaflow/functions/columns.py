"""Column-level building blocks: codes, time, pairs, distances, labels.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen and simple predicates still reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere radii in kilometres (great circle) and metres (Web Mercator).
EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- codes -----------------------------------------------------------------

def zero_pad(c: str | Column, width: int) -> Column:
    """Left-pad with zeros up to ``width``; longer text is kept whole, a sign stays in front."""
    s = as_col(c)
    signed = F.substring(s, 1, 1).isin("-", "+")
    padded = F.when(
        signed, F.concat(F.substring(s, 1, 1), F.lpad(F.substring(s, 2, 1 << 30), width - 1, "0"))
    ).otherwise(F.lpad(s, width, "0"))
    return F.when(F.length(s) < width, padded).otherwise(s)


def norm_area_code(c: str | Column, width: int = 5) -> Column:
    """Text form of an area code: trailing ``.0`` dropped, trimmed, zero-padded. Null stays null."""
    text = F.regexp_replace(as_col(c).cast("string"), r"\.0$", "")
    return zero_pad(F.regexp_replace(text, r"^\s+|\s+$", ""), width)


def norm_geoid(c: str | Column, width: int = 11) -> Column:
    """Digits only, zero-padded."""
    return zero_pad(F.regexp_replace(as_col(c).cast("string"), "[^0-9]", ""), width)


def geoid_of(state: str | Column, county: str | Column, tract: str | Column) -> Column:
    return F.concat(as_col(state), as_col(county), as_col(tract))


def tolerant(c: str | Column, to: str = "double") -> Column:
    """Cast that yields null for anything unparsable."""
    return as_col(c).cast("string").try_cast(to)


def finite_or_null(c: str | Column) -> Column:
    """NaN and both infinities become null, so that null is the only missing value."""
    x = as_col(c)
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(~bad, x)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields null on a zero denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


# --- time ------------------------------------------------------------------

def to_local(ts_utc: str | Column, tz: str = "America/Los_Angeles") -> Column:
    """UTC instant to local wall time (no zone), whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), as_col(ts_utc).cast("timestamp_ntz"))


def is_night(hour: str | Column, start: int = 20, end: int = 7) -> Column:
    h = as_col(hour)
    return (h >= start) | (h < end)


def night_anchor(ts: str | Column, hour: str | Column, end: int = 7) -> Column:
    """Date of the evening a night row belongs to."""
    d = F.to_date(as_col(ts))
    return F.when(as_col(hour) < end, F.date_sub(d, 1)).otherwise(d)


def week_start(d: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", as_col(d)))


def relative_day(d: str | Column, event: str | Column) -> Column:
    return F.datediff(as_col(d), as_col(event))


def monday_of(d: date) -> date:
    return d - timedelta(days=d.weekday())


def event_windows(event: date, pre_weeks: int = 4, post_weeks: int = 8) -> dict[str, date]:
    """Boundaries of the weeks before, of and after an event (half-open, Mondays)."""
    week = monday_of(event)
    return {
        "pre_start": week - timedelta(weeks=pre_weeks),
        "week_start": week,
        "post_start": week + timedelta(weeks=1),
        "post_end": week + timedelta(weeks=1 + post_weeks),
    }


def between_dates(ts: str | Column, lo: date, hi: date) -> Column:
    """Inclusive date window as a plain range on the raw timestamp (prunes row groups)."""
    t = as_col(ts)
    lower = F.lit(f"{lo} 00:00:00").cast("timestamp_ntz")
    upper = F.lit(f"{hi + timedelta(days=1)} 00:00:00").cast("timestamp_ntz")
    return (t >= lower) & (t < upper)


def date_spine(df: DataFrame, day: str, before: int = 0, after: int = 0) -> DataFrame:
    """Every day ``day`` from the first in ``df`` to the last, with so many days around; no rows for an empty table."""
    ends = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).filter("_a IS NOT NULL")
    return ends.select(F.explode(F.sequence(F.date_sub("_a", before), F.date_add("_b", after))).alias(day))


# --- pairs, thresholds, labels ----------------------------------------------

def displaced_beyond(evacuated: str | Column, distance_km: str | Column, km: float) -> Column:
    """1.0 when displaced farther than ``km``; an unknown distance counts as 0."""
    hit = (as_col(evacuated) == 1) & (as_col(distance_km) > float(km))
    return F.coalesce(hit, F.lit(False)).cast("double")


def thresholds_met(x: str | Column, thresholds: Sequence[float]) -> Column:
    """Array of the thresholds a value reaches; explode it to sweep all of them in one job."""
    levels = F.array(*[F.lit(t) for t in thresholds])
    return F.filter(levels, lambda t: as_col(x) >= t)


def category_rank(c: str | Column, order: Sequence[str], unknown: int = 99) -> Column:
    out = F.lit(unknown)
    for i, label in reversed(list(enumerate(order))):
        out = F.when(as_col(c) == label, F.lit(i)).otherwise(out)
    return out


# P-value cut-offs of the two star notations in use.
TABLE_CUTS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))
FOREST_CUTS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def stars(p: str | Column, cuts: Sequence[tuple[float, str]] = TABLE_CUTS) -> Column:
    pv = finite_or_null(p)
    out = F.lit("")
    for cut, mark in reversed(tuple(cuts)):
        out = F.when(pv < cut, F.lit(mark)).otherwise(out)
    return out


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null."""
    x = as_col(c)
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return F.when(x.isNotNull(), out)


# --- distances ---------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    la1, lo1, la2, lo2 = (as_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(la2 - la1) / 2)
    half_lon = F.sin(F.radians(lo2 - lo1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def mercator_x(lon: str | Column) -> Column:
    return F.radians(as_col(lon)) * F.lit(MERCATOR_RADIUS_M)


def mercator_y(lat: str | Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(as_col(lat)) / 2))


def planar_km(x1, y1, x2, y2) -> Column:
    """Straight-line distance between two Web-Mercator points, in kilometres."""
    dx = as_col(x2) - as_col(x1)
    dy = as_col(y2) - as_col(y1)
    return F.sqrt(dx * dx + dy * dy) / 1000.0
