"""Stand-in inputs built from the star-schema tables, as DataFrames and as SQL.

``S`` is the source handle (session and data folder). Every DataFrame view has a SQL
twin in ``SQL``; ``with_views`` prefixes a query with the views it names and theirs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions.columns import mercator_x, mercator_y, zero_pad
from areaflow.functions.frames import rounded
from areaflow.operators.dwell import Event


@dataclass(frozen=True)
class S:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


EVENTS = [Event("Storm A", date(2024, 1, 24)), Event("Storm B", date(2024, 1, 18))]
THRESHOLDS = (30, 60, 90, 120, 180)

SQL: dict[str, str] = {}


def with_views(query: str) -> str:
    """Prefix ``query`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in order and re.search(rf"(?i)\b(?:from|join)\s+{name}\b", text):
                visit(SQL[name])
                if name not in order:
                    order.append(name)

    visit(query)
    return ("WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" if order else "") + query


def R(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def published(df: DataFrame) -> DataFrame:
    """Comparable form of a result: doubles rounded, dates as text."""
    df = rounded(df)
    return df.select(*[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])


def _place(col: str = "props"):
    return F.regexp_extract(col, r"(\d+)", 1).cast("int")


# --- stays ---------------------------------------------------------------------

def stays(s: S) -> DataFrame:
    us = F.round(F.col("value") * 60000000).cast("long")
    ts = F.col("ts").cast("timestamp_ntz")
    return s.table("events").select(
        F.col("user_id").cast("string").alias("pid"),
        _place().cast("string").alias("place_id"),
        ts.alias("local_time"), F.hour(ts).alias("hour_of_day"), us.alias("stay_us"),
        ts.alias("start_ts"), (ts + F.make_dt_interval(secs=us / 1000000)).alias("end_ts"),
    )


SQL["stays"] = """
SELECT CAST(user_id AS VARCHAR) AS pid, regexp_extract(props, '([0-9]+)', 1) AS place_id,
       ts AS local_time, hour(ts) AS hour_of_day, CAST(round(value * 60000000) AS BIGINT) AS stay_us,
       ts AS start_ts, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS end_ts
FROM events"""


def places(s: S) -> DataFrame:
    """Place dimension: every place seen, its centre and its fine and coarse area."""
    p = s.table("events").select(_place().alias("k")).distinct()
    lon, lat = F.lit(-100.0) + F.col("k") % 10 + 0.5, F.lit(25.0) + F.floor(F.col("k") / 10) + 0.5
    return p.select(
        F.col("k").cast("long").alias("k"), F.col("k").cast("string").alias("place_id"),
        lon.alias("lon"), lat.alias("lat"),
        mercator_x(lon).alias("x"), mercator_y(lat).alias("y"),
        zero_pad(F.floor(F.col("k") / 4).cast("string"), 5).alias("fine"),
        zero_pad(F.floor(F.col("k") / 20).cast("string"), 5).alias("coarse"),
    )


SQL["places"] = """
SELECT k, CAST(k AS VARCHAR) AS place_id, lon, lat,
       radians(lon) * 6378137.0 AS x, 6378137.0 * ln(tan(0.7853981633974483 + radians(lat) / 2)) AS y,
       lpad(CAST(k // 4 AS VARCHAR), 5, '0') AS fine, lpad(CAST(k // 20 AS VARCHAR), 5, '0') AS coarse
FROM (SELECT k, -100.0::DOUBLE + k % 10 + 0.5::DOUBLE AS lon, 25.0::DOUBLE + k // 10 + 0.5::DOUBLE AS lat
      FROM (SELECT DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def place_area(s: S, level: str = "coarse") -> DataFrame:
    return places(s).select("place_id", F.col(level).alias("area_id"))


SQL["pa_coarse"] = "SELECT place_id, coarse AS area_id FROM places"
SQL["pa_fine"] = "SELECT place_id, fine AS area_id FROM places"


def area_xy(s: S, level: str = "coarse") -> DataFrame:
    return places(s).groupBy(F.col(level).alias("area_id")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"))


SQL["xy_coarse"] = "SELECT coarse AS area_id, avg(x) AS x, avg(y) AS y FROM places GROUP BY coarse"
SQL["xy_fine"] = "SELECT fine AS area_id, avg(x) AS x, avg(y) AS y FROM places GROUP BY fine"


SQL["ev"] = """
SELECT * FROM (VALUES ('Storm A', DATE '2024-01-24', DATE '2024-01-22'),
                      ('Storm B', DATE '2024-01-18', DATE '2024-01-15')) t(disaster, event_day, event_week)"""

SQL["nights"] = """
SELECT pid, place_id, night_date, CAST(date_trunc('week', night_date) AS DATE) AS week, stay_us / 60000000.0::DOUBLE AS mins
FROM (SELECT *, CASE WHEN hour_of_day < 7 THEN CAST(local_time AS DATE) - 1 ELSE CAST(local_time AS DATE) END AS night_date
      FROM stays WHERE stay_us > 0 AND place_id IS NOT NULL AND (hour_of_day >= 20 OR hour_of_day < 7))"""


# --- registry ---------------------------------------------------------------------

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query function ``f(s: S) -> DataFrame`` with its oracle."""

    def wrap(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(S(spark, str(path).rstrip("/")))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


def oracles() -> dict[str, str]:
    return {k: with_views(v) for k, v in ORACLES.items()}
