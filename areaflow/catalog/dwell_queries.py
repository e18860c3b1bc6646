"""Dwell, evacuation, radius-of-gyration and displacement queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.catalog.views import (EVENTS, SQL, THRESHOLDS, R, S, area_xy, place_area, published, query, stays)
from areaflow.operators import dwell

MIN_PLACE = 10


def coarse_places(s: S) -> DataFrame:
    return dwell.evacuation_places(stays(s), EVENTS, place_area(s), THRESHOLDS, 4, MIN_PLACE)


def fine_places(s: S) -> DataFrame:
    return dwell.evacuation_places(stays(s), EVENTS, place_area(s, "fine"), THRESHOLDS, 4, MIN_PLACE)


for lvl in ("coarse", "fine"):
    SQL[f"ep_{lvl}_areas"] = f"""
    SELECT d.disaster, d.pid, d.week, d.week < d.event_week AS is_pre, p.area_id, sum(d.mins) AS mins
    FROM (SELECT e.disaster, e.event_week, n.pid, n.week, n.place_id, sum(n.mins) AS mins
          FROM nights n JOIN ev e ON n.week BETWEEN e.event_week - 28 AND e.event_week
          GROUP BY 1, 2, 3, 4, 5 HAVING sum(n.mins) >= {MIN_PLACE}) d
    JOIN pa_{lvl} p ON p.place_id = d.place_id
    GROUP BY 1, 2, 3, 4, 5 HAVING sum(d.mins) >= {min(THRESHOLDS)}"""
    SQL[f"ep_{lvl}_top"] = f"""
    SELECT * FROM (SELECT a.*, t.thr AS threshold_minutes,
                          row_number() OVER (PARTITION BY disaster, thr, pid, week ORDER BY mins DESC, area_id) AS rn
                   FROM ep_{lvl}_areas a JOIN (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS thr) t ON a.mins >= t.thr)
    WHERE rn = 1"""
    SQL[f"ep_{lvl}"] = f"""
    SELECT disaster, threshold_minutes, pid, max(CASE WHEN is_pre THEN area_id END) AS pre_area,
           max(CASE WHEN NOT is_pre THEN area_id END) AS crisis_area
    FROM (SELECT *, row_number() OVER (PARTITION BY disaster, threshold_minutes, pid, is_pre ORDER BY m DESC, area_id) AS rk
          FROM (SELECT disaster, threshold_minutes, pid, is_pre, area_id, sum(mins) AS m FROM ep_{lvl}_top GROUP BY 1, 2, 3, 4, 5))
    WHERE rk = 1 GROUP BY 1, 2, 3"""


@query("night_dwell_week", f"SELECT pid, CAST(week AS VARCHAR) AS period, place_id, {R('sum(mins)')} AS mins FROM nights GROUP BY 1, 2, 3")
def night_dwell_week(s: S):
    return published(dwell.night_dwell(stays(s), "week"))


@query("night_dwell_night", f"SELECT pid, CAST(night_date AS VARCHAR) AS period, place_id, {R('sum(mins)')} AS mins FROM nights GROUP BY 1, 2, 3")
def night_dwell_night(s: S):
    return published(dwell.night_dwell(stays(s), "night"))


@query("dominant_area", f"""
SELECT pid, CAST(period AS VARCHAR) AS period, area_id, {R('mins')} AS mins FROM (
  SELECT *, row_number() OVER (PARTITION BY pid, period ORDER BY mins DESC, area_id) AS rn
  FROM (SELECT n.pid, n.night_date AS period, p.area_id, sum(n.mins) AS mins
        FROM nights n JOIN pa_fine p ON n.place_id = p.place_id GROUP BY 1, 2, 3)) WHERE rn = 1""")
def dominant_area(s: S):
    d = dwell.to_areas(dwell.night_dwell(stays(s), "night"), place_area(s, "fine"), ["pid", "period"])
    return published(dwell.dominant_area(d, ["pid", "period"]))


@query("evac_status", """
SELECT disaster, CAST(threshold_minutes AS INTEGER) AS threshold_minutes, pid, pre_area, crisis_area,
       CAST(coalesce(crisis_area <> pre_area, FALSE) AS BIGINT) AS evacuated
FROM ep_coarse WHERE pre_area IS NOT NULL""")
def evac_status(s: S):
    return dwell.evacuation_status(coarse_places(s))


_LISTED = (*THRESHOLDS, 99_999)  # the last is reached by nobody
_SUMMARY = """
SELECT l.disaster AS disaster, CAST(l.threshold_minutes AS INTEGER) AS threshold_minutes, count(pre_area) AS n_users_with_pre_home,
       count(crisis_area) AS n_users_with_disaster_week_location,
       CAST(coalesce(sum(CASE WHEN pre_area IS NOT NULL AND crisis_area <> pre_area THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_evacuated,
       {rate} AS evacuation_rate
FROM (SELECT * FROM (VALUES """ + ", ".join(f"('{e.label}')" for e in EVENTS) + """) e(disaster),
      (VALUES """ + ", ".join(f"({t})" for t in _LISTED) + """) t(threshold_minutes)) l
LEFT JOIN {src} p ON p.disaster = l.disaster AND p.threshold_minutes = l.threshold_minutes GROUP BY 1, 2"""
_RATE = R("sum(CASE WHEN pre_area IS NOT NULL AND crisis_area <> pre_area THEN 1.0 ELSE 0.0 END) / nullif(count(pre_area), 0)")


@query("evac_summary", _SUMMARY.format(rate=_RATE, src="ep_coarse"))
def evac_summary(s: S):
    return published(dwell.evacuation_summary(coarse_places(s), EVENTS, _LISTED))


@query("evac_summary_fine", _SUMMARY.format(rate=_RATE, src="ep_fine"))
def evac_summary_fine(s: S):
    return published(dwell.evacuation_summary(fine_places(s), EVENTS, _LISTED))


SQL["cohort60"] = """
SELECT p.pid, p.disaster, p.threshold_minutes, p.pre_area AS home_area, p.crisis_area AS dest_area,
       CAST(coalesce(p.crisis_area <> p.pre_area, FALSE) AS BIGINT) AS evacuated,
       sqrt((d.x - o.x) * (d.x - o.x) + (d.y - o.y) * (d.y - o.y)) / 1000.0 AS distance_km
FROM ep_fine p LEFT JOIN xy_fine o ON o.area_id = p.pre_area LEFT JOIN xy_fine d ON d.area_id = p.crisis_area
WHERE p.pre_area IS NOT NULL AND p.threshold_minutes = 60"""


def cohort60(s: S) -> DataFrame:
    return dwell.cohort(fine_places(s), area_xy(s, "fine"), 60)


@query("cohort", f"""
SELECT pid, disaster, CAST(threshold_minutes AS INTEGER) AS threshold_minutes, home_area, dest_area, evacuated,
       {R('distance_km')} AS distance_km FROM cohort60""")
def cohort(s: S):
    return published(cohort60(s))


SQL["rg"] = f"""
SELECT disaster, pid, datediff('day', event_day, stay_date) AS t,
       sqrt(sum(w * ((x - cx) * (x - cx) + (y - cy) * (y - cy)))) / 1000.0 AS rg_km
FROM (SELECT *, sum(w * x) OVER (PARTITION BY disaster, pid, stay_date) AS cx,
             sum(w * y) OVER (PARTITION BY disaster, pid, stay_date) AS cy
      FROM (SELECT *, mins / sum(mins) OVER (PARTITION BY disaster, pid, stay_date) AS w
            FROM (SELECT d.disaster, d.event_day, d.pid, d.stay_date, a.area_id, x.x, x.y, sum(d.mins) AS mins
                  FROM (SELECT e.disaster, e.event_day, s.pid, CAST(s.local_time AS DATE) AS stay_date, s.place_id,
                               sum(s.stay_us / 60000000.0::DOUBLE) AS mins
                        FROM stays s JOIN ev e ON CAST(s.local_time AS DATE) BETWEEN e.event_day - 7 AND e.event_day + 7
                        WHERE s.stay_us > 0 AND s.place_id IS NOT NULL
                        GROUP BY 1, 2, 3, 4, 5 HAVING sum(s.stay_us / 60000000.0::DOUBLE) >= {MIN_PLACE}) d
                  JOIN pa_fine a ON a.place_id = d.place_id JOIN xy_fine x ON x.area_id = a.area_id
                  GROUP BY 1, 2, 3, 4, 5, 6, 7)))
GROUP BY 1, 2, event_day, stay_date"""


def daily_rg(s: S) -> DataFrame:
    return dwell.radius_of_gyration(stays(s), EVENTS, place_area(s, "fine"), area_xy(s, "fine"),
                                    min_place_minutes=MIN_PLACE)


@query("radius_of_gyration", f"SELECT disaster, pid, t, {R('rg_km')} AS rg_km FROM rg")
def radius_of_gyration(s: S):
    return published(daily_rg(s))


# --- displacement curve: surveyed areas are nations, damaged when they have many customers -------

def coverage(s: S) -> DataFrame:
    n = s.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_total"),
                                                                       F.sum(F.when(F.col("c_acctbal") < -900, 1).otherwise(0)).alias("n_damaged"))
    return n.select(F.explode(F.array(*[F.lit(e.label) for e in EVENTS])).alias("event"),
                    F.lpad(F.col("k").cast("string"), 5, "0").alias("area_id"), "n_total",
                    F.col("n_damaged").cast("long").alias("n_damaged"))


SQL["coverage"] = """
SELECT e.disaster AS event, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS area_id, count(*) AS n_total,
       CAST(sum(CASE WHEN c_acctbal < -900 THEN 1 ELSE 0 END) AS BIGINT) AS n_damaged
FROM customer CROSS JOIN ev e GROUP BY 1, 2"""


@query("damage_groups", """
SELECT event AS disaster, area_id AS home_area, CASE WHEN n_damaged > 0 THEN 'Damaged' ELSE 'Undamaged' END AS damage_grp
FROM coverage""")
def damage_groups(s: S):
    return dwell.damage_group(coverage(s))


SQL["positions"] = f"""
WITH nightly AS (
  SELECT e.disaster, e.event_day, n.pid, n.night_date, n.place_id, sum(n.mins) AS mins
  FROM (SELECT *, CAST(local_time AS DATE) AS d, stay_us / 60000000.0::DOUBLE AS mins,
               CASE WHEN hour_of_day < 7 THEN CAST(local_time AS DATE) - 1 ELSE CAST(local_time AS DATE) END AS night_date
        FROM stays WHERE stay_us > 0 AND place_id IS NOT NULL AND (hour_of_day >= 20 OR hour_of_day < 7)) n
  JOIN ev e ON n.d BETWEEN e.event_day - 40 AND e.event_day + 15
  GROUP BY 1, 2, 3, 4, 5 HAVING sum(n.mins) >= {MIN_PLACE}),
dom AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disaster, pid, night_date ORDER BY mins DESC, area_id) AS rn
    FROM (SELECT m.disaster, m.event_day, m.pid, m.night_date, a.area_id, sum(m.mins) AS mins
          FROM nightly m JOIN pa_fine a ON a.place_id = m.place_id GROUP BY 1, 2, 3, 4, 5)) WHERE rn = 1),
home AS (
  SELECT disaster, pid, area_id AS home_area FROM (
    SELECT *, row_number() OVER (PARTITION BY disaster, pid ORDER BY m DESC, area_id) AS rk
    FROM (SELECT disaster, pid, area_id, sum(mins) AS m FROM dom WHERE night_date < event_day - 10 GROUP BY 1, 2, 3))
  WHERE rk = 1)
SELECT d.disaster, d.pid, d.night_date, datediff('day', d.event_day, d.night_date) AS rel_day, d.area_id, h.home_area
FROM dom d JOIN home h ON h.disaster = d.disaster AND h.pid = d.pid
WHERE datediff('day', d.event_day, d.night_date) BETWEEN -10 AND 15"""


def positions(s: S) -> DataFrame:
    return dwell.nightly_positions(stays(s), EVENTS, place_area(s, "fine"), min_place_minutes=MIN_PLACE)


@query("nightly_positions", "SELECT * REPLACE (CAST(night_date AS VARCHAR) AS night_date) FROM positions")
def nightly_positions(s: S):
    return published(positions(s))


SQL["curve"] = """
SELECT disaster, damage_grp, rel_day, p, n,
       greatest(0.0, least(1.0, p - 1.96 * sqrt(greatest(p * (1 - p) / greatest(n, 1), 0.0)))) AS lo,
       greatest(0.0, least(1.0, p + 1.96 * sqrt(greatest(p * (1 - p) / greatest(n, 1), 0.0)))) AS hi
FROM (SELECT q.disaster, g.damage_grp, q.rel_day, avg(CAST(q.ever AS DOUBLE)) AS p, count(*) AS n
      FROM (SELECT *, max(CASE WHEN area_id <> home_area THEN 1 ELSE 0 END)
                        OVER (PARTITION BY disaster, pid ORDER BY rel_day ROWS UNBOUNDED PRECEDING) AS ever FROM positions) q
      JOIN (SELECT event, area_id, CASE WHEN n_damaged > 0 THEN 'Damaged' ELSE 'Undamaged' END AS damage_grp FROM coverage) g
        ON g.event = q.disaster AND g.area_id = q.home_area
      GROUP BY 1, 2, 3)"""


def curve(s: S) -> DataFrame:
    return dwell.displacement_curve(positions(s), dwell.damage_group(coverage(s)))


@query("displacement_curve", f"SELECT disaster, damage_grp, rel_day, {R('p')} AS p, n, {R('lo')} AS lo, {R('hi')} AS hi FROM curve")
def displacement_curve(s: S):
    return published(curve(s))


@query("rebased_curve", f"""
SELECT c.disaster, c.damage_grp, c.rel_day, c.n, {R('greatest(c.p - b.p, 0.0)')} AS p,
       {R('greatest(c.lo - b.p, 0.0)')} AS lo, {R('greatest(c.hi - b.p, 0.0)')} AS hi
FROM curve c LEFT JOIN (SELECT disaster, damage_grp, p FROM curve WHERE rel_day = -10) b
  ON b.disaster = c.disaster AND b.damage_grp = c.damage_grp""")
def rebased_curve(s: S):
    return published(dwell.rebase_curve(curve(s)))
