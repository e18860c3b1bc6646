"""Home detection, activity and population queries."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from areaflow.catalog.views import SQL, R, S, places, published, query, stays
from areaflow.operators import density, mobility
from areaflow.operators.geo import nearest_area
from areaflow.sources.staging import staged

HOME_SWEEP = (1, 2, 3, 4, 5)

# --- calls and messages: each event links its user to one of the next twelve ids -------------

SQL["contacts"] = """
SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type IN ('click', 'view', 'purchase') AS is_voice,
       CASE WHEN event_id % 2 = 1 THEN other ELSE user_id END AS a_id,
       CASE WHEN event_id % 2 = 1 THEN user_id ELSE other END AS b_id,
       CASE WHEN event_id % 17 = 0 THEN 'bad' WHEN event_id % 5 = 0 THEN k || '.0' ELSE CAST(k AS VARCHAR) END AS cell_raw, k
FROM (SELECT *, user_id + k % 13 AS other FROM
      (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""
SQL["voice"] = "SELECT * FROM contacts WHERE is_voice"
SQL["sms"] = "SELECT * FROM contacts WHERE NOT is_voice"
SQL["cell_map"] = "SELECT k AS raw_cell, (k * 7) % 100 AS cell_id FROM places WHERE k % 25 <> 24"
SQL["cell_area"] = "SELECT k AS cell_id, lpad(CAST(k // 10 AS VARCHAR), 5, '0') AS area_id FROM places WHERE k % 50 <> 49"


def contacts(s: S) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    other, odd = F.col("user_id") + k % 13, F.col("event_id") % 2 == 1
    return s.table("events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.to_date("ts").alias("day"),
        F.col("event_type").isin("click", "view", "purchase").alias("is_voice"),
        F.when(odd, other).otherwise(F.col("user_id")).alias("a_id"),
        F.when(odd, F.col("user_id")).otherwise(other).alias("b_id"),
        F.when(F.col("event_id") % 17 == 0, "bad").when(
            F.col("event_id") % 5 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")).alias("cell_raw"))


def voice(s: S) -> DataFrame:
    return contacts(s).filter("is_voice")


def sms(s: S) -> DataFrame:
    return contacts(s).filter("not is_voice")


def cell_map(s: S) -> DataFrame:
    return places(s).filter("k % 25 <> 24").select(F.col("k").alias("raw_cell"), ((F.col("k") * 7) % 100).alias("cell_id"))


def cell_area(s: S) -> DataFrame:
    return places(s).filter("k % 50 <> 49").select(
        F.col("k").alias("cell_id"), F.lpad(F.floor(F.col("k") / 10).cast("string"), 5, "0").alias("area_id"))


SQL["homes"] = """
SELECT user_id, home_cell, n_night_events FROM (
  SELECT user_id, cell_id AS home_cell, n AS n_night_events, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cell_id) AS rn
  FROM (SELECT v.a_id AS user_id, m.cell_id, count(*) AS n FROM contacts v
        JOIN cell_map m ON m.raw_cell = CAST(TRY_CAST(v.cell_raw AS DOUBLE) AS BIGINT)
        WHERE hour(v.ts - INTERVAL 8 HOUR) >= 20 OR hour(v.ts - INTERVAL 8 HOUR) < 6 GROUP BY 1, 2)) WHERE rn = 1"""


def homes(s: S) -> DataFrame:
    return mobility.home_cell(mobility.night_visits(contacts(s), cell_map(s)))


SQL["users"] = """
SELECT h.user_id, h.home_cell, c.area_id, h.n_night_events FROM homes h JOIN cell_area c ON c.cell_id = h.home_cell
WHERE h.n_night_events >= 2"""


def users(s: S) -> DataFrame:
    return mobility.home_area(homes(s), cell_area(s), 2)


SQL["population"] = "SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS area_id, count(*) AS population FROM customer GROUP BY 1"
SQL["income"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS area_id, CASE WHEN c_nationkey <> 3 THEN avg(c_acctbal) END AS median_income
FROM customer GROUP BY 1, c_nationkey"""


def _nation(c: str):
    return F.lpad(F.col(c).cast("string"), 5, "0")


def population(s: S) -> DataFrame:
    return s.table("customer").groupBy(_nation("c_nationkey").alias("area_id")).agg(F.count("*").alias("population"))


def income(s: S) -> DataFrame:
    return s.table("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).select(
        _nation("c_nationkey").alias("area_id"), F.when(F.col("c_nationkey") != 3, F.col("m")).alias("median_income"))


@query("home_cell", "SELECT * FROM homes")
def home_cell(s: S):
    return homes(s)


@query("home_area", "SELECT * FROM users")
def home_area(s: S):
    return users(s)


@query("home_unmapped_rate", f"""
SELECT count(*) AS n_homes, {R('avg(CASE WHEN c.area_id IS NULL THEN 1.0 ELSE 0.0 END)')} AS unmapped_rate
FROM homes h LEFT JOIN cell_area c ON c.cell_id = h.home_cell WHERE h.n_night_events >= 2""")
def home_unmapped_rate(s: S):
    return published(mobility.unmapped_rate(homes(s), cell_area(s), 2))


@query("home_area_counted", """
SELECT (SELECT count(*) FROM users) AS n_written, count(*) AS n_homes, CAST(sum(CASE WHEN c.area_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmapped
FROM homes h LEFT JOIN cell_area c ON c.cell_id = h.home_cell WHERE h.n_night_events >= 2""")
def home_area_counted(s: S):
    """Homes written once, with the counts taken on the way."""
    counts = Observation()
    written = staged(mobility.home_area(homes(s), cell_area(s), 2, counts), "homes")
    seen = counts.get
    return written.agg(F.count("*").alias("n_written")).select(
        "n_written", *[F.lit(seen[c]).cast("long").alias(c) for c in ("n_homes", "n_unmapped")])


@query("homes_by_threshold", f"""
SELECT CAST(t AS INTEGER) AS threshold_events, CAST(count(h.user_id) AS BIGINT) AS n_homes
FROM (SELECT unnest([{', '.join(map(str, HOME_SWEEP))}]) AS t) LEFT JOIN homes h ON h.n_night_events >= t GROUP BY 1""")
def homes_by_threshold(s: S):
    return mobility.homes_by_threshold(homes(s), HOME_SWEEP)


SQL["visited"] = """
SELECT v.a_id AS user_id, count(DISTINCT m.cell_id) AS n_places FROM contacts v
JOIN cell_map m ON m.raw_cell = CAST(TRY_CAST(v.cell_raw AS DOUBLE) AS BIGINT)
WHERE v.a_id IN (SELECT user_id FROM users) GROUP BY 1"""


def visited(s: S) -> DataFrame:
    return mobility.unique_places(contacts(s), cell_map(s), users(s))


@query("unique_places", "SELECT * FROM visited")
def unique_places(s: S):
    return visited(s)


@query("unique_places_density", f"""
SELECT bin, bin * 2 + 1.0::DOUBLE AS x, coalesce(n, 0) AS n, {R('coalesce(n, 0) / ((SELECT count(*) FROM visited WHERE n_places <= 100) * 2.0::DOUBLE)')} AS density
FROM (SELECT unnest(range(50)) AS bin) LEFT JOIN
  (SELECT CAST(least(n_places // 2, 49) AS BIGINT) AS b, count(*) AS n FROM visited WHERE n_places <= 100 GROUP BY 1) c ON c.b = bin""")
def unique_places_density(s: S):
    return published(density.histogram(visited(s), "n_places", density.linear_edges(0, 100, 50)))


SQL["expansion"] = """
SELECT u.area_id, p.population / u.n AS expansion_factor
FROM (SELECT area_id, CAST(count(*) AS DOUBLE) AS n FROM users GROUP BY 1) u JOIN population p ON p.area_id = u.area_id"""


@query("expansion_factor", f"SELECT area_id, {R('expansion_factor')} AS expansion_factor FROM expansion")
def expansion_factor(s: S):
    return published(mobility.expansion_factor(users(s), population(s)))


SQL["spans"] = """
SELECT pid, count(*) AS num_stays,
       CAST(round((epoch(date_trunc('second', max(end_ts))) - epoch(date_trunc('second', min(start_ts)))) / 86400) AS INTEGER) AS duration_days
FROM stays GROUP BY 1"""


@query("activity_levels", "SELECT duration_days, num_stays, count(*) AS count FROM spans GROUP BY 1, 2")
def activity_levels(s: S):
    return mobility.activity_levels(mobility.user_spans(stays(s)))


@query("quality_users", "SELECT * FROM spans WHERE num_stays BETWEEN 60 AND 80 AND duration_days BETWEEN 28 AND 30")
def quality_users(s: S):
    return mobility.quality_users(mobility.user_spans(stays(s)), (60, 80), (28, 30))


@query("start_hour", f"SELECT CAST(hour_of_day AS DOUBLE) AS x, {R('count(*) / (SELECT count(*) FROM stays)')} AS y FROM stays GROUP BY hour_of_day")
def start_hour(s: S):
    return published(mobility.start_hour_shares(stays(s)))


@query("stay_duration", f"""
SELECT (bin + 0.5::DOUBLE) / 2 AS x, {R('count(*) / sum(count(*)) OVER ()')} AS y
FROM (SELECT CAST(floor(h * 2) AS BIGINT) AS bin FROM (SELECT (epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0::DOUBLE AS h FROM stays)
      WHERE h > 0 AND h <= 24) GROUP BY bin""")
def stay_duration(s: S):
    return published(mobility.stay_duration_shares(stays(s)))


@query("location_rank", f"""
SELECT CAST(rk AS DOUBLE) AS x, {R('avg(f)')} AS y FROM (
  SELECT dense_rank() OVER (PARTITION BY pid ORDER BY v DESC) AS rk, v / sum(v) OVER (PARTITION BY pid) AS f
  FROM (SELECT pid, place_id, count(*) AS v FROM stays GROUP BY 1, 2)) GROUP BY rk""")
def location_rank(s: S):
    return published(mobility.location_rank(stays(s)))


# --- detected versus official population: suppliers' nations as area centres -------------------

SQL["centres"] = """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS area_id, -100.0::DOUBLE + (n_nationkey * 7 % 25) * 0.41::DOUBLE AS lon,
       25.0::DOUBLE + (n_nationkey * 11 % 25) * 0.37::DOUBLE AS lat FROM nation"""


def centres(s: S) -> DataFrame:
    k = F.col("n_nationkey")
    return s.table("nation").select(_nation("n_nationkey").alias("area_id"),
                                    (F.lit(-100.0) + (k * 7 % 25) * F.lit(0.41)).alias("lon"),
                                    (F.lit(25.0) + (k * 11 % 25) * F.lit(0.37)).alias("lat"))


SQL["home_pairs"] = """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS pid, CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS place_id
FROM events WHERE event_type = 'purchase'"""
SQL["detected"] = """
SELECT p.area_id, p.population, CAST(coalesce(m.n, 0) AS BIGINT) AS mobile_count FROM population p LEFT JOIN (
  SELECT area_id, count(*) AS n FROM home_pairs h JOIN (
    SELECT place_id, area_id FROM (SELECT p.place_id, c.area_id, row_number() OVER (PARTITION BY p.place_id
             ORDER BY (p.lon - c.lon) * (p.lon - c.lon) + (p.lat - c.lat) * (p.lat - c.lat), c.area_id) AS rn
             FROM places p CROSS JOIN centres c) WHERE rn = 1) a ON a.place_id = h.place_id GROUP BY 1) m ON m.area_id = p.area_id"""


def detected(s: S) -> DataFrame:
    st = s.table("events").select(
        F.col("user_id").cast("string").alias("pid"),
        F.when(F.col("event_type") == "purchase", F.regexp_extract("props", r"(\d+)", 1)).alias("home_place_id"))
    homes_at = mobility.detected_homes(st)
    near = nearest_area(places(s).select("place_id", "lon", "lat"), centres(s), "place_id")
    return mobility.detected_vs_census(homes_at, near, population(s))


@query("detected_vs_census", "SELECT * FROM detected")
def detected_vs_census(s: S):
    return detected(s)


# --- the same with two panels; every third person is in both --------------------------------------

SQL["panel_stays"] = """
SELECT *, CASE WHEN CAST(pid AS BIGINT) % 3 = 0 THEN 'Storm A' ELSE 'Storm B' END AS disaster FROM stays
UNION ALL SELECT *, 'Storm A' FROM stays WHERE CAST(pid AS BIGINT) % 3 = 1"""


def panel_stays(s: S) -> DataFrame:
    third = F.col("pid").cast("long") % 3
    panels = F.when(third == 0, F.array(F.lit("Storm A"))).when(third == 1, F.array(F.lit("Storm B"), F.lit("Storm A"))).otherwise(
        F.array(F.lit("Storm B")))
    return stays(s).withColumn("disaster", F.explode(panels))


SQL["panel_spans"] = """
SELECT disaster, pid, count(*) AS num_stays,
       CAST(round((epoch(date_trunc('second', max(end_ts))) - epoch(date_trunc('second', min(start_ts)))) / 86400) AS INTEGER) AS duration_days
FROM panel_stays GROUP BY 1, 2"""


@query("activity_levels_panels", "SELECT disaster, duration_days, num_stays, count(*) AS count FROM panel_spans GROUP BY 1, 2, 3")
def activity_levels_panels(s: S):
    return mobility.activity_levels(mobility.user_spans(panel_stays(s), ["disaster"]), ["disaster"])


@query("quality_users_panels", "SELECT * FROM panel_spans WHERE num_stays BETWEEN 60 AND 80 AND duration_days BETWEEN 28 AND 30")
def quality_users_panels(s: S):
    return mobility.quality_users(mobility.user_spans(panel_stays(s), ["disaster"]), (60, 80), (28, 30))


@query("stay_distributions_panels", f"""
SELECT disaster, 'departure_time' AS quantity, CAST(hour_of_day AS DOUBLE) AS x, {R('count(*) / sum(count(*)) OVER (PARTITION BY disaster)')} AS y
FROM panel_stays GROUP BY disaster, hour_of_day
UNION ALL SELECT disaster, 'stay_duration', (bin + 0.5::DOUBLE) / 2, {R('count(*) / sum(count(*)) OVER (PARTITION BY disaster)')}
FROM (SELECT disaster, CAST(floor(h * 2) AS BIGINT) AS bin
      FROM (SELECT disaster, (epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0::DOUBLE AS h FROM panel_stays) WHERE h > 0 AND h <= 24)
GROUP BY disaster, bin
UNION ALL SELECT disaster, 'location_rank', CAST(rk AS DOUBLE), {R('avg(f)')} FROM (
  SELECT disaster, dense_rank() OVER (PARTITION BY disaster, pid ORDER BY v DESC) AS rk, v / sum(v) OVER (PARTITION BY disaster, pid) AS f
  FROM (SELECT disaster, pid, place_id, count(*) AS v FROM panel_stays GROUP BY 1, 2, 3)) GROUP BY disaster, rk""")
def stay_distributions_panels(s: S):
    return published(mobility.stay_distributions(panel_stays(s), ["disaster"]))


SQL["panel_homes"] = """
SELECT h.pid, h.place_id, d.disaster FROM home_pairs h JOIN (SELECT DISTINCT pid, disaster FROM panel_stays) d ON d.pid = h.pid"""


@query("detected_vs_census_panels", """
SELECT p.disaster, p.area_id, p.population, CAST(coalesce(m.n, 0) AS BIGINT) AS mobile_count FROM (
  SELECT 'Storm A' AS disaster, * FROM population WHERE CAST(area_id AS INTEGER) < 15
  UNION ALL SELECT 'Storm B', * FROM population WHERE CAST(area_id AS INTEGER) > 9) p LEFT JOIN (
  SELECT disaster, area_id, count(*) AS n FROM panel_homes h JOIN (
    SELECT place_id, area_id FROM (SELECT p.place_id, c.area_id, row_number() OVER (PARTITION BY p.place_id
             ORDER BY (p.lon - c.lon) * (p.lon - c.lon) + (p.lat - c.lat) * (p.lat - c.lat), c.area_id) AS rn
             FROM places p CROSS JOIN centres c) WHERE rn = 1) a ON a.place_id = h.place_id GROUP BY 1, 2) m
  ON m.area_id = p.area_id AND m.disaster = p.disaster""")
def detected_vs_census_panels(s: S):
    third = F.col("user_id") % 3
    both = F.array_compact(F.array(F.when(third < 2, F.lit("Storm A")), F.when(third > 0, F.lit("Storm B"))))
    st = s.table("events").select(
        F.col("user_id").cast("string").alias("pid"), F.explode(both).alias("disaster"),
        F.when(F.col("event_type") == "purchase", F.regexp_extract("props", r"(\d+)", 1)).alias("home_place_id"))
    near = nearest_area(places(s).select("place_id", "lon", "lat"), centres(s), "place_id")
    area = F.col("area_id").cast("int")
    listed = F.array_compact(F.array(F.when(area < 15, F.lit("Storm A")), F.when(area > 9, F.lit("Storm B"))))
    official = population(s).withColumn("disaster", F.explode(listed))
    return mobility.detected_vs_census(mobility.detected_homes(st, ["disaster"]), near, official, ["disaster"])
