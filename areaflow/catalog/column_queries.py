"""Code, time, label and reshaping queries."""

from pyspark.sql import functions as F

from areaflow.catalog.views import SQL, R, S, published, query, stays
from areaflow.functions import columns as C
from areaflow.functions.frames import complete, zscore
from areaflow.operators import density, mobility

# Dirty variants of the customer key: decimal tail, blanks, short, long and missing.
SQL["codes"] = """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN c_custkey || '.0' WHEN 1 THEN ' ' || c_custkey || ' '
  WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '1234' || c_custkey WHEN 4 THEN NULL ELSE 'A-' || c_custkey END AS code
FROM customer"""


def codes(s: S):
    k = F.col("c_custkey")
    t, m = k.cast("string"), k % 6
    code = (F.when(m == 0, F.concat(t, F.lit(".0"))).when(m == 1, F.concat(F.lit(" "), t, F.lit(" ")))
            .when(m == 2, t).when(m == 3, F.concat(F.lit("1234"), t)).when(m == 4, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("A-"), t)))
    return s.table("customer").select(k.alias("id"), code.alias("code"))


def _pad(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


@query("norm_codes", f"SELECT id, {_pad('t', 5)} AS area_code FROM (SELECT id, trim(regexp_replace(code, '\\.0$', '')) AS t FROM codes)")
def norm_codes(s: S):
    return codes(s).select("id", C.norm_area_code("code").alias("area_code"))


@query("norm_geoid", f"SELECT id, {_pad('t', 11)} AS geoid FROM (SELECT id, regexp_replace(code, '[^0-9]', '', 'g') AS t FROM codes)")
def norm_geoid(s: S):
    return codes(s).select("id", C.norm_geoid("code").alias("geoid"))


@query("geoid_concat", "SELECT s_suppkey AS id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS geoid FROM supplier")
def geoid_concat(s: S):
    return s.table("supplier").select(F.col("s_suppkey").alias("id"), C.geoid_of(
        C.zero_pad(F.col("s_nationkey").cast("string"), 2),
        C.zero_pad((F.col("s_suppkey") % 1000).cast("string"), 3),
        C.zero_pad(F.col("s_suppkey").cast("string"), 6)).alias("geoid"))


@query("tolerant_cast", "SELECT id, TRY_CAST(code AS DOUBLE) AS num FROM codes WHERE TRY_CAST(code AS DOUBLE) IS NOT NULL")
def tolerant_cast(s: S):
    return codes(s).select("id", C.tolerant("code").alias("num")).filter(F.col("num").isNotNull())


@query("local_night", """
SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS VARCHAR)[1:19] AS local_ts, CAST(hour(ts - INTERVAL 8 HOUR) AS INTEGER) AS local_hour
FROM events WHERE hour(ts - INTERVAL 8 HOUR) >= 20 OR hour(ts - INTERVAL 8 HOUR) < 6""")
def local_night(s: S):
    local = C.to_local("ts")
    return s.table("events").filter(C.is_night(F.hour(local), 20, 6)).select(
        "event_id", F.substring(local.cast("string"), 1, 19).alias("local_ts"), F.hour(local).alias("local_hour"))


@query("night_anchor_week", """
SELECT week AS week, CAST(count(*) AS BIGINT) AS n, CAST(min(rel_day) AS INTEGER) AS first_day, CAST(max(rel_day) AS INTEGER) AS last_day
FROM (SELECT CAST(week AS VARCHAR) AS week, datediff('day', DATE '2024-01-24', night_date) AS rel_day FROM nights) GROUP BY week""")
def night_anchor_week(s: S):
    from datetime import date

    from areaflow.operators.dwell import night_rows

    rows = night_rows(stays(s)).select(
        C.week_start("night_date").cast("string").alias("week"),
        C.relative_day("night_date", F.lit(date(2024, 1, 24))).alias("rel_day"))
    return rows.groupBy("week").agg(F.count("*").alias("n"), F.min("rel_day").alias("first_day"),
                                    F.max("rel_day").alias("last_day"))


@query("date_spine", """
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)) - 5, max(CAST(ts AS DATE)) + 5, INTERVAL 1 DAY)) AS d FROM events) s
LEFT JOIN (SELECT CAST(ts AS DATE) AS e, count(*) AS n FROM events GROUP BY 1) c ON c.e = CAST(s.d AS DATE)""")
def date_spine(s: S):
    """Inclusive calendar around the data; days without events are present with zero."""
    daily = s.table("events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    spine = C.date_spine(daily, "d", 5, 5)
    return complete(daily, spine, ["d"], {"n": 0}).select(F.col("d").cast("string").alias("day"), "n")


@query("finite_ratio", f"""
SELECT o_custkey, {R('sum(o_totalprice) / nullif(sum(CASE WHEN o_orderstatus = $$F$$ THEN 1 ELSE 0 END), 0)')} AS ratio
FROM orders GROUP BY 1""")
def finite_ratio(s: S):
    sums = s.table("orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("num"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("den"))
    return published(sums.select("o_custkey", C.finite_or_null(C.ratio("num", "den")).alias("ratio")))


@query("category_rank", """
SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n FROM (
 SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS rank FROM orders)
WHERE rank < 99 GROUP BY 1""")
def category_rank(s: S):
    rank = C.category_rank("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return s.table("orders").select(rank.alias("rank")).filter("rank < 99").groupBy("rank").agg(
        F.count("*").alias("n"))


@query("significance", """
SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS table_stars,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS forest_stars, n
FROM (SELECT l_orderkey, l_linenumber, l_discount * l_tax * 10 AS p, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)""")
def significance(s: S):
    p = s.table("lineitem").groupBy("l_orderkey", "l_linenumber", (
        F.col("l_discount") * F.col("l_tax") * 10).alias("p")).agg(F.count("*").alias("n"))
    return p.select("l_orderkey", "l_linenumber", C.stars("p").alias("table_stars"),
                    C.stars("p", C.FOREST_CUTS).alias("forest_stars"), "n")


_COND = "sum(CASE WHEN o_orderstatus = $$F$$ AND o_totalprice / 2500 > {t} THEN 1.0 ELSE 0.0 END) / count(*)"


@query("unpivot_shares", f"""
SELECT o_custkey, CAST(threshold_km AS INTEGER) AS threshold_km, share FROM (
""" + " UNION ALL ".join(f"SELECT o_custkey, {t} AS threshold_km, {R(_COND.format(t=t))} AS share FROM orders GROUP BY o_custkey"
                         for t in (10, 50, 100)) + ")")
def unpivot_shares(s: S):
    from areaflow.operators.connectedness import threshold_shares

    person = s.table("orders").select(
        F.col("o_custkey"), (F.col("o_orderstatus") == "F").cast("int").alias("evacuated"),
        (F.col("o_totalprice") / 2500).alias("distance_km"))
    return published(threshold_shares(person, ["o_custkey"]))


@query("complete_domain", """
SELECT s.c_mktsegment AS segment, r.r_name AS region, coalesce(n, 0) AS n
FROM (SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT 'UNSERVED') s CROSS JOIN region r
LEFT JOIN (SELECT c_mktsegment, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) c
  ON c.c_mktsegment = s.c_mktsegment AND c.r_name = r.r_name""")
def complete_domain(s: S):
    """Counts over a segment x region domain wider than the data; missing combinations are filled with zero."""
    c = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        s.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    regions = s.table("region").select(F.collect_set("r_name").alias("r"))
    served = c.select("segment").distinct()
    unserved = s.spark.createDataFrame([("UNSERVED",)], "segment string")
    domain = served.unionByName(unserved).withColumn("region", F.explode(regions.scalar()))
    counts = c.groupBy("segment", "region").agg(F.count("*").alias("n"))
    return complete(counts, domain, ["segment", "region"], {"n": 0})


@query("zscore_by_group", f"""
SELECT c_custkey, {R('(c_acctbal - m) / sd')} AS c_acctbal_z FROM (
  SELECT c_custkey, c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m,
         stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment) AS sd FROM customer)""")
def zscore_by_group(s: S):
    return published(zscore(s.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"],
                            ["c_mktsegment"]).select("c_custkey", "c_acctbal_z"))


@query("span_matrix", f"""
SELECT num_stays, duration_days, {R('log10(count(*) + 1)')} AS log_count FROM spans GROUP BY 1, 2""")
def span_matrix(s: S):
    """All spans in long form; a report pivots the columns it lists."""
    levels = mobility.activity_levels(mobility.user_spans(stays(s)))
    return published(levels.select("num_stays", "duration_days", F.log10(F.col("count") + 1).alias("log_count")))


@query("displaced_flags", """
SELECT o_orderkey, """ + ", ".join(
    f"CASE WHEN o_orderstatus = 'F' AND o_totalprice / 2500 > {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS far_{t}" for t in (10, 50, 100)) + """
FROM orders""")
def displaced_flags(s: S):
    moved, km = (F.col("o_orderstatus") == "F").cast("int"), F.col("o_totalprice") / 2500
    return s.table("orders").select("o_orderkey", *[
        C.displaced_beyond(moved, km, t).alias(f"far_{t}") for t in (10, 50, 100)])
