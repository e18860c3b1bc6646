"""Histogram, density and grid queries."""

from pyspark.sql import functions as F

from areaflow.catalog.mobility_queries import detected
from areaflow.catalog import mobility_queries as M
from areaflow.catalog.dwell_queries import cohort60
from areaflow.catalog.views import SQL, R, S, published, query
from areaflow.operators import density as D
from areaflow.operators import mobility
from areaflow.operators.geo import in_box


def kde_sql(source: str, value: str, lo: str, hi: str, by: list[str], factor: str = "scott", min_n: int = 2,
            points: int = 500, zero: str = "", extra: str = "") -> str:
    """Direct kernel sum over data x grid."""
    keys = "".join(f"{b}, " for b in by)
    f = "n ** -0.2" if factor == "scott" else f"{factor}::DOUBLE"
    on = " AND ".join(f"d.{b} = g.{b}" for b in by) or "TRUE"
    x = f"g.lo + (g.hi - g.lo) * i / {points - 1}.0::DOUBLE"
    dens = f"sum(exp(-0.5 * (({x} - d.{value}) / g.h) ** 2)) / (g.n * g.h * sqrt(2 * pi()))"
    if zero:
        dens = f"CASE WHEN {x} <= {zero} THEN 0.0 ELSE {dens} END"
    return f"""
SELECT {''.join(f'g.{b}, ' for b in by)}{R(x)} AS x, {R(dens)} AS density{extra}
FROM (SELECT *, ({f}) * sd AS h FROM (SELECT {keys}CAST(count(*) AS DOUBLE) AS n, stddev_samp({value}) AS sd, avg({value}) AS mean,
        {lo} AS lo, {hi} AS hi FROM {source} {'GROUP BY ' + ', '.join(by) if by else ''}
      {'HAVING' if by else 'HAVING'} count(*) >= {min_n} AND count(DISTINCT {value}) >= 2)) g
JOIN {source} d ON {on} CROSS JOIN (SELECT unnest(range({points})) AS i)
GROUP BY {''.join(f'g.{b}, ' for b in by)}g.lo, g.hi, g.h, g.n, g.mean, i"""


@query("density_hist", f"""
SELECT event_type, bin, bin * 10 + 5.0::DOUBLE AS x, coalesce(n, 0) AS n, {R('coalesce(n, 0) / (t * 10.0::DOUBLE)')} AS density
FROM (SELECT event_type, count(*) AS t FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1) CROSS JOIN (SELECT unnest(range(20)) AS bin)
LEFT JOIN (SELECT event_type AS e, CAST(least(floor(value / 10), 19) AS BIGINT) AS b, count(*) AS n FROM events
           WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2) ON e = event_type AND b = bin""")
def density_hist(s: S):
    return published(D.histogram(s.table("events"), "value", D.linear_edges(0, 200, 20), ["event_type"]))


_LOG = D.log_edges(0.5, 500, 54)
_LOG_SQL = "SELECT unnest([" + ", ".join(f"{e!r}::DOUBLE" for e in _LOG) + "]) AS e, unnest(range(55)) AS i"


@query("log_hist", f"""
SELECT bin, {R('sqrt(a * b)')} AS x, coalesce(n, 0) AS n, {R('coalesce(n, 0) / (t * (b - a))')} AS density
FROM (SELECT lo.i AS bin, lo.e AS a, hi.e AS b FROM ({_LOG_SQL}) lo JOIN ({_LOG_SQL}) hi ON hi.i = lo.i + 1) CROSS JOIN
 (SELECT count(*) AS t FROM events WHERE value >= 0.5 AND value <= 500)
LEFT JOIN (SELECT lo.i AS k, count(*) AS n FROM events JOIN ({_LOG_SQL}) lo ON value >= lo.e JOIN ({_LOG_SQL}) hi
   ON hi.i = lo.i + 1 AND (value < hi.e OR (hi.i = 54 AND value = hi.e)) GROUP BY 1) ON k = bin""")
def log_hist(s: S):
    h = D.histogram(s.table("events"), "value", _LOG, log=True)
    return published(h.withColumn("x", D.midpoints(_LOG, log=True)))


@query("kde_fixed", kde_sql("events", "value", "0.0::DOUBLE", "400.0::DOUBLE", ["event_type"], "0.15", 5, 200))
def kde_fixed(s: S):
    return published(D.kde(s.table("events"), "value", 0.0, 400.0, 200, ["event_type"], 0.15, 5))


@query("kde_scott", kde_sql("customer", "c_acctbal", "-1000.0::DOUBLE", "10000.0::DOUBLE", [], "scott", 2, 500))
def kde_scott(s: S):
    return published(D.kde(s.table("customer"), "c_acctbal", -1000.0, 10000.0))


@query("expansion_factor_kde", kde_sql("expansion", "expansion_factor", "0.0::DOUBLE",
                                       "quantile_cont(expansion_factor, 0.99)", [], "scott", 5))
def expansion_factor_kde(s: S):
    ef = mobility.expansion_factor(M.users(s), M.population(s))
    return published(D.kde(ef, "expansion_factor", 0.0, None, min_values=5, hi_quantile=0.99))


SQL["evac_km"] = "SELECT disaster, distance_km FROM cohort60 WHERE evacuated = 1 AND distance_km <= 400"


@query("evac_distance_kde", kde_sql("evac_km", "distance_km", "0.0::DOUBLE", "400.0::DOUBLE", ["disaster"], "scott", 5, 500, "1"))
def evac_distance_kde(s: S):
    far = cohort60(s).filter((F.col("evacuated") == 1) & (F.col("distance_km") <= 400))
    return published(D.kde(far, "distance_km", 0.0, 400.0, 500, ["disaster"], "scott", 5, zero_upto=1.0))


_E2 = D.log_edges(1, 10000, 49)
_E2_SQL = "SELECT unnest([" + ", ".join(f"{e!r}::DOUBLE" for e in _E2) + "]) AS e, unnest(range(50)) AS i"


def _bin_sql(v: str) -> str:
    return f"(SELECT max(i) FROM ({_E2_SQL}) WHERE e <= {v})"


# Per part: total quantity against mean price in hundreds.
SQL["part_sums"] = "SELECT l_partkey, sum(l_quantity) AS q, avg(l_extendedprice) / 100 AS v FROM lineitem GROUP BY 1"
SQL["cells2d"] = f"""
SELECT x.i AS ix, y.i AS iy, count(*) AS n FROM part_sums
JOIN (SELECT lo.i, lo.e AS a, hi.e AS b FROM ({_E2_SQL}) lo JOIN ({_E2_SQL}) hi ON hi.i = lo.i + 1) x
  ON q >= x.a AND (q < x.b OR (x.i = 48 AND q = x.b))
JOIN (SELECT lo.i, lo.e AS a, hi.e AS b FROM ({_E2_SQL}) lo JOIN ({_E2_SQL}) hi ON hi.i = lo.i + 1) y
  ON v >= y.a AND (v < y.b OR (y.i = 48 AND v = y.b)) GROUP BY 1, 2"""


def cells2d(s: S):
    parts = s.table("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"),
                                                      (F.avg("l_extendedprice") / 100).alias("v"))
    return D.histogram2d(parts, "q", "v", _E2)


@query("hist2d", "SELECT * FROM cells2d")
def hist2d(s: S):
    return cells2d(s)


@query("class_breaks", f"""
SELECT CAST(k AS INTEGER) AS k, {R('CASE WHEN d = 6 THEN qs[k + 1] ELSE lo + (hi - lo) * k / 5.0::DOUBLE END')} AS boundary
FROM (SELECT quantile_cont(CAST(n AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS qs,
             len(list_distinct(quantile_cont(CAST(n AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS d,
             min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM cells2d) CROSS JOIN (SELECT unnest(range(6)) AS k)""")
def class_breaks(s: S):
    return published(D.class_breaks(cells2d(s)))


@query("expansion_hist", f"""
SELECT bin, {R('bin * 300 / 49.0::DOUBLE + 150 / 49.0::DOUBLE')} AS x, coalesce(n, 0) AS n
FROM (SELECT unnest(range(49)) AS bin) LEFT JOIN (
  SELECT CAST(least(floor(f / (300 / 49.0::DOUBLE)), 48) AS BIGINT) AS b, count(*) AS n
  FROM (SELECT population / nullif(mobile_count, 0) AS f FROM detected) WHERE f BETWEEN 0 AND 300 GROUP BY 1) ON b = bin""")
def expansion_hist(s: S):
    f = detected(s).select(F.try_divide(F.col("population").cast("double"), F.col("mobile_count").cast("double")).alias("f"))
    return published(D.histogram(f.filter(F.col("f").isNotNull()), "f", D.linear_edges(0, 300, 49)).drop("density"))


@query("hexbin", """
SELECT CASE WHEN ga < gb THEN floor(fx + 0.5) ELSE floor(fx) + 0.5 END AS hx, CASE WHEN ga < gb THEN floor(fy + 0.5) ELSE floor(fy) + 0.5 END AS hy,
       count(*) AS n
FROM (SELECT fx, fy, (fx - floor(fx + 0.5)) ** 2 + 3 * (fy - floor(fy + 0.5)) ** 2 AS ga,
             (fx - floor(fx) - 0.5) ** 2 + 3 * (fy - floor(fy) - 0.5) ** 2 AS gb
      FROM (SELECT (l_extendedprice - x0) / (x1 - x0) * 40.0::DOUBLE AS fx, (l_quantity - y0) / (y1 - y0) * 23.0::DOUBLE AS fy
            FROM lineitem CROSS JOIN (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem)))
GROUP BY 1, 2""")
def hexbin(s: S):
    return D.hexbin(s.table("lineitem"), "l_extendedprice", "l_quantity", 40)


@query("clamp_p2_p98", f"""
SELECT event_type, {R('quantile_cont(value, 0.02)')} AS lo, {R('quantile_cont(value, 0.98)')} AS hi FROM events GROUP BY 1""")
def clamp_p2_p98(s: S):
    return published(D.value_clamp(s.table("events"), "value", ["event_type"]))


@query("box_clamp", f"""
SELECT {R('quantile_cont(v, 0.02)')} AS lo, {R('quantile_cont(v, 0.98)')} AS hi FROM (
  SELECT p.place_id, avg(s.stay_us) / 60000000 AS v FROM places p JOIN stays s ON s.place_id = p.place_id
  WHERE p.lat BETWEEN 26.5 AND 32.5 AND p.lon BETWEEN -98.5 AND -92.5 GROUP BY 1)""")
def box_clamp(s: S):
    from areaflow.catalog.views import places, stays

    inside = places(s).filter(in_box("lat", "lon", 26.5, 32.5, -98.5, -92.5)).select("place_id")
    mean = stays(s).join(inside, "place_id").groupBy("place_id").agg((F.avg("stay_us") / 60000000).alias("v"))
    return published(D.value_clamp(mean, "v"))


SQL["kde_curves"] = kde_sql("events", "value", "-100.0::DOUBLE", "900.0::DOUBLE", ["event_type"], "scott", 2, 200)


@query("support_trim", f"""
SELECT event_type, {R('a - 0.08 * greatest(b - a, 0.25)')} AS lo, {R('b + 0.08 * greatest(b - a, 0.25)')} AS hi FROM (
  SELECT c.event_type, min(x) AS a, max(x) AS b FROM kde_curves c JOIN (SELECT event_type, max(density) AS m FROM kde_curves GROUP BY 1) t
    ON t.event_type = c.event_type WHERE c.density > t.m * 0.005 GROUP BY 1)""")
def support_trim(s: S):
    curves = published(D.kde(s.table("events"), "value", -100.0, 900.0, 200, ["event_type"]))
    return published(D.support_trim(curves, ["event_type"]))


@query("exact_quantiles", f"""
SELECT l_returnflag, {R('quantile_cont(l_extendedprice, 0.25)')} AS q25, {R('quantile_cont(l_extendedprice, 0.5)')} AS q50,
       {R('quantile_cont(l_extendedprice, 0.99)')} AS q99 FROM lineitem GROUP BY 1""")
def exact_quantiles(s: S):
    from areaflow.functions.frames import exact_quantiles as quantiles

    return published(quantiles(s.table("lineitem"), "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99},
                               ["l_returnflag"]))
