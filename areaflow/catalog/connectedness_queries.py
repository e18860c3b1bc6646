"""Connectedness and evacuation, destination excess, tie probability against distance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.catalog import mobility_queries as M
from areaflow.catalog.density_queries import kde_sql
from areaflow.catalog.geo_queries import polygons
from areaflow.catalog.network_queries import users_and_edges
from areaflow.catalog.sql_fit import normal_p, ols_sql
from areaflow.catalog.views import SQL, R, S, places, published, query
from areaflow.operators import connectedness as K
from areaflow.operators import geo, regress, ties
from areaflow.sources.staging import staged

# --- people are orders, areas customers, storms market segments -------------------------------------

SQL["person"] = """
SELECT o_orderkey AS pid, c_mktsegment AS disaster, CAST(o_custkey AS VARCHAR) AS home_area,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS evacuated, o_totalprice / 2500 AS distance_km
FROM orders JOIN customer ON c_custkey = o_custkey"""


def person(s: S) -> DataFrame:
    return s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("pid"), F.col("c_mktsegment").alias("disaster"),
        F.col("o_custkey").cast("string").alias("home_area"), (F.col("o_orderstatus") == "F").cast("int").alias("evacuated"),
        (F.col("o_totalprice") / 2500).alias("distance_km"))


SQL["ec_res"] = """
SELECT home_area, median_income, ec, p AS ec_pred_from_income, ec - p AS ec_residual FROM (
  SELECT *, regr_intercept(ec, median_income) OVER () + regr_slope(ec, median_income) OVER () * median_income AS p FROM (
    SELECT CAST(c_custkey AS VARCHAR) AS home_area, c_acctbal AS median_income, ec
    FROM customer JOIN (SELECT o_custkey, avg(ln(o_totalprice)) AS ec FROM orders GROUP BY 1) ON o_custkey = c_custkey))"""


def ec_table(s: S) -> DataFrame:
    inc = s.table("customer").select(F.col("c_custkey").cast("string").alias("home_area"), F.col("c_acctbal").alias("median_income"))
    ec = s.table("orders").select(F.col("o_custkey").cast("string").alias("home_area"), F.log("o_totalprice").alias("ec"))
    return K.ec_income(inc, ec)


@query("residualise", f"""
SELECT home_area, {R('median_income')} AS median_income, {R('ec')} AS ec, {R('ec_pred_from_income')} AS ec_pred_from_income,
  {R('ec_residual')} AS ec_residual FROM ec_res""")
def residualise(s: S):
    return published(ec_table(s))


SQL["ec_sub"] = "SELECT * FROM ec_res WHERE home_area IN (SELECT home_area FROM person WHERE evacuated = 1 AND distance_km > 150)"


# The oracle follows the rule for both cases: more than 100 sampled areas, or all areas unchanged.
@query("residual_refit", f"""
SELECT home_area, {R('ec - (regr_intercept(ec, median_income) OVER () + regr_slope(ec, median_income) OVER () * median_income)')} AS ec_residual
FROM ec_sub WHERE (SELECT count(*) FROM ec_sub) > 100
UNION ALL SELECT home_area, {R('ec_residual')} FROM ec_res WHERE (SELECT count(*) FROM ec_sub) <= 100""")
def residual_refit(s: S):
    far = person(s).filter("evacuated = 1 and distance_km > 150")
    out = regress.residual_refit(ec_table(s), far, "home_area", "ec", "median_income", "ec_residual")
    return published(out.select("home_area", "ec_residual"))


SQL["quad"] = """
SELECT disaster, home_area, CASE WHEN median_income < mi AND ec_residual < me THEN 'Low income / Low EC resid'
  WHEN median_income < mi THEN 'Low income / High EC resid' WHEN ec_residual < me THEN 'High income / Low EC resid'
  ELSE 'High income / High EC resid' END AS "group"
FROM (SELECT *, median(median_income) OVER (PARTITION BY disaster) AS mi, median(ec_residual) OVER (PARTITION BY disaster) AS me
      FROM (SELECT DISTINCT p.disaster, e.* FROM person p JOIN ec_res e ON e.home_area = p.home_area))"""


@query("quadrant_split", "SELECT * FROM quad")
def quadrant_split(s: S):
    return K.quadrants(person(s), staged(ec_table(s), "ec"))


SQL["p_share"] = """
SELECT disaster, home_area, CAST(t.t AS INTEGER) AS threshold_km, avg(CASE WHEN evacuated = 1 AND distance_km > t.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
FROM person CROSS JOIN (SELECT unnest([10, 50, 100]) AS t) t GROUP BY 1, 2, 3"""
SQL["g_share"] = """
SELECT s.disaster, q."group", s.threshold_km, avg(share) AS mean_share, stddev_samp(share) AS sd_share, count(*) AS n_area,
       stddev_samp(share) / sqrt(count(*)) AS se_share
FROM p_share s JOIN quad q ON q.disaster = s.disaster AND q.home_area = s.home_area GROUP BY 1, 2, 3"""


def shares_table(s: S) -> DataFrame:
    return K.group_shares(person(s), staged(ec_table(s), "ec"))


@query("group_shares", f"""
SELECT disaster, "group", threshold_km, {R('mean_share')} AS mean_share, {R('sd_share')} AS sd_share, n_area, {R('se_share')} AS se_share FROM g_share""")
def group_shares(s: S):
    return published(shares_table(s))


@query("widest_event", "SELECT disaster, CAST(sum(n_area) AS BIGINT) AS n_area FROM g_share GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 1")
def widest_event(s: S):
    return K.widest_event(shares_table(s))


SQL["effect_rows"] = """
SELECT disaster, threshold_km, 100 * share AS y, (ec_residual - avg(ec_residual) OVER w) / stddev_pop(ec_residual) OVER w AS z
FROM (SELECT s.*, e.ec_residual FROM p_share s JOIN ec_res e ON e.home_area = s.home_area) WINDOW w AS (PARTITION BY disaster, threshold_km)"""
SQL["effect_fit"] = ols_sql("effect_rows", "y", ["z"], ["disaster", "threshold_km"], cov="HC1")


@query("ols_hc1", f"""
SELECT disaster, threshold_km, {R('coef')} AS beta_pp, {R('se')} AS se_pp, {R('coef - 1.96 * se')} AS lo_pp, {R('coef + 1.96 * se')} AS hi_pp,
  {R(normal_p('coef / se'))} AS p, n AS n_area FROM effect_fit WHERE term = 'z'""")
def ols_hc1(s: S):
    return published(K.ec_effect(person(s), staged(ec_table(s), "ec")))


# --- OD index between nations ---------------------------------------------------------------------

SQL["od_index"] = """
SELECT CAST(s_nationkey AS VARCHAR) AS home_area, CAST(c_nationkey AS VARCHAR) AS dest_area, CAST(count(*) AS DOUBLE) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"""


def od_index(s: S) -> DataFrame:
    """Line items between supplier and customer nation; the pair count is summed in two steps.

    Customers are reduced to their nation before the large joins, and line items to
    (order, supplier) counts.
    """
    per_order = s.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    buyer = s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        per_order.join(s.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey", "s_nationkey").agg(F.sum("n").alias("n"))
        .join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("s_nationkey").cast("string").alias("home_area"), F.col("c_nationkey").cast("string").alias("dest_area"))
        .agg(F.sum("n").cast("double").alias("weight")))


SQL["movers"] = """
SELECT o_orderkey AS pid, c_mktsegment AS disaster, CAST(c_nationkey AS VARCHAR) AS home_area,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 25 AS VARCHAR) END AS dest_area,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS evacuated, o_totalprice / 2500 AS distance_km
FROM orders JOIN customer ON c_custkey = o_custkey"""


def movers(s: S) -> DataFrame:
    k = F.col("o_orderkey")
    return s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("pid"), F.col("c_mktsegment").alias("disaster"), F.col("c_nationkey").cast("string").alias("home_area"),
        F.when(k % 11 != 0, (k % 25).cast("string")).alias("dest_area"),
        (F.col("o_orderstatus") == "F").cast("int").alias("evacuated"), (F.col("o_totalprice") / 2500).alias("distance_km"))


@query("origin_baseline", f"SELECT home_area, {R('avg(weight)')} AS baseline FROM od_index GROUP BY 1")
def origin_baseline(s: S):
    return published(K.origin_baseline(od_index(s)))


SQL["excess_person"] = """
SELECT m.disaster, CAST(t.t AS INTEGER) AS threshold_km, m.home_area, m.dest_area, ln(1 + greatest(o.weight, 0)) - ln(1 + greatest(b.baseline, 0)) AS excess
FROM movers m CROSS JOIN (SELECT unnest([10, 50, 100]) AS t) t
JOIN od_index o ON o.home_area = m.home_area AND o.dest_area = m.dest_area
JOIN (SELECT home_area, avg(weight) AS baseline FROM od_index GROUP BY 1) b ON b.home_area = m.home_area
WHERE m.evacuated = 1 AND m.distance_km > t.t"""


@query("od_excess", f"""
SELECT disaster, threshold_km, home_area, dest_area, count(*) AS people, {R('any_value(excess)')} AS excess FROM excess_person GROUP BY 1, 2, 3, 4""")
def od_excess(s: S):
    return published(K.destination_excess(movers(s), staged(od_index(s), "od")))


# The direct kernel sum uses values merged by pair to keep the oracle's cross join small.
SQL["excess_small"] = "SELECT disaster, threshold_km, excess FROM excess_person"


@query("od_excess_density", kde_sql("excess_small", "excess", "-6.0::DOUBLE", "8.0::DOUBLE", ["disaster", "threshold_km"], extra=(
    f", {R('g.mean')} AS mean, CAST(g.n AS BIGINT) AS n")))
def od_excess_density(s: S):
    return published(K.excess_density(K.destination_excess(movers(s), staged(od_index(s), "od"))))


# --- tie probability against distance -----------------------------------------------------------------

SQL["tie_cells"] = """
SELECT k AS cell_id, lon, lat, c.area_id, 400.0::DOUBLE + k % 7 AS area_km2 FROM places p JOIN cell_area c ON c.cell_id = p.k"""


def tie_cells(s: S) -> DataFrame:
    area = M.cell_area(s).select(F.col("cell_id").alias("k"), "area_id")
    return places(s).join(area, "k").select(F.col("k").alias("cell_id"), "lon", "lat", "area_id",
                                            (F.lit(400.0) + F.col("k") % 7).alias("area_km2"))


def _hav(a: str, b: str) -> str:
    return (f"12742.0::DOUBLE * asin(sqrt(least(1.0, greatest(0.0, sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) "
            f"* cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2))))")


SQL["tie_km"] = f"""
SELECT CASE WHEN a.area_id = b.area_id THEN sqrt(a.area_km2) ELSE {_hav('a', 'b')} END AS km
FROM edges e JOIN users u ON u.user_id = e.u JOIN users v ON v.user_id = e.v
JOIN tie_cells a ON a.cell_id = u.home_cell JOIN tie_cells b ON b.cell_id = v.home_cell WHERE e.n_total >= 2"""
_N = ties.N_RANDOM_PAIRS
SQL["user_pos"] = """
SELECT home_cell, row_number() OVER (ORDER BY home_cell % 256, home_cell, user_id) - 1 AS pos FROM users"""
SQL["null_km"] = f"""
SELECT {_hav('a', 'b')} AS km FROM (
  SELECT floor(CAST('0x' || md5(i || ':42:a')[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT count(*) FROM users)) AS pa,
         floor(CAST('0x' || md5(i || ':42:b')[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT count(*) FROM users)) AS pb
  FROM (SELECT unnest(range({_N})) AS i)) d
JOIN user_pos x ON x.pos = d.pa JOIN user_pos y ON y.pos = d.pb
JOIN tie_cells a ON a.cell_id = x.home_cell JOIN tie_cells b ON b.cell_id = y.home_cell WHERE d.pa <> d.pb"""
_BINS = ties.DISTANCE_EDGES_KM
_BIN_SQL = ("SELECT unnest(range(54)) AS bin, unnest([" + ", ".join(f"{e!r}::DOUBLE" for e in _BINS[:-1]) + "]) AS lo, unnest(["
            + ", ".join(f"{e!r}::DOUBLE" for e in _BINS[1:]) + "]) AS hi")
SQL["km_bins"] = _BIN_SQL


@query("tie_distance_own", f"""
SELECT bin, {R('sqrt(lo * hi)')} AS distance_km, edge_n, null_n,
  {R('CASE WHEN null_n >= 50 THEN (edge_n / sum(edge_n) OVER ()) / (null_n / sum(null_n) OVER ()) END')} AS p
FROM (SELECT bin, lo, hi, (SELECT count(*) FROM tie_km WHERE km >= lo AND (km < hi OR (bin = 53 AND km = hi))) AS edge_n,
        (SELECT count(*) FROM null_km WHERE km >= lo AND (km < hi OR (bin = 53 AND km = hi))) AS null_n FROM km_bins)""")
def tie_distance_own(s: S):
    people, edges = users_and_edges(s)
    return published(ties.own_tie_probability(s.spark, edges.filter("n_total >= 2"), people, tie_cells(s), _N))


SQL["null_pairs"] = f"""
SELECT {_hav('a', 'b')} AS km, CAST(p.n * q.n AS BIGINT) AS n FROM (SELECT home_cell, count(*) AS n FROM users GROUP BY 1) p
CROSS JOIN (SELECT home_cell, count(*) AS n FROM users GROUP BY 1) q
JOIN tie_cells a ON a.cell_id = p.home_cell JOIN tie_cells b ON b.cell_id = q.home_cell WHERE p.home_cell <> q.home_cell"""


@query("tie_distance_exact", f"""
SELECT bin, {R('sqrt(lo * hi)')} AS distance_km, edge_n, null_n,
  {R('CASE WHEN null_n >= 50 THEN (edge_n / sum(edge_n) OVER ()) / (null_n / sum(null_n) OVER ()) END')} AS p
FROM (SELECT bin, lo, hi, (SELECT count(*) FROM tie_km WHERE km >= lo AND (km < hi OR (bin = 53 AND km = hi))) AS edge_n,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM null_pairs WHERE km >= lo AND (km < hi OR (bin = 53 AND km = hi))) AS null_n FROM km_bins)""")
def tie_distance_exact(s: S):
    people, edges = users_and_edges(s)
    return published(ties.own_tie_probability(s.spark, edges.filter("n_total >= 2"), people, tie_cells(s), None))


SQL["nation_dim"] = """
SELECT CAST(CAST(area_id AS INTEGER) AS VARCHAR) AS area_id, 25.0::DOUBLE + CAST(area_id AS INTEGER) * 0.21::DOUBLE AS lat,
       -100.0::DOUBLE + CAST(area_id AS INTEGER) * 0.17::DOUBLE AS lon, 900.0::DOUBLE AS area_km2 FROM centres"""


def nation_dim(s: S) -> DataFrame:
    k = F.col("n_nationkey")
    return s.table("nation").select(k.cast("string").alias("area_id"), (F.lit(25.0) + k * F.lit(0.21)).alias("lat"),
                                    (F.lit(-100.0) + k * F.lit(0.17)).alias("lon"), F.lit(900.0).alias("area_km2"))


SQL["od_km"] = f"""
SELECT o.weight, CASE WHEN a.area_id = b.area_id THEN sqrt(a.area_km2) ELSE {_hav('a', 'b')} END AS km,
  a.lat BETWEEN 26 AND 29 AND b.lat BETWEEN 26 AND 29 AND a.lon BETWEEN -99 AND -97 AND b.lon BETWEEN -99 AND -97 AS inside
FROM od_index o JOIN nation_dim a ON a.area_id = o.home_area JOIN nation_dim b ON b.area_id = o.dest_area"""


def _ratio(cond: str, low: int) -> str:
    return (f"CASE WHEN count(*) FILTER ({cond}) >= {low} THEN (sum(weight) FILTER ({cond}) / sum(sum(weight) FILTER ({cond})) OVER ()) "
            f"/ (count(*) FILTER ({cond}) / sum(count(*) FILTER ({cond})) OVER ()) END")


@query("tie_distance_od", f"""
SELECT bin, {R('sqrt(lo * hi)')} AS distance_km, {R(_ratio('km IS NOT NULL', 10))} AS p_all, {R(_ratio('km IS NOT NULL AND inside', 5))} AS p_box
FROM km_bins LEFT JOIN od_km ON km >= lo AND km < hi GROUP BY bin, lo, hi""")
def tie_distance_od(s: S):
    od = ties.od_with_distance(od_index(s), nation_dim(s))
    return published(ties.od_tie_probability(s.spark, od, (26.0, 29.0, -99.0, -97.0)))


@query("area_neighbours_km", f"""
SELECT a.area_id AS home_area, b.area_id AS dest_area, {R('CASE WHEN a.area_id = b.area_id THEN sqrt(a.area_km2) ELSE ' + _hav('a', 'b') + ' END')} AS km
FROM od_index o JOIN nation_dim a ON a.area_id = o.home_area JOIN nation_dim b ON b.area_id = o.dest_area""")
def area_neighbours_km(s: S):
    """Great-circle distance of every OD pair, square root of the area within one."""
    return published(ties.od_with_distance(od_index(s), nation_dim(s)).select("home_area", "dest_area", "km"))


@query("home_area_by_polygon", """
SELECT h.user_id, h.home_cell, i.area_id FROM homes h JOIN in_poly i ON i.point_id = 'p' || h.home_cell
WHERE h.n_night_events >= 2 AND i.area_id IS NOT NULL""")
def home_area_by_polygon(s: S):
    """Homes located by polygon: only distinct home cells are tested."""
    homes = M.homes(s)
    cells = places(s).select(F.col("k").alias("cell_id"), "lon", "lat")
    located = geo.assign_area(cells, polygons(s), "cell_id")
    from areaflow.operators.mobility import home_area

    return home_area(homes, located, 2).select("user_id", "home_cell", "area_id")
