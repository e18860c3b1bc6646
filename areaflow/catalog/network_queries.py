"""Tie-network queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.catalog.mobility_queries import income, sms, users, voice
from areaflow.catalog.views import SQL, R, S, published, query
from areaflow.operators import network as N
from areaflow.sources.staging import staged

SQL["edges"] = """
SELECT u, v, CAST(n_voice AS BIGINT) AS n_voice, CAST(n_sms AS BIGINT) AS n_sms, CAST(n_voice + n_sms AS BIGINT) AS n_total,
       a.area_id AS area_u, b.area_id AS area_v
FROM (SELECT least(a_id, b_id) AS u, greatest(a_id, b_id) AS v, sum(CASE WHEN is_voice THEN 1 ELSE 0 END) AS n_voice,
             sum(CASE WHEN is_voice THEN 0 ELSE 1 END) AS n_sms
      FROM contacts WHERE a_id <> b_id GROUP BY 1, 2) e
JOIN users a ON a.user_id = e.u JOIN users b ON b.user_id = e.v"""
SQL["at_m"] = f"""
SELECT e.*, CAST(t.m AS INTEGER) AS threshold_m FROM edges e
JOIN (SELECT unnest([{', '.join(map(str, N.EDGE_THRESHOLDS))}]) AS m) t ON e.n_total >= t.m"""
SQL["both_m"] = """
SELECT threshold_m, u AS node, v AS other, area_u AS area, area_v AS other_area FROM at_m
UNION ALL SELECT threshold_m, v, u, area_v, area_u FROM at_m"""
SQL["deg"] = "SELECT threshold_m, node, count(*) AS degree FROM both_m GROUP BY 1, 2"


def edges(s: S) -> DataFrame:
    return staged(N.interaction_edges(voice(s), sms(s), users(s)), "edges")


def users_and_edges(s: S) -> tuple[DataFrame, DataFrame]:
    people = staged(users(s), "users")
    return people, staged(N.interaction_edges(voice(s), sms(s), people), "edges")


@query("interaction_edges", "SELECT * FROM edges")
def interaction_edges(s: S):
    return N.interaction_edges(voice(s), sms(s), users(s))


_LISTED = (*N.EDGE_THRESHOLDS, 99_999)  # no pair has so many contacts


@query("edges_by_threshold", """
SELECT CAST(l.m AS INTEGER) AS threshold_m, CAST(coalesce(sum(degree), 0) // 2 AS BIGINT) AS n_edges, count(degree) AS n_nodes
FROM (VALUES """ + ", ".join(f"({t})" for t in _LISTED) + """) l(m) LEFT JOIN deg ON threshold_m = l.m GROUP BY 1""")
def edges_by_threshold(s: S):
    return N.network_size(N.degrees(edges(s), _LISTED), _LISTED)


@query("degree", "SELECT * FROM deg")
def degree(s: S):
    return N.degrees(edges(s))


@query("degree_pmf", f"SELECT threshold_m, degree, {R('count(*) / sum(count(*)) OVER (PARTITION BY threshold_m)')} AS p FROM deg GROUP BY 1, 2")
def degree_pmf(s: S):
    return published(N.degree_pmf(N.degrees(edges(s))))


@query("degree_hist", f"""
SELECT bin, bin + 0.5::DOUBLE AS x, coalesce(n, 0) AS n, {R('coalesce(n, 0) / CAST((SELECT count(*) FROM deg WHERE threshold_m = 3 AND degree <= 100) AS DOUBLE)')} AS density
FROM (SELECT unnest(range(100)) AS bin) LEFT JOIN
 (SELECT least(degree, 99) AS d, count(*) AS n FROM deg WHERE threshold_m = 3 AND degree <= 100 GROUP BY 1) ON d = bin""")
def degree_hist(s: S):
    return published(N.degree_histogram(N.degrees(edges(s))))


SQL["tri"] = """
SELECT x.threshold_m, x.u AS a, x.v AS b, y.v AS c FROM at_m x
JOIN at_m y ON y.threshold_m = x.threshold_m AND y.u = x.v
JOIN at_m z ON z.threshold_m = x.threshold_m AND z.u = x.u AND z.v = y.v"""
SQL["clust"] = """
SELECT d.threshold_m, d.node, d.degree, coalesce(t.n, 0) AS triangles,
       CASE WHEN d.degree > 1 THEN coalesce(t.n, 0) / (d.degree * (d.degree - 1) / 2.0::DOUBLE) ELSE 0.0 END AS clustering
FROM deg d LEFT JOIN (SELECT threshold_m, node, count(*) AS n FROM (
    SELECT threshold_m, a AS node FROM tri UNION ALL SELECT threshold_m, b FROM tri UNION ALL SELECT threshold_m, c FROM tri) GROUP BY 1, 2) t
  ON t.threshold_m = d.threshold_m AND t.node = d.node"""


def clustering(s: S) -> DataFrame:
    return N.local_clustering(edges(s))


@query("local_clustering", f"SELECT threshold_m, node, degree, triangles, {R('clustering')} AS clustering FROM clust")
def local_clustering(s: S):
    return published(clustering(s))


SQL["clust_area"] = f"""
SELECT CAST(t.m AS INTEGER) AS threshold_m, u.area_id, count(*) AS n_users, avg(coalesce(c.clustering, 0.0)) AS clustering
FROM users u CROSS JOIN (SELECT unnest([{', '.join(map(str, N.EDGE_THRESHOLDS))}]) AS m) t
LEFT JOIN clust c ON c.threshold_m = t.m AND c.node = u.user_id GROUP BY 1, 2"""


@query("area_clustering", f"SELECT threshold_m, area_id, n_users, {R('clustering')} AS clustering FROM clust_area")
def area_clustering(s: S):
    people, ties = users_and_edges(s)
    return published(N.area_clustering(N.local_clustering(ties), people))


SQL["within"] = "SELECT threshold_m, area_u AS area_id, u, v FROM at_m WHERE area_u = area_v"
SQL["support"] = """
SELECT w.threshold_m, w.area_id, count(*) AS n_edges, avg(CASE WHEN EXISTS (
    SELECT 1 FROM (SELECT threshold_m, area_id, u AS p, v AS q FROM within UNION ALL SELECT threshold_m, area_id, v, u FROM within) x
    JOIN (SELECT threshold_m, area_id, u AS p, v AS q FROM within UNION ALL SELECT threshold_m, area_id, v, u FROM within) y
      ON x.threshold_m = y.threshold_m AND x.q = y.q AND x.area_id = y.area_id
    WHERE x.threshold_m = w.threshold_m AND x.area_id = w.area_id AND x.p = w.u AND y.p = w.v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS support_ratio
FROM within w GROUP BY 1, 2"""


@query("support_ratio", f"SELECT threshold_m, area_id, n_edges, {R('support_ratio')} AS support_ratio FROM support WHERE n_edges >= 3")
def support_ratio(s: S):
    return published(N.support_ratio(edges(s), 3))


SQL["hi_area"] = """
SELECT a.area_id, coalesce(i.median_income > (SELECT median(j.median_income) FROM users u JOIN income j ON j.area_id = u.area_id), FALSE) AS high
FROM (SELECT DISTINCT area_id FROM users) a LEFT JOIN income i ON i.area_id = a.area_id"""
SQL["ec"] = """
SELECT threshold_m, area_id, avg(f) * 2 AS ec FROM (
  SELECT b.threshold_m, b.area AS area_id, b.node, avg(CASE WHEN o.high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f
  FROM both_m b JOIN hi_area h ON h.area_id = b.area JOIN hi_area o ON o.area_id = b.other_area
  WHERE NOT h.high GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("econ_connectedness", f"SELECT threshold_m, area_id, {R('ec')} AS ec FROM ec")
def econ_connectedness(s: S):
    people, ties = users_and_edges(s)
    return published(N.economic_connectedness(ties, N.area_income_class(people, income(s))))


SQL["sweep"] = """
SELECT threshold_m, 'clust' AS metric, area_id, clustering AS value FROM clust_area
UNION ALL SELECT threshold_m, 'sr', area_id, support_ratio FROM support WHERE n_edges >= 3
UNION ALL SELECT threshold_m, 'ec', area_id, ec FROM ec"""


@query("metric_sweep", f"SELECT threshold_m, metric, area_id, {R('value')} AS value FROM sweep")
def metric_sweep(s: S):
    people, ties = users_and_edges(s)
    return published(N.metric_sweep(ties, people, income(s)))


@query("metric_sweep_kde", f"""
SELECT g.threshold_m, g.metric, {R('g.hi * i / 499.0::DOUBLE')} AS x,
       {R('sum(exp(-0.5 * ((g.hi * i / 499.0::DOUBLE - w.value) / (0.15::DOUBLE * g.sd)) ** 2)) / (g.n * 0.15::DOUBLE * g.sd * sqrt(2 * pi()))')} AS density
FROM (SELECT threshold_m, metric, count(*) AS n, stddev_samp(value) AS sd,
             CASE metric WHEN 'clust' THEN 0.7::DOUBLE WHEN 'sr' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS hi
      FROM sweep GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT value) >= 2) g
JOIN sweep w ON w.threshold_m = g.threshold_m AND w.metric = g.metric CROSS JOIN (SELECT unnest(range(500)) AS i)
GROUP BY g.threshold_m, g.metric, g.hi, g.n, g.sd, i""")
def metric_sweep_kde(s: S):
    people, ties = users_and_edges(s)
    return published(N.metric_sweep_kde(staged(N.metric_sweep(ties, people, income(s)), "metrics")))


# --- comparison with published metrics: supplier figures per nation ----------------------------

SQL["published_metrics"] = """
SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS area_id, avg(s_acctbal) / 10000 AS support_ratio,
       CASE WHEN s_nationkey <> 5 THEN max(s_acctbal) / 10000 END AS clustering FROM supplier GROUP BY 1, s_nationkey"""


def published_metrics(s: S) -> DataFrame:
    return s.table("supplier").groupBy("s_nationkey").agg(
        (F.avg("s_acctbal") / 10000).alias("support_ratio"), (F.max("s_acctbal") / 10000).alias("m")).select(
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("area_id"), "support_ratio",
        F.when(F.col("s_nationkey") != 5, F.col("m")).alias("clustering"))


SQL["compare"] = """
SELECT coalesce(a.area_id, c.area_id) AS area_id, a.n_edges, a.support_ratio AS support_ratio_own, c.clustering AS clustering_own,
       c.n_users, p.support_ratio AS support_ratio_pub, p.clustering AS clustering_pub
FROM (SELECT * FROM support WHERE threshold_m = 2) a FULL JOIN (SELECT * FROM clust_area WHERE threshold_m = 2) c ON c.area_id = a.area_id
JOIN published_metrics p ON p.area_id = coalesce(a.area_id, c.area_id)"""


@query("area_compare", f"""
SELECT area_id, n_edges, n_users, {R('support_ratio_own')} AS support_ratio_own, {R('clustering_own')} AS clustering_own,
  {R('support_ratio_pub')} AS support_ratio_pub, {R('clustering_pub')} AS clustering_pub FROM compare WHERE coalesce(n_edges, 0) >= 2""")
def area_compare(s: S):
    people, ties = users_and_edges(s)
    return published(N.stable_areas(N.area_comparison(ties, people, published_metrics(s), 2), 2))


@query("area_correlation", f"""
SELECT {R('CASE WHEN count(*) >= 3 THEN corr(clustering_own, clustering_pub) END')} AS rho, count(*) AS n
FROM compare WHERE clustering_own IS NOT NULL AND clustering_pub IS NOT NULL""")
def area_correlation(s: S):
    people, ties = users_and_edges(s)
    return published(N.correlation(N.area_comparison(ties, people, published_metrics(s), 2),
                                   "clustering_own", "clustering_pub"))
