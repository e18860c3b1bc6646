"""Radius-of-gyration panels and their regressions, recovery regressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.catalog.dwell_queries import cohort60, daily_rg
from areaflow.catalog.mobility_queries import income
from areaflow.catalog.sql_fit import normal_p, ols_sql
from areaflow.catalog.views import EVENTS, SQL, R, S, published, query
from areaflow.functions.columns import category_rank
from areaflow.operators import mobility, regress
from areaflow.sources.staging import staged

BINS = ["calm", "breeze", "gale", "storm"]
STORMS = [e.label for e in EVENTS]

# --- cohort with intensity and income ----------------------------------------------------------

SQL["intensity"] = """
SELECT e.disaster, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS home_area,
       CASE (n_nationkey + CASE WHEN e.disaster = 'Storm A' THEN 0 ELSE 1 END) % 4
         WHEN 0 THEN 'calm' WHEN 1 THEN 'breeze' WHEN 2 THEN 'gale' ELSE 'storm' END AS int_bin
FROM nation CROSS JOIN ev e WHERE n_nationkey <> 7"""


def intensity(s: S) -> DataFrame:
    n = s.table("nation").filter("n_nationkey <> 7").select(
        "n_nationkey", F.explode(F.array(*[F.lit(x) for x in STORMS])).alias("disaster"))
    code = (F.col("n_nationkey") + F.when(F.col("disaster") == STORMS[0], 0).otherwise(1)) % 4
    names = F.array(*[F.lit(b) for b in BINS])
    return n.select("disaster", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("home_area"),
                    F.element_at(names, code + 1).alias("int_bin"))


SQL["people"] = """
SELECT c.*, i.int_bin, n.median_income,
       CASE WHEN n.median_income >= (SELECT median(n2.median_income) FROM cohort60 c2 JOIN income n2 ON n2.area_id = c2.home_area) THEN 'High'
            WHEN n.median_income IS NOT NULL THEN 'Low' END AS income_group
FROM cohort60 c LEFT JOIN intensity i ON i.disaster = c.disaster AND i.home_area = c.home_area
LEFT JOIN income n ON n.area_id = c.home_area"""


def people(s: S) -> DataFrame:
    inc = income(s).select(F.col("area_id").alias("home_area"), "median_income")
    return mobility.enrich_cohort(staged(cohort60(s), "cohort"), intensity(s), inc)


@query("cohort_enriched", f"""
SELECT pid, disaster, home_area, evacuated, int_bin, {R('median_income')} AS median_income, income_group FROM people""")
def cohort_enriched(s: S):
    return published(people(s).select("pid", "disaster", "home_area", "evacuated", "int_bin", "median_income", "income_group"))


SQL["panel"] = """
SELECT r.disaster, r.t, p.int_bin, p.income_group, avg(r.rg_km) AS mean_rog, count(*) AS n
FROM rg r JOIN people p ON p.disaster = r.disaster AND p.pid = r.pid
WHERE p.int_bin IS NOT NULL AND p.income_group IS NOT NULL GROUP BY 1, 2, 3, 4"""


def panel(s: S) -> DataFrame:
    return mobility.rg_panel(daily_rg(s), people(s))


@query("intensity_income_panel", f"SELECT disaster, t, int_bin, income_group, {R('mean_rog')} AS mean_rog, n FROM panel")
def intensity_income_panel(s: S):
    return published(panel(s))


SQL["smooth"] = """
SELECT disaster, t, int_bin, income_group, n, avg(mean_rog) OVER (PARTITION BY disaster, int_bin, income_group ORDER BY t
  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean_rog FROM panel"""


@query("panel_smooth", f"SELECT disaster, t, int_bin, income_group, n, {R('mean_rog')} AS mean_rog FROM smooth")
def panel_smooth(s: S):
    return published(mobility.smooth_panel(panel(s)))


SQL["flat"] = """
SELECT disaster, t, int_bin, sum(mean_rog * n) / sum(n) AS mean_rog, CAST(sum(n) AS BIGINT) AS n,
  CASE WHEN t >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS post, CASE WHEN disaster = 'Storm B' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_1,
  CASE int_bin WHEN 'calm' THEN 0.0::DOUBLE WHEN 'breeze' THEN 1 WHEN 'gale' THEN 2 ELSE 3 END AS rank
FROM smooth GROUP BY 1, 2, 3"""


def flat_panel(s: S) -> DataFrame:
    return mobility.collapse_panel(mobility.smooth_panel(panel(s)), ["disaster", "t", "int_bin"])


@query("panel_weighted_mean", f"SELECT disaster, t, int_bin, {R('mean_rog')} AS mean_rog, n FROM flat")
def panel_weighted_mean(s: S):
    return published(flat_panel(s))


SQL["fe_fit"] = ols_sql("flat", "mean_rog", ["post", "is_1"], ["int_bin"], min_rows=10)


@query("fe_ols_hc3", f"""
SELECT int_bin, {R('coef')} AS alpha1_km, {R('se')} AS std_err, {R(normal_p('coef / se'))} AS p, n FROM fe_fit WHERE term = 'post'""")
def fe_ols_hc3(s: S):
    return published(regress.panel_by_bin(staged(flat_panel(s), "panel"), STORMS))


SQL["pooled_fit"] = ols_sql("flat", "mean_rog", ["post", "rank", "post * rank", "is_1"], [])


@query("interaction_hc3", f"""
SELECT CASE term WHEN 'post' THEN 'post' ELSE 'post_rank' END AS term, {R('coef')} AS coef, {R('se')} AS std_err, {R('coef / se')} AS z,
  {R(normal_p('coef / se'))} AS p, {R('coef - 1.959963984540054 * se')} AS ci_low, {R('coef + 1.959963984540054 * se')} AS ci_high
FROM pooled_fit WHERE term IN ('post', 'post * rank')""")
def interaction_hc3(s: S):
    return published(regress.panel_pooled(staged(flat_panel(s), "panel"), category_rank("int_bin", BINS), STORMS))


SQL["evac_rate"] = """
SELECT disaster, int_bin, count(DISTINCT pid) AS eligible, CAST(sum(evacuated) AS BIGINT) AS evacuated,
       100.0::DOUBLE * sum(evacuated) / count(DISTINCT pid) AS evacuation_rate FROM people WHERE int_bin IS NOT NULL GROUP BY 1, 2"""


@query("evac_rate_by_class", f"SELECT disaster, int_bin, eligible, evacuated, {R('evacuation_rate')} AS evacuation_rate FROM evac_rate")
def evac_rate_by_class(s: S):
    return published(mobility.evacuation_rate(people(s)))


@query("pooled_rate", f"""
SELECT rank, eligible, evacuated, {R('100 * p')} AS rate, {R('100 * sqrt(p * (1 - p) / eligible)')} AS err FROM (
  SELECT CAST(CASE int_bin WHEN 'calm' THEN 0 WHEN 'breeze' THEN 1 WHEN 'gale' THEN 2 ELSE 3 END AS INTEGER) AS rank,
         CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(evacuated) AS BIGINT) AS evacuated,
         CAST(sum(evacuated) AS DOUBLE) / sum(eligible) AS p FROM evac_rate GROUP BY 1)""")
def pooled_rate(s: S):
    return published(mobility.pooled_rate(mobility.evacuation_rate(people(s)), category_rank("int_bin", BINS)))


# --- recovery: areas are customers, events market segments ---------------------------------------

SQL["recovery"] = """
SELECT c.c_mktsegment AS event, c.c_custkey AS area_id, c.c_acctbal AS median_income, l.*
FROM customer c JOIN (
  SELECT o_custkey, count(*) AS n_damaged, avg(l_discount) AS ec, avg(l_tax) AS clustering, avg(l_quantity) AS support,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS abandoned,
         avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rebuilt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c.c_custkey"""

METRICS = ["ec", "clustering", "support"]
OUTCOMES = ["abandoned", "rebuilt"]


def recovery(s: S) -> DataFrame:
    share = lambda f: F.avg((F.col("l_returnflag") == f).cast("double"))
    per_area = s.table("lineitem").join(s.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "o_custkey").agg(F.count("*").alias("n_damaged"), F.avg("l_discount").alias("ec"), F.avg("l_tax").alias("clustering"),
                         F.avg("l_quantity").alias("support"), share("R").alias("abandoned"), share("A").alias("rebuilt"))
    return s.table("customer").join(per_area, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("event"), F.col("c_custkey").alias("area_id"), F.col("c_acctbal").alias("median_income"),
        "n_damaged", *METRICS, *OUTCOMES)


SQL["rec_long"] = """
SELECT event, 'abandoned' AS outcome, abandoned AS y, median_income, n_damaged, ec, clustering, support FROM recovery
UNION ALL SELECT event, 'rebuilt', rebuilt, median_income, n_damaged, ec, clustering, support FROM recovery"""
SQL["rec_resid"] = "SELECT event, outcome, y, median_income AS inc, n_damaged, " + ", ".join(
    f"{m} - (regr_intercept({m}, median_income) OVER w + regr_slope({m}, median_income) OVER w * median_income) AS {m}_r" for m in METRICS) + """
FROM rec_long WINDOW w AS (PARTITION BY event, outcome)"""
SQL["rec_z"] = "SELECT event, outcome, n_damaged, " + ", ".join(
    f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w AS {c}_z" for c in ["y", "inc", *[f"{m}_r" for m in METRICS]]) + """
FROM rec_resid WINDOW w AS (PARTITION BY event, outcome)"""
SQL["rec_fit"] = ols_sql("rec_z", "y_z", ["inc_z", "ec_r_z", "clustering_r_z", "support_r_z"], ["event", "outcome"], "n_damaged", "HC3", 10)


@query("wls_hc3", f"""
SELECT event, outcome, replace(term, 'inc_z', 'median_income_z') AS term, {R('coef')} AS coef, {R('se')} AS se, {R('coef / se')} AS z,
  {R(normal_p('coef / se'))} AS p, n, {R('coef - 1.959963984540054 * se')} AS ci_low, {R('coef + 1.959963984540054 * se')} AS ci_high FROM rec_fit""")
def wls_hc3(s: S):
    return published(regress.recovery_regression(staged(recovery(s), "recovery"), OUTCOMES, METRICS))


def _mark(p: str, cuts) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {c} THEN '{m}'" for c, m in cuts) + " ELSE '' END"


_P = normal_p("coef / se")


@query("coefficient_table", f"""
SELECT event, outcome, n, CASE term WHEN 'inc_z' THEN 'Median income' ELSE 'Econ. connectedness (resid)' END AS predictor,
  {R('coef')} AS coef, {R('coef - 1.959963984540054 * se')} AS ci_low, {R('coef + 1.959963984540054 * se')} AS ci_high, {R('pv')} AS p,
  {_mark('pv', [(0.01, '***'), (0.05, '**'), (0.10, '*')])} AS significance,
  printf('%.2f', coef) || {_mark('pv', [(0.001, '***'), (0.01, '**'), (0.05, '*')])} AS label_text
FROM (SELECT *, {_P} AS pv FROM rec_fit WHERE term IN ('inc_z', 'ec_r_z'))""")
def coefficient_table(s: S):
    fit = regress.recovery_regression(staged(recovery(s), "recovery"), OUTCOMES, METRICS)
    return published(regress.coefficient_table(fit, {"median_income_z": "Median income",
                                                     "ec_r_z": "Econ. connectedness (resid)"}))


SQL["dec_z"] = "SELECT event, outcome, n_damaged AS w, " + ", ".join(
    f"({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g AS {z}" for c, z in [("y", "y"), ("median_income", "a"), ("ec", "b")]) + """
FROM rec_long WINDOW g AS (PARTITION BY event, outcome)"""
# The metric is made free of income by a weighted fit, then standardised, as a separate step.
SQL["dec_free"] = """
SELECT event, outcome, w, y, a, b, (b - (k0 + k1 * a)) AS f FROM (
  SELECT *, (sum(w * b) OVER g - k1 * sum(w * a) OVER g) / sum(w) OVER g AS k0 FROM (
    SELECT *, (sum(w * a * b) OVER g - sum(w * a) OVER g * sum(w * b) OVER g / sum(w) OVER g)
              / (sum(w * a * a) OVER g - sum(w * a) OVER g ** 2 / sum(w) OVER g) AS k1
    FROM dec_z WINDOW g AS (PARTITION BY event, outcome)) WINDOW g AS (PARTITION BY event, outcome))"""


def _r2(x: str) -> str:
    c = lambda p, q: f"(sum(w * {p} * {q}) - sum(w * {p}) * sum(w * {q}) / sum(w))"
    return f"({c('y', x)} ** 2 / ({c('y', 'y')} * {c(x, x)}))"


@query("variance_decomposition", f"""
SELECT event, outcome, n, {R('ra')} AS r2_income_only, {R('rb')} AS r2_ec_only, {R('ra + rf')} AS r2_income_plus_ec, {R('rf')} AS delta_r2_ec,
  {R('1 - (1 - ra - rf) * (n - 1) / (n - 3)')} AS adj_r2_joint
FROM (SELECT event, outcome, count(*) AS n, {_r2('a')} AS ra, {_r2('b')} AS rb, {_r2('f')} AS rf FROM dec_free GROUP BY 1, 2)""")
def variance_decomposition(s: S):
    return published(regress.variance_decomposition(staged(recovery(s), "recovery"), OUTCOMES, "ec"))
