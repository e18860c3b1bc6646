"""Robust linear regressions as two distributed passes over the rows.

Pass one sums cross-products per group; a k x k system (k at most a handful) is solved for
each group's single row; pass two attaches the coefficients, computes residuals and leverages
and sums the sandwich's middle. Columns that are standardised or made free of another in their group are expressions over one more row
per group, so they cost one more pass, however many there are. Rows never leave Spark and the numpy code sees one row per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from areaflow.functions.columns import FOREST_CUTS, TABLE_CUTS, stars
from areaflow.functions.frames import attach

# Fixed value: 97.5 % point of the standard normal distribution.
Z975 = 1.959963984540054


def _key_ddl(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{b}` {types[b]}, " for b in by)


def _solve(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            beta, inv = [], []
            for xx, xy in zip(b["_xx"], b["_xy"]):
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = xx
                full = full + np.triu(full, 1).T
                # The pseudo-inverse gives a category absent from a group a zero coefficient.
                g = np.linalg.pinv(full, rcond=1e-13, hermitian=True)
                beta.append(g @ np.asarray(xy, dtype=float))
                inv.append(g.ravel())
            yield b.drop(columns=["_xx", "_xy"]).assign(_beta=beta, _inv=inv)

    return run


def _sandwich(k: int, keys: Sequence[str], terms: Sequence[str], hc1: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                meat = np.zeros((k, k))
                meat[np.triu_indices(k)] = row.meat
                meat = meat + np.triu(meat, 1).T
                g = np.asarray(row.inv, dtype=float).reshape(k, k)
                cov = g @ meat @ g
                if hc1:
                    cov = cov * row.n / (row.n - k) if row.n > k else cov * np.nan
                for i, t in enumerate(terms):
                    coef = float(row.beta[i])
                    se = math.sqrt(cov[i, i]) if cov[i, i] > 0 else float("nan")
                    z = coef / se if se > 0 else float("nan")
                    out.append([*(getattr(row, c) for c in keys), t, coef, se, z,
                                math.erfc(abs(z) / math.sqrt(2)), row.n])
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "se", "z", "p", "n"])

    return run


def standardised(rows: DataFrame, by: Sequence[str], values: Sequence[str], on: str | None = None,
                 free: Sequence[str] = (), flat: float | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """What standardises columns per group, from one pass, and the standardised columns as expressions over both.

    Means, variances and covariances (each merged from centred partial sums) determine all of it: ``values`` minus mean over
    population sd, and ``free``, named ``_r``, first made free of ``on``: the residual of a column regressed on another
    has mean zero and the variance that the covariance leaves. Attaching the one row per group to the rows gives the
    columns without another pass. ``flat`` stands where nothing varies (null: no value). ``_size`` counts the group.
    """
    named = list(dict.fromkeys([*values, *([on] if on else []), *free]))
    aggs = [F.count("*").alias("_size")]
    for v in named:
        aggs += [F.avg(v).alias(f"_m_{v}"), F.var_pop(v).alias(f"_v_{v}")]
    stats = rows.groupBy(*by).agg(*aggs, *[F.covar_pop(v, on).alias(f"_c_{v}") for v in free])
    off = lambda v: F.col(v).cast("double") - F.col(f"_m_{v}")

    def over_sd(part: Column, variance: Column) -> Column:
        z = F.when(variance > 0, part / F.sqrt(variance))
        return z if flat is None else F.coalesce(z, F.when(part.isNotNull(), F.lit(float(flat))))

    out = {f"{v}_z": over_sd(off(v), F.col(f"_v_{v}")) for v in values}
    for v in free:
        slope = F.try_divide(F.col(f"_c_{v}"), F.col(f"_v_{on}"))
        out[f"{v}_r_z"] = over_sd(off(v) - slope * off(on), F.col(f"_v_{v}") - slope * F.col(f"_c_{v}"))
    return stats, out


def fit_linear(df: DataFrame, y: str | Column, terms: Sequence[str] | Mapping[str, Column], by: Sequence[str] = (),
               weight: str | None = None, cov: str = "HC3", min_rows: int = 3, stats: DataFrame | None = None,
               only: Column | None = None, counts: Observation | None = None) -> DataFrame:
    """Least squares with intercept per group; one row per group and term.

    ``cov`` is ``HC1`` or ``HC3``; with ``weight`` the whitened rows enter the sandwich.
    p-values use the normal distribution. Rows with a missing value are left out.

    ``y`` and ``terms`` may be expressions that also read ``stats``, one row per group. That row travels with the group's
    coefficients, so ``df`` is read once for the cross-products and once for the sandwich, besides what ``stats``
    takes. ``only``: an aggregate over the fitted rows' terms (by name) that a group must meet.
    ``counts`` gets ``n_groups`` with a complete row, and ``n_omitted`` of them for too few rows or for ``only``, while the
    result is computed; a stage that is run again counts its groups again.
    """
    by = list(by)
    terms = dict(terms) if isinstance(terms, Mapping) else {t: F.col(t) for t in terms}
    names = ["const", *terms]
    k = len(names)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    carried = [c for c in stats.columns if c not in by] if stats is not None else []
    x = [F.col(f"_x{i}") for i in range(k)]

    def rows(group: DataFrame | None, *more: str) -> DataFrame:
        """The design, with the columns of the group's row."""
        full = df if group is None else attach(df, group, by)
        design = {"_y": F.col(y) if isinstance(y, str) else y, "_w": w, "_x0": F.lit(1.0)}
        design |= {f"_x{i}": t for i, t in enumerate(terms.values(), 1)}
        return full.select(*by, *more, *[c.cast("double").alias(n) for n, c in design.items()]).dropna(subset=list(design))

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = rows(stats, *carried)
    if only is not None:
        first = first.withColumns({t: x[i] for i, t in enumerate(terms, 1)})
    moments = first.groupBy(*by).agg(
        F.count("*").alias("_n"), F.array(*[F.sum(F.col("_w") * x[i] * x[j]) for i, j in pairs]).alias("_xx"),
        F.array(*[F.sum(F.col("_w") * x[i] * F.col("_y")) for i in range(k)]).alias("_xy"),
        *[F.first(c).alias(c) for c in carried], (F.lit(True) if only is None else only).alias("_only"),
    )
    enough = (F.col("_n") >= min_rows) & F.col("_only")
    if counts is not None:
        moments = moments.observe(counts, F.count("*").alias("n_groups"),
                                  F.count_if(~F.coalesce(enough, F.lit(False))).alias("n_omitted"))
    moments = moments.filter(enough).drop("_only")
    keys = _key_ddl(df, by)
    kept = _key_ddl(stats, carried) if stats is not None else ""
    solved = moments.select(*by, "_n", *carried, "_xx", "_xy").mapInPandas(
        _solve(k), f"{keys}_n long, {kept}_beta array<double>, _inv array<double>")
    b = lambda i: F.element_at("_beta", i + 1)
    g = lambda i, j: F.element_at("_inv", i * k + j + 1)
    fitted = rows(solved, "_n", "_beta", "_inv").withColumn("_e", F.col("_y") - _total([b(i) * x[i] for i in range(k)]))
    m = F.col("_w") * F.col("_w") * F.col("_e") * F.col("_e")
    if cov == "HC3":
        quad = _total([(1.0 if i == j else 2.0) * g(i, j) * x[i] * x[j] for i, j in pairs])
        fitted = fitted.withColumn("_h", F.lit(1.0) - F.col("_w") * quad)
        m = m / F.nullif(F.col("_h") * F.col("_h"), F.lit(0.0))
    fitted = fitted.withColumn("_m", m)
    meats = fitted.groupBy(*by).agg(
        F.first("_n").alias("n"), F.first("_beta").alias("beta"), F.first("_inv").alias("inv"),
        F.array(*[F.sum(F.col("_m") * x[i] * x[j]) for i, j in pairs]).alias("meat"))
    return meats.mapInPandas(_sandwich(k, by, names, cov == "HC1"),
                             keys + "term string, coef double, se double, z double, p double, n long")


def _total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def with_interval(fit: DataFrame, z: float = Z975, lo: str = "ci_low", hi: str = "ci_high") -> DataFrame:
    return fit.withColumn(lo, F.col("coef") - F.lit(z) * F.col("se")).withColumn(
        hi, F.col("coef") + F.lit(z) * F.col("se"))


# --- residuals -------------------------------------------------------------------

def residualise(df: DataFrame, ys: Sequence[str], x: str, by: Sequence[str] = (), suffix: str = "_r",
                pred_suffix: str | None = None) -> DataFrame:
    """Residuals of simple regressions on ``x``, all fitted in one pass, per group."""
    fits = df.groupBy(*by).agg(*[e for y in ys for e in (
        F.regr_slope(y, x).alias(f"_b_{y}"), F.regr_intercept(y, x).alias(f"_a_{y}"))])
    out = attach(df, fits, by)
    for y in ys:
        pred = F.col(f"_a_{y}") + F.col(f"_b_{y}") * F.col(x)
        if pred_suffix:
            out = out.withColumn(f"{y}{pred_suffix}", pred)
        out = out.withColumn(f"{y}{suffix}", F.col(y) - pred)
    return out.drop(*[f"_b_{y}" for y in ys], *[f"_a_{y}" for y in ys])


def residual_refit(df: DataFrame, sample: DataFrame, key: str, y: str, x: str, residual: str,
                   more_than: int = 100) -> DataFrame:
    """Residuals refitted on the sampled keys when more than ``more_than`` of them are present.

    Otherwise every row is kept with the residual it has.
    """
    flagged = df.join(sample.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    enough = attach(flagged, flagged.agg((F.count("_in") > more_than).alias("_refit")), ())
    kept = enough.filter(F.col("_in") | ~F.col("_refit"))
    refit = residualise(kept, [y], x, suffix="_again")
    return refit.withColumn(residual, F.when(F.col("_refit"), F.col(f"{y}_again")).otherwise(F.col(residual))).drop(
        "_in", "_refit", f"{y}_again")


# --- recovery ----------------------------------------------------------------------

def _recovery_rows(recovery: DataFrame, outcomes: Sequence[str], metrics: Sequence[str], income: str,
                   weight: str) -> DataFrame:
    """Long by outcome, complete rows with positive weight."""
    return recovery.select("event", income, weight, *metrics, F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])).alias("_o")).select(
        "event", "_o.outcome", "_o.y", income, weight, *metrics).dropna().filter(F.col(weight) >= 1)


def recovery_regression(recovery: DataFrame, outcomes: Sequence[str], metrics: Sequence[str],
                        income: str = "median_income", weight: str = "n_damaged", min_rows: int = 10) -> DataFrame:
    """Weighted, standardised regressions of each outcome on income and income-free metrics, HC3; three passes in all."""
    by = ["event", "outcome"]
    rows = _recovery_rows(recovery, outcomes, metrics, income, weight)
    stats, z = standardised(rows, by, ["y", income], income, metrics)
    fit = fit_linear(rows, z.pop("y_z"), z, by, weight, "HC3", min_rows, stats.filter(F.col("_size") >= min_rows))
    return with_interval(fit)


def coefficient_table(fit: DataFrame, labels: dict[str, str], by: Sequence[str] = ("event", "outcome")) -> DataFrame:
    """Reported terms with labels, interval, p and both notations of significance."""
    name = F.lit(None).cast("string")
    for term, label in labels.items():
        name = F.when(F.col("term") == term, F.lit(label)).otherwise(name)
    return fit.withColumn("predictor", name).filter(F.col("predictor").isNotNull()).select(
        *by, "n", "predictor", "coef", "ci_low", "ci_high", "p", stars("p", TABLE_CUTS).alias("significance"),
        F.concat(F.format_string("%.2f", F.col("coef")), stars("p", FOREST_CUTS)).alias("label_text"))


def variance_decomposition(recovery: DataFrame, outcomes: Sequence[str], metric: str,
                           income: str = "median_income", weight: str = "n_damaged", min_rows: int = 10) -> DataFrame:
    """Weighted R² of income, of the metric, and of income with the income-free metric.

    R² does not change under standardising or when the metric is replaced by its residual
    beside income, so the three weighted correlations determine all of them in one pass over the standardised rows.
    """
    by = ["event", "outcome"]
    rows = _recovery_rows(recovery, outcomes, [metric], income, weight)
    stats, z = standardised(rows, by, ["y", income, metric])
    rows = attach(rows, stats.filter(F.col("_size") >= min_rows), by).select(
        *by, F.col(weight).cast("double").alias("_weight"), *[c.alias(n) for n, c in z.items()])
    v = {"y": "y_z", "a": f"{income}_z", "b": f"{metric}_z"}
    w = F.col("_weight")
    aggs = [F.count("*").alias("n"), F.sum(w).alias("_w")]
    aggs += [F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in v.items()]
    duo = [("y", "y"), ("a", "a"), ("b", "b"), ("y", "a"), ("y", "b"), ("a", "b")]
    aggs += [F.sum(w * F.col(v[i]) * F.col(v[j])).alias(f"_p{i}{j}") for i, j in duo]
    s = rows.groupBy(*by).agg(*aggs)
    c = lambda i, j: F.col(f"_p{i}{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_w")
    r = lambda i, j: F.try_divide(c(i, j), F.sqrt(c(i, i) * c(j, j)))
    s = s.select(*by, "n", r("y", "a").alias("_ya"), r("y", "b").alias("_yb"), r("a", "b").alias("_ab"))
    ya, yb, ab = F.col("_ya"), F.col("_yb"), F.col("_ab")
    joint = F.try_divide(ya * ya + yb * yb - 2 * ya * yb * ab, 1 - ab * ab)
    return s.select(
        *by, "n", (ya * ya).alias("r2_income_only"), (yb * yb).alias("r2_ec_only"), joint.alias("r2_income_plus_ec"),
        (joint - ya * ya).alias("delta_r2_ec"),
        (1 - (1 - joint) * (F.col("n") - 1) / (F.col("n") - 3)).alias("adj_r2_joint"))


# --- panels ----------------------------------------------------------------------------

def _panel_design(panel: DataFrame, disasters: Sequence[str]) -> tuple[DataFrame, list[str]]:
    rows = panel.filter(F.col("disaster").isin(*disasters)).withColumn(
        "post", (F.col("t") >= 0).cast("double"))
    dummies = []
    for i, d in enumerate(sorted(disasters)[1:], 1):
        rows = rows.withColumn(f"is_{i}", (F.col("disaster") == d).cast("double"))
        dummies.append(f"is_{i}")
    return rows, dummies


def panel_by_bin(panel: DataFrame, disasters: Sequence[str], value: str = "mean_rog", min_rows: int = 10) -> DataFrame:
    """Post-event change within each intensity bin, event fixed effects, HC3.

    Bins with few rows or only one side of the event are left out.
    """
    rows, dummies = _panel_design(panel, disasters)
    fit = fit_linear(rows, value, ["post", *dummies], ["int_bin"], None, "HC3", min_rows, only=F.min("post") < F.max("post"))
    return fit.filter(F.col("term") == "post").select(
        "int_bin", F.col("coef").alias("alpha1_km"), F.col("se").alias("std_err"), "p", "n")


def panel_pooled(panel: DataFrame, rank: Column, disasters: Sequence[str], value: str = "mean_rog") -> DataFrame:
    """Post-event change by ordered intensity, event fixed effects, HC3."""
    rows, dummies = _panel_design(panel, disasters)
    rows = rows.withColumn("rank", rank).filter(F.col("rank") < 99).withColumn("post_rank", F.col("post") * F.col("rank"))
    fit = fit_linear(rows, value, ["post", "rank", "post_rank", *dummies], (), None, "HC3")
    return with_interval(fit.filter(F.col("term").isin("post", "post_rank"))).select(
        "term", "coef", F.col("se").alias("std_err"), "z", "p", "ci_low", "ci_high")
