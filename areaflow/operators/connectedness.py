"""Connectedness of areas against evacuation: residuals, group shares, effects, destination excess.

``person``: ``pid``, ``disaster``, ``home_area``, ``dest_area``, ``evacuated``, ``distance_km``. The
area column may be a ZIP-like code or a tract id; nothing here depends on which.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.columns import displaced_beyond, finite_or_null
from areaflow.functions.frames import exact_quantiles_of
from areaflow.operators.density import kde
from areaflow.operators.regress import fit_linear, residualise, standardised, with_interval

# Displacement thresholds (km) and quadrant labels.
DISTANCE_THRESHOLDS_KM = (10, 50, 100)
GROUP_LABELS = (
    "Low income / Low EC resid",
    "Low income / High EC resid",
    "High income / Low EC resid",
    "High income / High EC resid",
)


def ec_income(income: DataFrame, ec: DataFrame, how: str = "mean") -> DataFrame:
    """Connectedness per area and its residual on income.

    ``how`` merges repeated areas: their mean, or one of them (the smallest value).
    """
    merge = F.avg("ec") if how == "mean" else F.min("ec")
    per_area = ec.select("home_area", finite_or_null(F.col("ec").cast("double")).alias("ec")).dropna().groupBy(
        "home_area").agg(merge.alias("ec"))
    joined = income.select("home_area", finite_or_null(F.col("median_income").cast("double")).alias("median_income")).join(per_area, "home_area", "inner")
    return residualise(joined, ["ec"], "median_income", suffix="_residual", pred_suffix="_pred_from_income")


def threshold_shares(person: DataFrame, keys: Sequence[str],
                     thresholds: Sequence[int] = DISTANCE_THRESHOLDS_KM) -> DataFrame:
    """Share displaced beyond each threshold per key, long; one aggregation for all thresholds."""
    wide = person.groupBy(*keys).agg(*[
        F.avg(displaced_beyond("evacuated", "distance_km", t)).alias(f"share_{t}") for t in thresholds])
    long = wide.unpivot(list(keys), [f"share_{t}" for t in thresholds], "metric", "share")
    return long.withColumn("threshold_km", F.regexp_extract("metric", r"(\d+)", 1).cast("int")).drop("metric")


def area_shares(person: DataFrame, areas: DataFrame, thresholds: Sequence[int] = DISTANCE_THRESHOLDS_KM) -> DataFrame:
    """Shares per event, area and threshold for the areas given, with their columns.

    People are reduced to areas before the attribute join.
    """
    clean = person.filter(F.col("home_area").isNotNull()).withColumn("distance_km", finite_or_null("distance_km"))
    return threshold_shares(clean, ["disaster", "home_area"], thresholds).join(areas, "home_area", "inner")


def ec_effect(person: DataFrame, ec: DataFrame, thresholds: Sequence[int] = DISTANCE_THRESHOLDS_KM) -> DataFrame:
    """Effect of one standard deviation of the residual on the evacuated share (points), HC1.

    One regression per event and threshold over areas.
    """
    known = ec.select("home_area", finite_or_null("ec_residual").alias("ec_residual")).dropna()
    shares = area_shares(person, known, thresholds)
    by = ["disaster", "threshold_km"]
    stats, z = standardised(shares, by, ["ec_residual"], flat=0.0)
    fit = fit_linear(shares, F.col("share") * 100.0, z, by, None, "HC1", 3, stats)
    return with_interval(fit.filter(F.col("term") == "ec_residual_z"), 1.96, "lo_pp", "hi_pp").select(
        "disaster", "threshold_km", F.col("coef").alias("beta_pp"), F.col("se").alias("se_pp"), "lo_pp", "hi_pp",
        "p", F.col("n").alias("n_area"))


def quadrants(person: DataFrame, ec: DataFrame) -> DataFrame:
    """Quadrant of every area present in an event: medians over that event's distinct areas."""
    present = person.filter(F.col("home_area").isNotNull() & F.col("pid").isNotNull()).select(
        "disaster", "home_area").distinct()
    known = ec.select("home_area", finite_or_null("median_income").alias("median_income"),
                      finite_or_null("ec_residual").alias("ec_residual")).dropna()
    areas = present.join(known, "home_area", "inner")
    mid = exact_quantiles_of(areas, {"median_income": {"_mi": 0.5}, "ec_residual": {"_me": 0.5}}, ["disaster"])
    low_income, low_ec = F.col("median_income") < F.col("_mi"), F.col("ec_residual") < F.col("_me")
    label = F.when(low_income & low_ec, GROUP_LABELS[0]).when(low_income, GROUP_LABELS[1]).when(
        low_ec, GROUP_LABELS[2]).otherwise(GROUP_LABELS[3])
    return areas.join(mid, "disaster").select("disaster", "home_area", label.alias("group"))


def group_shares(person: DataFrame, ec: DataFrame, thresholds: Sequence[int] = DISTANCE_THRESHOLDS_KM) -> DataFrame:
    """Mean share per event, quadrant and threshold; every area counts once."""
    q = quadrants(person, ec)
    named = person.filter(F.col("pid").isNotNull() & F.col("home_area").isNotNull()).withColumn(
        "distance_km", finite_or_null("distance_km"))
    shares = threshold_shares(named, ["disaster", "home_area"], thresholds).join(q, ["disaster", "home_area"], "inner")
    out = shares.groupBy("disaster", "group", "threshold_km").agg(
        F.avg("share").alias("mean_share"), F.stddev_samp("share").alias("sd_share"), F.count("*").alias("n_area"))
    return out.withColumn("se_share", F.col("sd_share") / F.sqrt(F.greatest(F.col("n_area"), F.lit(1))))


def widest_event(shares: DataFrame) -> DataFrame:
    """Event covering most areas over all groups and thresholds; of equals the first by name."""
    sizes = shares.groupBy("disaster").agg(F.sum("n_area").alias("n_area"))
    best = F.min(F.struct((-F.col("n_area")).alias("less"), F.col("disaster"), F.col("n_area"))).alias("_m")
    return sizes.agg(best).filter("_m is not null").select(F.col("_m.disaster").alias("disaster"), F.col("_m.n_area").alias("n_area"))


# --- destinations ---------------------------------------------------------------------

def origin_baseline(od: DataFrame, include_self: bool = True) -> DataFrame:
    """Mean index of an origin over all its destinations. ``od``: ``home_area``, ``dest_area``, ``weight``."""
    rows = od if include_self else od.filter(F.col("home_area") != F.col("dest_area"))
    return rows.groupBy("home_area").agg(F.avg("weight").alias("baseline"))


def _excess() -> Column:
    up = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    return finite_or_null(up("weight") - up("baseline"))


def destination_excess(person: DataFrame, od: DataFrame, thresholds: Sequence[int] = DISTANCE_THRESHOLDS_KM,
                       include_self: bool = True) -> DataFrame:
    """Excess connectedness of destinations with the number of evacuees behind each value.

    Evacuees are counted per origin, destination and threshold first, so the large index is
    joined to distinct pairs; only origins that occur are read from it.
    """
    out = person.filter((F.col("evacuated") == 1) & F.col("home_area").isNotNull() & F.col("dest_area").isNotNull())
    levels = F.array(*[F.lit(int(t)) for t in thresholds])
    moves = (
        out.withColumn("threshold_km", F.explode(F.filter(levels, lambda t: F.col("distance_km") > t)))
        .groupBy("disaster", "threshold_km", "home_area", "dest_area").agg(F.count("*").alias("people"))
    )
    origins = out.select("home_area").distinct()
    known = od.filter(F.col("weight").isNotNull()).join(origins, "home_area", "left_semi")
    return (
        moves.join(known, ["home_area", "dest_area"], "inner")
        .join(origin_baseline(known, include_self), "home_area", "inner")
        .select("disaster", "threshold_km", "home_area", "dest_area", "people", _excess().alias("excess"))
        .filter(F.col("excess").isNotNull())
    )


def excess_density(excess: DataFrame, points: int = 500) -> DataFrame:
    return kde(excess, "excess", -6.0, 8.0, points, ["disaster", "threshold_km"], weight="people", with_stats=True)
