"""Call-record homes, activity of stay-point users, population comparison, exposure panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from areaflow.functions.columns import (finite_or_null, is_night, ratio, to_local, tolerant)
from areaflow.functions.frames import attach, exact_quantiles, top_one
from areaflow.operators.density import binned_share, shares

# Defaults of the home and user-quality definitions.
HOME_TZ = "America/Los_Angeles"
MIN_HOME_NIGHT_EVENTS = 28
HOME_THRESHOLDS = (7, 14, 21, 28, 35, 42, 56, 70)
QUALITY_STAYS = (100, 800)
QUALITY_DAYS = (15, 30)


def counts_at(df: DataFrame, value: str, thresholds: Sequence[float], name: str, key: str = "threshold",
              by: Sequence[str] = ()) -> DataFrame:
    """Rows reaching each threshold, zero included: one conditional sum per threshold, one pass."""
    sums = df.groupBy(*by).agg(*[
        F.coalesce(F.sum((F.col(value) >= t).cast("long")), F.lit(0)).alias(f"_t{i}")
        for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_t{i}").alias("n")) for i, t in enumerate(thresholds)])
    return sums.select(*by, F.explode(pairs).alias("_p")).select(
        *by, F.col("_p.t").alias(key), F.col("_p.n").alias(name))


# --- call-record homes ----------------------------------------------------------

def raw_cell(c: str | Column) -> Column:
    """Numeric cell code from dirty text; anything unparsable becomes null."""
    return finite_or_null(tolerant(c, "double")).try_cast("bigint")


def night_visits(calls: DataFrame, cell_map: DataFrame, by: Sequence[str] = (), tz: str = HOME_TZ,
                 start: int = 20, end: int = 6) -> DataFrame:
    """Night events per user and mapped cell. ``calls``: ``a_id``, ``ts`` (UTC), ``cell_raw``.

    Counting by raw cell first leaves only (user, cell) pairs for the map join.
    """
    counted = (
        calls.filter(is_night(F.hour(to_local("ts", tz)), start, end))
        .select(*by, F.col("a_id").alias("user_id"), raw_cell("cell_raw").alias("raw_cell"))
        .filter(F.col("raw_cell").isNotNull())
        .groupBy(*by, "user_id", "raw_cell").agg(F.count("*").alias("n"))
    )
    return counted.join(cell_map, "raw_cell", "inner").groupBy(*by, "user_id", "cell_id").agg(
        F.sum("n").alias("n_visits"))


def home_cell(visits: DataFrame) -> DataFrame:
    """Most visited night cell per user, smaller id on ties; no threshold applied."""
    return top_one(visits, ["user_id"], [F.desc("n_visits"), F.asc("cell_id")]).select(
        "user_id", F.col("cell_id").alias("home_cell"), F.col("n_visits").alias("n_night_events"))


def homes_by_threshold(homes: DataFrame, thresholds: Sequence[int] = HOME_THRESHOLDS) -> DataFrame:
    return counts_at(homes, "n_night_events", thresholds, "n_homes", "threshold_events")


def home_area(homes: DataFrame, cell_area: DataFrame, min_events: int = MIN_HOME_NIGHT_EVENTS,
              counts: Observation | None = None) -> DataFrame:
    """Users with enough night events, with the area of their home cell. ``cell_area``: ``cell_id``, ``area_id``.

    ``counts`` gets ``n_homes`` and ``n_unmapped`` (homes in no area, which are left out) while the result is written, so the
    share that is lost takes no second job. Counts are exact where the result is written as it is; a
    shuffle behind it that is run again counts its rows again.
    """
    cells = cell_area.select(F.col("cell_id").alias("home_cell"), "area_id")
    found = homes.filter(F.col("n_night_events") >= min_events).join(cells, "home_cell", "left")
    if counts is not None:
        found = found.observe(counts, F.count("*").alias("n_homes"), F.count_if(F.col("area_id").isNull()).alias("n_unmapped"))
    return found.filter(F.col("area_id").isNotNull()).select("user_id", "home_cell", "area_id", "n_night_events")


def unmapped_rate(homes: DataFrame, cell_area: DataFrame, min_events: int = MIN_HOME_NIGHT_EVENTS) -> DataFrame:
    """Share of kept homes whose cell lies in no area."""
    cells = cell_area.select(F.col("cell_id").alias("home_cell"), "area_id")
    return homes.filter(F.col("n_night_events") >= min_events).join(cells, "home_cell", "left").agg(
        F.count("*").alias("n_homes"), F.avg(F.col("area_id").isNull().cast("double")).alias("unmapped_rate"))


def unique_places(calls: DataFrame, cell_map: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct mapped cells per known user over all hours."""
    pairs = (
        calls.select(F.col("a_id").alias("user_id"), raw_cell("cell_raw").alias("raw_cell"))
        .filter(F.col("raw_cell").isNotNull()).distinct()
    )
    return (
        pairs.join(cell_map, "raw_cell", "inner").join(users.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id").agg(F.countDistinct("cell_id").alias("n_places"))
    )


def expansion_factor(users: DataFrame, population: DataFrame) -> DataFrame:
    """Population per detected user and area; areas absent from either side are left out."""
    found = users.groupBy("area_id").agg(F.count("*").alias("n_users"))
    return (
        found.join(population, "area_id", "inner")
        .select("area_id", finite_or_null(ratio("population", "n_users")).alias("expansion_factor"))
        .filter(F.col("expansion_factor").isNotNull())
    )


# --- stay-point users ---------------------------------------------------------------

# ``by`` names the columns that tell panels apart (such as ``disaster``): all panels go through one job, and a person in
# several panels counts in each on their own.

def user_spans(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of stays and observed span in days per person."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return stays.groupBy(*by, "pid").agg(
        F.count("*").alias("num_stays"), F.min("start_ts").alias("_first"), F.max("end_ts").alias("_last"),
    ).select(*by, "pid", "num_stays", F.round(
        (seconds(F.col("_last")) - seconds(F.col("_first"))) / 86400).cast("int").alias("duration_days"))


def activity_levels(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return spans.groupBy(*by, "duration_days", "num_stays").agg(F.count("*").alias("count"))


def quality_users(spans: DataFrame, stays_range: tuple[int, int] = QUALITY_STAYS,
                  days_range: tuple[int, int] = QUALITY_DAYS) -> DataFrame:
    return spans.filter(F.col("num_stays").between(*stays_range) & F.col("duration_days").between(*days_range))


def start_hour_shares(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = stays.groupBy(*by, "hour_of_day").agg(F.count("*").alias("n"))
    return shares(counts, "n", by, "y").select(*by, F.col("hour_of_day").cast("double").alias("x"), "y")


def stay_duration_shares(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half-hour bins over (0, 24] hours; empty bins absent."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = stays.select(*by, ((micros("end_ts") - micros("start_ts")) / 3600000000).alias("hours"))
    return binned_share(hours, "hours", 0.5, 24.0, by)


def location_rank(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean visit share of people's L-th most visited place (dense rank).

    Places with equal visits are counted together first. A person with N stays has fewer
    than sqrt(2N) different visit counts, which bounds the window even for a hot person.
    """
    visits = stays.groupBy(*by, "pid", "place_id").agg(F.count("*").alias("visits"))
    levels = visits.groupBy(*by, "pid", "visits").agg(F.count("*").alias("n_places"))
    person = Window.partitionBy(*by, "pid")
    ranked = levels.withColumn("rank", F.dense_rank().over(person.orderBy(F.desc("visits")))).withColumn(
        "freq", F.col("visits") / F.sum(F.col("visits") * F.col("n_places")).over(person))
    return ranked.groupBy(*by, "rank").agg(
        (F.sum(F.col("freq") * F.col("n_places")) / F.sum("n_places")).alias("y")
    ).select(*by, F.col("rank").cast("double").alias("x"), "y")


def stay_distributions(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start hours, stay lengths and location ranks, long by ``quantity``."""
    tag = lambda df, q: df.select(*by, F.lit(q).alias("quantity"), "x", "y")
    return tag(start_hour_shares(stays, by), "departure_time").unionByName(
        tag(stay_duration_shares(stays, by), "stay_duration")).unionByName(tag(location_rank(stays, by), "location_rank"))


def detected_homes(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """People per home place. ``stays``: ``pid``, ``home_place_id`` (nullable)."""
    pairs = stays.filter(F.col("home_place_id").isNotNull()).select(*by, "pid", "home_place_id").distinct()
    return pairs.groupBy(*by, F.col("home_place_id").alias("place_id")).agg(F.count("*").alias("mobile_count"))


def detected_vs_census(homes: DataFrame, place_area: DataFrame, population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detected and official population per area, zero where nobody was detected.

    With ``by``, ``population`` lists the areas of each panel; people detected elsewhere are not counted.
    """
    found = homes.join(place_area, "place_id", "inner").groupBy(*by, "area_id").agg(
        F.sum("mobile_count").alias("mobile_count"))
    return population.join(found, [*by, "area_id"], "left").select(
        *by, "area_id", "population", F.coalesce("mobile_count", F.lit(0)).alias("mobile_count"))


# --- cohort enrichment and panels ------------------------------------------------------

def enrich_cohort(cohort: DataFrame, intensity: DataFrame, income: DataFrame) -> DataFrame:
    """Intensity bin and income group of each person's home area.

    The income split is at the person-weighted median; unknown income gives no group.
    ``intensity``: ``disaster``, ``home_area``, ``int_bin``; ``income``: ``home_area``, ``median_income``.
    """
    bins = intensity.dropna().groupBy("disaster", "home_area").agg(F.min("int_bin").alias("int_bin"))
    joined = (
        cohort.join(bins, ["disaster", "home_area"], "left")
        .join(income, "home_area", "left")
    )
    per_area = cohort.groupBy("home_area").agg(F.count("*").alias("_people")).join(income, "home_area", "inner")
    middle = exact_quantiles(per_area, "median_income", {"_middle": 0.5}, (), "_people")
    group = F.when(F.col("median_income") >= F.col("_middle"), "High").when(
        F.col("median_income").isNotNull(), "Low")
    return attach(joined, middle, ()).withColumn("income_group", group).drop("_middle")


def rg_panel(rg: DataFrame, people: DataFrame) -> DataFrame:
    """Mean radius and size per event, day, intensity bin and income group."""
    known = people.select("disaster", "pid", "int_bin", "income_group").dropna()
    return (
        rg.filter(F.col("rg_km").isNotNull()).join(known, ["disaster", "pid"], "inner")
        .groupBy("disaster", "t", "int_bin", "income_group")
        .agg(F.avg("rg_km").alias("mean_rog"), F.count("rg_km").alias("n"))
    )


def smooth_panel(panel: DataFrame, value: str = "mean_rog") -> DataFrame:
    """Centred three-row mean in each series; a series has one row per day of the window."""
    w = Window.partitionBy("disaster", "int_bin", "income_group").orderBy("t").rowsBetween(-1, 1)
    return panel.withColumn(value, F.avg(value).over(w))


def collapse_panel(panel: DataFrame, keys: Sequence[str], value: str = "mean_rog", n: str = "n") -> DataFrame:
    """n-weighted mean over the remaining dimensions."""
    return panel.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n).cast("double")).alias(value), F.sum(n).alias(n))


def evacuation_rate(people: DataFrame) -> DataFrame:
    """Evacuated share (percent) per event and intensity bin."""
    return people.filter(F.col("int_bin").isNotNull()).groupBy("disaster", "int_bin").agg(
        F.countDistinct("pid").alias("eligible"), F.sum("evacuated").alias("evacuated"),
    ).withColumn("evacuation_rate", F.lit(100.0) * F.col("evacuated") / F.col("eligible"))


def pooled_rate(rates: DataFrame, rank: Column) -> DataFrame:
    """Rates over all events per intensity rank with the binomial standard error (percent)."""
    pooled = rates.withColumn("rank", rank).filter(F.col("rank") < 99).groupBy("rank").agg(
        F.sum("eligible").alias("eligible"), F.sum("evacuated").alias("evacuated"))
    p = F.col("evacuated") / F.col("eligible")
    return pooled.withColumn("rate", 100.0 * p).withColumn(
        "err", 100.0 * F.sqrt(p * (1 - p) / F.col("eligible")))
