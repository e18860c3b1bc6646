"""The studies as jobs. Each returns named tables; ``sinks.write_tables`` decides what leaves.

Tables that several results share are staged once in the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.columns import finite_or_null, ratio
from areaflow.operators import connectedness as K
from areaflow.operators import density as D
from areaflow.operators import dwell, geo, mobility, network, regress, ties
from areaflow.operators.dwell import Event
from areaflow.sources.staging import staged

#: Tables about single persons or pairs; kept back unless released on purpose.
PRIVATE = ("users", "edges", "cohort")


@dataclass(frozen=True)
class TieInputs:
    """Inputs of the tie-network job; see the operators for columns."""

    voice: DataFrame
    sms: DataFrame
    cell_map: DataFrame
    cells: DataFrame  # cell_id, lat, lon
    polygons: DataFrame  # area_id, part, ring, is_hole
    population: DataFrame
    income: DataFrame | None = None


def tie_network(inp: TieInputs, min_night_events: int = mobility.MIN_HOME_NIGHT_EVENTS,
                home_thresholds: Sequence[int] = mobility.HOME_THRESHOLDS,
                edge_thresholds: Sequence[int] = network.EDGE_THRESHOLDS,
                main_threshold: int = network.MIN_EDGE_INTERACTIONS) -> dict[str, DataFrame]:
    """Homes, interaction network, its distributions and area metrics over all thresholds."""
    homes = staged(mobility.home_cell(mobility.night_visits(inp.voice, inp.cell_map)), "homes")
    cell_area = geo.assign_area(inp.cells, inp.polygons, "cell_id")
    users = staged(mobility.home_area(homes, cell_area, min_night_events), "users")
    edges = staged(network.interaction_edges(inp.voice, inp.sms, users), "edges")
    thresholds = sorted({*edge_thresholds, main_threshold})
    degree = staged(network.degrees(edges, thresholds), "degree")
    places = mobility.unique_places(inp.voice, inp.cell_map, users)
    factor = mobility.expansion_factor(users, inp.population)
    out = {
        "users": users,
        "edges": edges,
        "homes_by_threshold": mobility.homes_by_threshold(homes, home_thresholds),
        "edges_by_threshold": network.network_size(degree, thresholds),
        "degree_by_threshold": network.degree_pmf(degree),
        "degree_distribution": network.degree_histogram(degree, main_threshold),
        "unique_places_distribution": D.histogram(places, "n_places", D.linear_edges(0, 100, 50)),
        "expansion_factor": factor,
        "expansion_factor_kde": D.kde(factor, "expansion_factor", 0.0, None, min_values=5, hi_quantile=0.99),
    }
    if inp.income is not None:
        metrics = staged(network.metric_sweep(edges, users, inp.income, edge_thresholds), "metrics")
        out["area_metrics"] = metrics
        out["area_metrics_kde"] = network.metric_sweep_kde(metrics)
    return out


def tie_comparison(edges: DataFrame, users: DataFrame, published: DataFrame, cells: DataFrame, od: DataFrame,
                   areas: DataFrame, box: tuple[float, float, float, float], threshold: int = 3,
                   min_edges: int = 50, n_pairs: int | None = ties.N_RANDOM_PAIRS) -> dict[str, DataFrame]:
    """Own area metrics beside published ones; tie probability by distance for network and index."""
    spark = edges.sparkSession
    comparison = staged(network.area_comparison(edges, users, published, threshold), "comparison")
    stable = network.stable_areas(comparison, min_edges)
    kept = edges.filter(F.col("n_total") >= threshold)
    own = ties.own_tie_probability(spark, kept, users, cells, n_pairs)
    index = ties.od_tie_probability(spark, ties.od_with_distance(od, areas), box)
    pairs = [("support_ratio", 1.0), ("clustering", 0.7)]
    cor = [network.correlation(stable, f"{m}_own", f"{m}_pub").select(F.lit(m).alias("metric"), "rho", "n") for m, _ in pairs]
    bins, hexes = None, None
    for m, hi in pairs:
        both = stable.filter(F.col(f"{m}_own").isNotNull() & F.col(f"{m}_pub").isNotNull())
        for side in ("own", "pub"):
            h = D.histogram(both, f"{m}_{side}", D.linear_edges(0.0, hi, 40)).select(
                F.lit(m).alias("metric"), F.lit(side).alias("source"), "bin", "x", "density")
            bins = h if bins is None else bins.unionByName(h)
        hx = D.hexbin(both, f"{m}_own", f"{m}_pub").select(F.lit(m).alias("metric"), "hx", "hy", "n")
        hexes = hx if hexes is None else hexes.unionByName(hx)
    return {
        "area_comparison": comparison,
        "area_correlation": cor[0].unionByName(cor[1]),
        "area_histograms": bins,
        "area_hexbins": hexes,
        "distance_decay": own.select("bin", "distance_km", F.col("p").alias("p_own")).join(
            index.select("bin", F.col("p_all").alias("p_index"), F.col("p_box").alias("p_index_box")), "bin"),
    }


def stay_quality(stays: DataFrame, homes: DataFrame, places: DataFrame, centres: DataFrame,
                 population: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """User activity, stay distributions and detected against official population, per panel.

    ``homes``: ``pid``, ``home_place_id``; ``places``: ``place_id``, ``lon``, ``lat``. Where there are several panels,
    ``by`` names their columns in ``stays``, ``homes`` and ``population``.
    """
    spans = staged(mobility.user_spans(stays, by), "spans")
    found = mobility.detected_homes(homes, by)
    spots = places.join(found.select("place_id"), "place_id", "left_semi")
    near = geo.nearest_area(spots, centres, "place_id")
    census = staged(mobility.detected_vs_census(found, near, population, by), "census")
    cells = D.histogram2d(census, "population", "mobile_count", D.log_edges(10, 10000, 49))
    factor = census.select(finite_or_null(ratio("population", "mobile_count")).alias("factor")).dropna()
    return {
        "activity_levels": mobility.activity_levels(spans, by),
        "quality_counts": mobility.quality_users(spans).groupBy(*by).agg(F.count("*").alias("n_quality")),
        "stay_distributions": mobility.stay_distributions(stays, by),
        "population_comparison": census.select(*by, "population", "mobile_count"),
        "population_cells": cells,
        "population_breaks": D.class_breaks(cells),
        "expansion_histogram": D.histogram(factor, "factor", D.linear_edges(0, 300, 49)),
    }


def evacuation(stays: DataFrame, events: Sequence[Event], place_area: DataFrame, area_xy: DataFrame,
               thresholds: Sequence[int] = dwell.EVAC_THRESHOLDS_MIN, main: int = dwell.MAIN_THRESHOLD_MIN,
               pre_weeks: int = 4, min_place_minutes: float = dwell.MIN_PLACE_MINUTES,
               max_km: float = 200.0) -> dict[str, DataFrame]:
    """Threshold summary, distance density and the per-person cohort, all events in one pass."""
    places = staged(dwell.evacuation_places(stays, events, place_area, thresholds, pre_weeks, min_place_minutes), "places")
    cohort = staged(dwell.cohort(places, area_xy, main), "cohort")
    far = cohort.filter((F.col("evacuated") == 1) & (F.col("distance_km") <= max_km))
    return {
        "threshold_summary": dwell.evacuation_summary(places, events, thresholds),
        "distance_kde": D.kde(far, "distance_km", 0.0, max_km, 500, ["disaster"], min_values=5, zero_upto=1.0),
        "cohort": cohort,
    }


def gyration(stays: DataFrame, events: Sequence[Event], place_area: DataFrame, area_xy: DataFrame, cohort: DataFrame,
             intensity: DataFrame, income: DataFrame, rank: Column, regression_events: Sequence[str],
             min_place_minutes: float = dwell.MIN_PLACE_MINUTES) -> dict[str, DataFrame]:
    """Radius panel by intensity and income, evacuation rates, panel regressions."""
    people = staged(mobility.enrich_cohort(cohort, intensity, income), "people")
    rg = dwell.radius_of_gyration(stays, events, place_area, area_xy, min_place_minutes=min_place_minutes)
    panel = staged(mobility.rg_panel(rg, people), "panel")
    flat = staged(mobility.collapse_panel(mobility.smooth_panel(panel), ["disaster", "t", "int_bin"]), "flat")
    rates = mobility.evacuation_rate(people)
    return {
        "rg_panel": panel,
        "rg_curves": mobility.collapse_panel(panel, ["disaster", "t", "int_bin"]),
        "evacuation_rate": rates,
        "evacuation_rate_pooled": mobility.pooled_rate(rates, rank),
        "post_effect_by_bin": regress.panel_by_bin(flat, regression_events),
        "post_effect_pooled": regress.panel_pooled(flat, rank, regression_events),
    }


def connectedness(person: DataFrame, income: DataFrame, ec: DataFrame, od: DataFrame | None = None,
                  merge: str = "mean", thresholds: Sequence[int] = K.DISTANCE_THRESHOLDS_KM) -> dict[str, DataFrame]:
    """Residual connectedness against evacuation, for any area level."""
    table = staged(K.ec_income(income, ec, merge), "ec")
    shares = staged(K.group_shares(person, table, thresholds), "shares")
    out = {
        "ec_income": table,
        "ec_effect": K.ec_effect(person, table, thresholds),
        "group_shares": shares,
        "widest_event": K.widest_event(shares),
        "income_correlation": network.correlation(table, "median_income", "ec"),
        "ec_income_sample": regress.residual_refit(
            table.dropna(), person.select("home_area"), "home_area", "ec", "median_income", "ec_residual"),
    }
    if od is not None:
        curves = staged(K.excess_density(K.destination_excess(person, od, thresholds)), "excess")
        out["destination_excess"] = curves
        out["destination_excess_range"] = D.support_trim(curves, ["disaster"])
    return out


def recovery(table: DataFrame, outcomes: Sequence[str], metrics: Sequence[str], labels: dict[str, str],
             explained: str) -> dict[str, DataFrame]:
    """Recovery regressions and variance shares per event and outcome, for any area level."""
    fit = staged(regress.recovery_regression(table, outcomes, metrics), "fit")
    return {
        "coefficients": regress.coefficient_table(fit, labels),
        "variance_shares": regress.variance_decomposition(table, outcomes, explained),
    }


def displacement(stays: DataFrame, events: Sequence[Event], place_area: DataFrame, coverage: DataFrame,
                 min_place_minutes: float = dwell.MIN_PLACE_MINUTES) -> dict[str, DataFrame]:
    """Nightly displacement by damage group, raw and rebased."""
    positions = dwell.nightly_positions(stays, events, place_area, min_place_minutes=min_place_minutes)
    curve = staged(dwell.displacement_curve(positions, dwell.damage_group(coverage)), "curve")
    return {"displacement_curve": curve, "displacement_rebased": dwell.rebase_curve(curve)}
