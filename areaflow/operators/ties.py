"""Tie probability against distance: own network with a random-pair or exact null, and an OD index.

Home cells stand for users, so edges are counted per pair of cells before any coordinates are
attached. ``cells``: ``cell_id``, ``lat``, ``lon``, ``area_id``, ``area_km2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.functions.columns import EARTH_RADIUS_KM, haversine_km
from areaflow.functions.frames import attach
from areaflow.operators.density import bin_of, log_edges, midpoints
from areaflow.sources.staging import staged

# Distance bins, null-model size and seed, smallest counts per bin.
DISTANCE_EDGES_KM = tuple(log_edges(0.5, 500.0, 54))
N_RANDOM_PAIRS = 1_000_000
RANDOM_SEED = 42
MIN_NULL_PAIRS = 50
MIN_OD_PAIRS = {"all": 10, "box": 5}


def _two_ends(pairs: DataFrame, cells: DataFrame, a: str, b: str) -> DataFrame:
    end = lambda k, t: cells.select(F.col("cell_id").alias(k), F.col("lat").alias(f"_lat{t}"),
                                    F.col("lon").alias(f"_lon{t}"), F.col("area_id").alias(f"_area{t}"),
                                    F.col("area_km2").alias(f"_km2{t}"))
    return pairs.join(end(a, "1"), a, "inner").join(end(b, "2"), b, "inner")


def pair_km(within: bool) -> Column:
    """Great-circle distance; with ``within``, pairs in one area get the square root of its size."""
    far = haversine_km("_lat1", "_lon1", "_lat2", "_lon2")
    return F.when(F.col("_area1") == F.col("_area2"), F.sqrt("_km21")).otherwise(far) if within else far


def edge_distances(edges: DataFrame, users: DataFrame, cells: DataFrame) -> DataFrame:
    """Number of edges per pair of home cells with their distance."""
    end = lambda k, c: users.select(F.col("user_id").alias(k), F.col("home_cell").alias(c))
    pairs = edges.select("u", "v").join(end("u", "cell_u"), "u").join(end("v", "cell_v"), "v").groupBy(
        "cell_u", "cell_v").agg(F.count("*").alias("n"))
    return _two_ends(pairs, cells, "cell_u", "cell_v").select(
        "cell_u", "cell_v", "n", pair_km(True).alias("km"))


def _unit(tag: str, seed: int) -> Column:
    """Reproducible uniform number in [0, 1) from the row id."""
    text = F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{tag}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def random_pairs(spark: SparkSession, users: DataFrame, n: int = N_RANDOM_PAIRS, seed: int = RANDOM_SEED,
                 slots: int = 1024) -> DataFrame:
    """Cells of ``n`` uniformly drawn ordered user pairs, self pairs removed.

    Users are numbered by laying the cells end to end. The position ranges are cut into
    ``slots`` equal stretches, so a drawn position meets its cell by an equi-join on the
    stretch even when one cell holds most users.
    """
    per_cell = users.groupBy("home_cell").agg(F.count("*").alias("_n"))
    # Running totals in two levels: cells in a hash group, then the groups (at most 256 rows).
    grouped = per_cell.withColumn("_g", F.pmod(F.col("home_cell"), F.lit(256)))
    run = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = grouped.groupBy("_g").agg(F.sum("_n").alias("_gn")).withColumn(
        "_base", F.sum("_gn").over(run([F.lit(0)], "_g")) - F.col("_gn")).select("_g", "_base")
    ends = grouped.join(offsets, "_g").withColumn(
        "_hi", F.col("_base") + F.sum("_n").over(run(["_g"], "home_cell"))).withColumn("_lo", F.col("_hi") - F.col("_n"))
    total = users.agg(F.count("*").alias("_total"))
    width = F.greatest(F.ceil(F.col("_total") / slots), F.lit(1))
    ranges = attach(ends, total, ()).withColumn("_w", width).select(
        F.explode(F.sequence(F.expr("_lo div _w"), F.expr("(_hi - 1) div _w"))).alias("_slot"), "home_cell", "_lo", "_hi")
    drawn = attach(spark.range(n), total, ()).withColumn("_w", width).select(
        "id", "_w", F.floor(_unit("a", seed) * F.col("_total")).alias("pa"),
        F.floor(_unit("b", seed) * F.col("_total")).alias("pb")).filter("pa <> pb")

    def locate(df: DataFrame, pos: str, out: str) -> DataFrame:
        r = ranges.select("_slot", F.col("home_cell").alias(out), "_lo", "_hi")
        return df.withColumn("_slot", F.expr(f"{pos} div _w")).join(r, "_slot").filter(
            (F.col(pos) >= F.col("_lo")) & (F.col(pos) < F.col("_hi"))).drop("_slot", "_lo", "_hi")

    return locate(locate(drawn, "pa", "cell_a"), "pb", "cell_b").groupBy("cell_a", "cell_b").agg(
        F.count("*").alias("n"))


# --- exact null model ---------------------------------------------------------------------

def _tree_level(places: DataFrame, bits: int, parent_bits: int, last: bool) -> DataFrame:
    """Nodes of one level: tiles of ``2**bits`` a side over the globe, or at ``last`` the places themselves.

    A node has its ``key`` and its ``parent``'s, the users ``n`` under it, and the box of its places on the unit sphere in space.
    """
    tiles = lambda b: (F.floor((F.col("lon") + 180.0) / 360.0 * (1 << b)) * (1 << 24)
                       + F.floor((F.col("lat") + 90.0) / 180.0 * (1 << b))).cast("long")
    rows = places.withColumn("parent", tiles(parent_bits) if parent_bits else F.lit(0).cast("long"))
    if last:
        rows = rows.withColumn("key", F.row_number().over(Window.partitionBy("parent").orderBy("lat", "lon")).cast("long"))
    else:
        rows = rows.withColumn("key", tiles(bits))
    flat = F.cos(F.radians("lat"))
    axes = {"x": flat * F.cos(F.radians("lon")), "y": flat * F.sin(F.radians("lon")), "z": F.sin(F.radians("lat"))}
    return rows.groupBy("parent", "key").agg(
        F.sum("n").alias("n"), *[f(c).alias(f"{tag}{a}") for a, c in axes.items() for tag, f in (("low", F.min), ("top", F.max))],
        F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def _reach(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest great-circle distance between places in two nodes' boxes, a little widened."""
    at = lambda side, c: F.col(f"{side}.{c}")
    gap = [F.greatest(F.lit(0.0), at(a, f"low{k}") - at(b, f"top{k}"), at(b, f"low{k}") - at(a, f"top{k}")) for k in "xyz"]
    far = [F.greatest(at(a, f"top{k}") - at(b, f"low{k}"), at(b, f"top{k}") - at(a, f"low{k}")) for k in "xyz"]
    km = lambda d: F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2, F.lit(1.0)))
    return km(gap) * (1 - 1e-9) - 1e-6, km(far) * (1 + 1e-9) + 1e-6


def exact_null_counts(users: DataFrame, cells: DataFrame, bins: Sequence[float] = DISTANCE_EDGES_KM,
                      bits: Sequence[int] = (3, 6, 9, 12)) -> DataFrame:
    """Ordered pairs of different users by distance bin of their home cells, all counted.

    Two copies of a tree of places are walked together. Where the distances between two nodes' boxes all lie in one
    bin, or out of all bins, the pair is settled by the product of its users; only other pairs are opened into pairs of their
    children. Each level is written, so a lost executor costs one level.
    """
    per_cell = users.groupBy(F.col("home_cell").alias("cell_id")).agg(F.count("*").alias("n"))
    places = staged(per_cell.join(cells.select("cell_id", "lat", "lon"), "cell_id").groupBy("lat", "lon").agg(
        F.sum("n").alias("n")).filter("lat IS NOT NULL AND lon IS NOT NULL"), "places")
    node = [f"{t}{k}" for k in "xyz" for t in ("low", "top")]
    ahead = users.sparkSession.createDataFrame([(0, 0)], "pa long, pb long")
    settled = None
    for level, b in enumerate([*bits, None]):
        nodes = _tree_level(places, b or 0, bits[level - 1] if level else 0, b is None)
        side = lambda p, s: nodes.select(F.col("parent").alias(p), F.struct("key", "n", "lat", "lon", *node).alias(s))
        pairs = ahead.join(side("pa", "a"), "pa").join(side("pb", "b"), "pb").filter(
            (F.col("pa") != F.col("pb")) | (F.col("a.key") <= F.col("b.key")))
        low, high = _reach("a", "b")
        if b is None:
            found = bin_of(haversine_km("a.lat", "a.lon", "b.lat", "b.lon"), bins, True, True)
            pairs = pairs.withColumns({"bin": found, "done": F.lit(True)})
        else:
            first, last = bin_of(low, bins, True, True), bin_of(high, bins, True, True)
            pairs = pairs.withColumns({"bin": F.when(first == last, first),
                                       "done": (first == last) | (high < bins[0]) | (low > bins[-1])})
        same = (F.col("pa") == F.col("pb")) & (F.col("a.key") == F.col("b.key"))
        # Users of one place are no distance apart, so a node against itself is never settled whole.
        now = staged(pairs.select(F.col("a.key").alias("pa"), F.col("b.key").alias("pb"), "bin", F.coalesce("done", F.lit(False)).alias("done"),
                                  F.when(same, F.lit(0)).otherwise(F.col("a.n") * F.col("b.n") * 2).alias("w")), "node-pairs")
        counts = now.filter("done AND bin IS NOT NULL").groupBy("bin").agg(F.sum("w").alias("w"))
        settled = counts if settled is None else settled.unionByName(counts)
        ahead = now.filter("NOT done").select("pa", "pb")
        if ahead.isEmpty():
            break
    return settled.groupBy("bin").agg(F.sum("w").cast("long").alias("null_n"))


# --- shares by distance -------------------------------------------------------------------

def bin_counts(df: DataFrame, km: str, weight: str, edges: Sequence[float], last_closed: bool,
               by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("bin", bin_of(km, edges, True, last_closed)).filter(F.col("bin").isNotNull()).groupBy(
        *by, "bin").agg(F.sum(weight).alias("w"), F.count("*").alias("pairs"))


def _bins(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    return spark.range(len(edges) - 1).withColumnRenamed("id", "bin")


def _part(c: str) -> Column:
    """Part of the total over all bins; the table has one row per bin."""
    total = F.sum(c).over(Window.partitionBy(F.lit(0)))
    return F.try_divide(F.col(c).cast("double"), total.cast("double"))


def own_tie_probability(spark: SparkSession, edges: DataFrame, users: DataFrame, cells: DataFrame,
                        n_pairs: int | None = N_RANDOM_PAIRS, seed: int = RANDOM_SEED,
                        min_pairs: int = MIN_NULL_PAIRS, bins: Sequence[float] = DISTANCE_EDGES_KM) -> DataFrame:
    """Share of edges per distance bin over the share of user pairs in it: a seeded draw of ``n_pairs``, or all (``None``)."""
    users = users.join(cells.select(F.col("cell_id").alias("home_cell")), "home_cell", "left_semi")
    ties = bin_counts(edge_distances(edges, users, cells), "km", "n", bins, True)
    if n_pairs is None:
        base = exact_null_counts(users, cells, bins)
    else:
        null = _two_ends(random_pairs(spark, users, n_pairs, seed), cells, "cell_a", "cell_b").withColumn(
            "km", pair_km(False))
        base = bin_counts(null, "km", "n", bins, True).select("bin", F.col("w").alias("null_n"))
    both = _bins(spark, bins).join(ties.select("bin", F.col("w").alias("edge_n")), "bin", "left").join(
        base, "bin", "left").fillna(0, ["edge_n", "null_n"])
    share = F.try_divide(_part("edge_n"), _part("null_n"))
    return both.select(
        "bin", midpoints(bins, log=True).alias("distance_km"), "edge_n", "null_n",
        F.when(F.col("null_n") >= min_pairs, share).alias("p"))


def od_with_distance(od: DataFrame, areas: DataFrame) -> DataFrame:
    """Index rows whose two areas are known, with their distance.

    ``od``: ``home_area``, ``dest_area``, ``weight``; ``areas``: ``area_id``, ``lat``, ``lon``, ``area_km2``.
    """
    dim = areas.select(F.col("area_id").alias("cell_id"), "lat", "lon", "area_id", "area_km2")
    return _two_ends(od, dim, "home_area", "dest_area").select(
        "home_area", "dest_area", "weight", pair_km(True).alias("km"), F.col("_lat1").alias("lat1"),
        F.col("_lon1").alias("lon1"), F.col("_lat2").alias("lat2"), F.col("_lon2").alias("lon2"))


def od_tie_probability(spark: SparkSession, od_km: DataFrame, box: tuple[float, float, float, float],
                       bins: Sequence[float] = DISTANCE_EDGES_KM, min_pairs: dict[str, int] = MIN_OD_PAIRS) -> DataFrame:
    """Share of index weight per distance bin over the share of pairs, everywhere and inside a box.

    Both scopes come from one pass: a row in the box counts towards both.
    """
    lat_min, lat_max, lon_min, lon_max = box
    inside = F.lit(True)
    for la, lo in (("lat1", "lon1"), ("lat2", "lon2")):
        inside = inside & F.col(la).between(lat_min, lat_max) & F.col(lo).between(lon_min, lon_max)
    binned = od_km.withColumn("bin", bin_of("km", bins, True, False)).filter(F.col("bin").isNotNull())
    scoped = binned.groupBy("bin").agg(
        F.sum("weight").alias("w_all"), F.count("*").alias("n_all"),
        F.sum(F.when(inside, F.col("weight"))).alias("w_box"), F.count(F.when(inside, True)).alias("n_box"))
    full = _bins(spark, bins).join(scoped, "bin", "left").fillna(0)
    ratio = lambda k: F.when(F.col(f"n_{k}") >= min_pairs[k], F.try_divide(_part(f"w_{k}"), _part(f"n_{k}")))
    return full.select("bin", midpoints(bins, log=True).alias("distance_km"),
                                         ratio("all").alias("p_all"), ratio("box").alias("p_box"))
