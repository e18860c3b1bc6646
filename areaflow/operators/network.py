"""Tie network: undirected weighted edges, degrees, clustering, support, connectedness.

Edges are canonical pairs ``u < v``. Threshold sweeps keep the threshold as a key column, so
all thresholds run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.columns import finite_or_null, thresholds_met
from areaflow.functions.frames import attach, complete, exact_quantiles
from areaflow.operators.density import histogram, kde, linear_edges, pmf
from areaflow.sources.staging import staged

# Thresholds of the network sweeps and ranges of the metric densities.
EDGE_THRESHOLDS = (1, 2, 3, 5, 7, 10)
MIN_EDGE_INTERACTIONS = 3
METRIC_RANGES = {"clust": (0.0, 0.7), "sr": (0.0, 1.0), "ec": (0.0, 2.0)}
METRIC_BANDWIDTH = 0.15


def pair_counts(voice: DataFrame, sms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Interactions per unordered pair, calls and messages side by side, self pairs dropped.

    Both kinds go through one conditional sum (one shuffle) instead of two aggregates and a
    full outer join.
    """
    kinds = voice.select(*by, "a_id", "b_id", F.lit(1).alias("_voice")).unionByName(
        sms.select(*by, "a_id", "b_id", F.lit(0).alias("_voice")))
    return (
        kinds.filter(F.col("a_id") != F.col("b_id"))
        .groupBy(*by, F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"))
        .agg(F.sum("_voice").alias("n_voice"), F.sum(1 - F.col("_voice")).alias("n_sms"))
    )


def between_users(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Keep pairs whose two ends are both known users, and attach their areas.

    ``users``: ``user_id``, ``area_id``. Joining counted pairs, not raw events, keeps a busy
    user from dominating the join.
    """
    end = lambda node: users.select(F.col("user_id").alias(node), F.col("area_id").alias(f"area_{node}"))
    return pairs.join(end("u"), "u", "inner").join(end("v"), "v", "inner").select(
        *pairs.columns, (F.col("n_voice") + F.col("n_sms")).alias("n_total"), "area_u", "area_v")


def interaction_edges(voice: DataFrame, sms: DataFrame, users: DataFrame) -> DataFrame:
    return between_users(pair_counts(voice, sms), users)


def edges_at(edges: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """The network at each threshold, told apart by ``threshold_m``."""
    return edges.withColumn("threshold_m", F.explode(thresholds_met("n_total", thresholds)))


def _ends(*carry: str) -> Column:
    """Both directions of an edge from one scan."""
    return F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("other"), *carry),
        F.struct(F.col("v").alias("node"), F.col("u").alias("other"), *carry)))


def degrees(edges: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """Degree of every node at each threshold where it has an edge: one pass over the edges."""
    ends = edges.select(_ends("n_total").alias("_e")).select("_e.*")
    per_node = ends.groupBy("node").agg(*[
        F.sum((F.col("n_total") >= t).cast("long")).alias(f"_d{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_d{i}").alias("d")) for i, t in enumerate(thresholds)])
    return per_node.select("node", F.explode(F.filter(pairs, lambda p: p["d"] > 0)).alias("_p")).select(
        F.col("_p.t").alias("threshold_m"), "node", F.col("_p.d").alias("degree"))


def network_size(degree: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """Edges and nodes per threshold, zero where there are none; every edge adds two to the degree sum."""
    sizes = degree.groupBy("threshold_m").agg(
        (F.sum("degree") / 2).cast("long").alias("n_edges"), F.count("*").alias("n_nodes"))
    listed = degree.sparkSession.createDataFrame([(int(t),) for t in thresholds], "threshold_m int")
    return complete(sizes, listed, ["threshold_m"], {"n_edges": 0, "n_nodes": 0})


def degree_pmf(degree: DataFrame) -> DataFrame:
    return pmf(degree, "degree", ["threshold_m"])


def degree_histogram(degree: DataFrame, threshold: int = MIN_EDGE_INTERACTIONS) -> DataFrame:
    return histogram(degree.filter(F.col("threshold_m") == threshold), "degree", linear_edges(0, 100, 100))


# --- triangles ---------------------------------------------------------------------

def weighted_triangles(edges: DataFrame) -> DataFrame:
    """Every triangle once, at its edge ``(a, b)``: the array ``common`` of closing corners ``node``, ``area`` and weight ``w``.

    ``w`` is the least of the triangle's three weights, so the triangle is in the network at threshold m exactly when
    ``w >= m``: one enumeration serves all thresholds.

    Every edge points from the lower to the higher (degree, id). No node then has more than
    sqrt(2 * edges) outgoing neighbours, however large a hub is, so the neighbour arrays are
    bounded; each triangle is found at its two lowest corners, by intersecting
    arrays rather than listing pairs.
    """
    deg = edges.select(_ends().alias("_e")).groupBy("_e.node").agg(F.count("*").alias("_deg"))
    du = deg.select(F.col("node").alias("u"), F.col("_deg").alias("_du"))
    dv = deg.select(F.col("node").alias("v"), F.col("_deg").alias("_dv"))
    end = lambda x: F.struct(F.col(f"_d{x}").alias("d"), F.col(x).alias("node"), F.col("n_total").alias("w"),
                             F.col(f"area_{x}").alias("area"))
    lower = F.struct(F.col("_du"), F.col("u")) < F.struct(F.col("_dv"), F.col("v"))
    pointed = edges.select("u", "v", "n_total", "area_u", "area_v").join(du, "u").join(dv, "v").select(
        F.when(lower, F.col("u")).otherwise(F.col("v")).alias("a"),
        F.when(lower, F.col("area_u")).otherwise(F.col("area_v")).alias("area_a"),
        F.when(lower, end("v")).otherwise(end("u")).alias("_b")).filter(F.col("a").isNotNull())
    out = pointed.groupBy("a", "area_a").agg(F.array_sort(F.collect_list("_b")).alias("_out"))
    # A closing corner ranks above b, so only the neighbours after b in order travel with the edge.
    legs = out.filter(F.size("_out") > 1).select("a", "area_a", "_out", F.posexplode("_out").alias("_i", "_b")).select(
        "a", "area_a", F.col("_b.node").alias("b"), F.col("_b.area").alias("area_b"), F.col("_b.w").alias("_w"),
        F.slice("_out", F.col("_i") + 2, F.size("_out")).alias("_later")).filter(F.size("_later") > 0)
    heads = out.select(F.col("a").alias("b"), F.col("_out").alias("_out_b"))
    nodes = lambda c: F.transform(c, lambda x: x["node"])
    shared = legs.join(heads, "b").withColumn("_both", F.array_intersect(nodes("_later"), nodes("_out_b"))).filter(
        F.size("_both") > 0)
    # Both arrays are in order of (degree, id): what they share stands in one order and can be zipped.
    kept = lambda c: F.filter(c, lambda x: F.array_contains(F.col("_both"), x["node"]))
    corner = lambda x, y: F.struct(x["node"].alias("node"), x["area"].alias("area"),
                                   F.least(F.col("_w"), x["w"], y["w"]).alias("w"))
    return shared.select("a", "b", "area_a", "area_b", F.zip_with(kept("_later"), kept("_out_b"), corner).alias("common"))


def _counts(items: str | Column, threshold: int) -> Column:
    """How many corners of an array belong to triangles of the network at a threshold."""
    return F.size(F.filter(items, lambda c: c["w"] >= threshold)).cast("long")


def _by_threshold(thresholds: Sequence[int], **columns: str) -> Column:
    """Rows ``threshold_m`` and values from columns that end in the threshold's place in the list."""
    return F.inline(F.array(*[F.struct(F.lit(int(t)).alias("threshold_m"), *[
        F.col(f"{prefix}{i}").alias(name) for name, prefix in columns.items()]) for i, t in enumerate(thresholds)]))


def triangles_per_node(triangles: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """Triangles at each node and threshold where it has any; corners are summed per edge before they travel."""
    several = F.struct(*[_counts("common", t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    one = lambda c: F.struct(*[(c["w"] >= t).cast("long").alias(f"_t{i}") for i, t in enumerate(thresholds)])
    corner = lambda node, n: F.struct(node.alias("node"), n.alias("n"))
    corners = F.concat(F.array(corner(F.col("a"), several), corner(F.col("b"), several)),
                       F.transform("common", lambda c: corner(c["node"], one(c))))
    per_node = triangles.select(F.explode(corners).alias("_c")).groupBy(F.col("_c.node").alias("node")).agg(
        *[F.sum(f"_c.n._t{i}").alias(f"_t{i}") for i in range(len(thresholds))])
    return per_node.select("node", _by_threshold(thresholds, triangles="_t")).filter("triangles > 0")


def local_clustering(edges: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS,
                     triangles: DataFrame | None = None) -> DataFrame:
    """Degree, triangles and clustering coefficient of every node at each threshold where it has an edge.

    ``triangles``: those of ``edges`` where they are known already.
    """
    lowest = edges.filter(F.col("n_total") >= min(thresholds))
    found = triangles_per_node(weighted_triangles(lowest) if triangles is None else triangles, thresholds)
    k = F.col("degree").cast("double")
    return degrees(lowest, thresholds).join(found, ["threshold_m", "node"], "left").withColumn(
        "triangles", F.coalesce("triangles", F.lit(0))).withColumn(
        "clustering", F.when(F.col("degree") > 1, F.col("triangles") / (k * (k - 1) / 2)).otherwise(0.0))


def area_clustering(clustering: DataFrame, users: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """Mean clustering over all residents of an area; residents without edges count as zero."""
    sums = (
        clustering.join(users.select(F.col("user_id").alias("node"), "area_id"), "node", "inner")
        .groupBy("threshold_m", "area_id").agg(F.sum("clustering").alias("_sum"))
    )
    sizes = users.groupBy("area_id").agg(F.count("*").alias("n_users")).withColumn(
        "threshold_m", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return sizes.join(sums, ["threshold_m", "area_id"], "left").select(
        "threshold_m", "area_id", "n_users",
        (F.coalesce("_sum", F.lit(0.0)) / F.col("n_users")).alias("clustering"))


def support_ratio(edges: DataFrame, min_edges: int = 3, thresholds: Sequence[int] = EDGE_THRESHOLDS,
                  triangles: DataFrame | None = None) -> DataFrame:
    """Share of within-area edges whose ends have a common neighbour in the area.

    An edge is supported at a threshold when the best triangle at it, the one of greatest least weight, reaches it.
    ``triangles``: those of ``edges`` where they are known already; else only edges within areas are searched.
    """
    inside = edges.filter((F.col("area_u") == F.col("area_v")) & (F.col("n_total") >= min(thresholds)))
    found = weighted_triangles(inside) if triangles is None else triangles.filter("area_a = area_b")
    at_home = found.withColumn("common", F.filter("common", lambda c: c["area"] == F.col("area_a"))).filter(F.size("common") > 0)
    side = lambda x, y, w: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), w.alias("w"))
    sides = F.concat(
        F.array(side(F.col("a"), F.col("b"), F.array_max(F.transform("common", lambda c: c["w"])))),
        F.transform("common", lambda c: side(F.col("a"), c["node"], c["w"])),
        F.transform("common", lambda c: side(F.col("b"), c["node"], c["w"])))
    best = at_home.select(F.col("area_a").alias("area_id"), F.explode(sides).alias("_s")).groupBy(
        "area_id", "_s.u", "_s.v").agg(F.max("_s.w").alias("best"))
    reach = lambda c, name: [F.sum((F.col(c) >= t).cast("long")).alias(f"{name}{i}") for i, t in enumerate(thresholds)]
    held = best.groupBy("area_id").agg(*reach("best", "_h"))
    size = inside.groupBy(F.col("area_u").alias("area_id")).agg(*reach("n_total", "_n"))
    long = size.join(held, "area_id", "left").select("area_id", _by_threshold(thresholds, n_edges="_n", _held="_h"))
    return long.filter(F.col("n_edges") >= F.greatest(F.lit(min_edges), F.lit(1))).select(
        "threshold_m", "area_id", "n_edges", (F.coalesce("_held", F.lit(0)) / F.col("n_edges")).alias("support_ratio"))


def area_income_class(users: DataFrame, income: DataFrame) -> DataFrame:
    """Areas above the user-weighted median income; an area without income counts as not above."""
    sizes = users.groupBy("area_id").agg(F.count("*").alias("_n"))
    known = sizes.join(income.select("area_id", "median_income"), "area_id", "left")
    middle = exact_quantiles(known, "median_income", {"_middle": 0.5}, (), "_n")
    return attach(known, middle, ()).select(
        "area_id", F.coalesce(F.col("median_income") > F.col("_middle"), F.lit(False)).alias("high"))


def economic_connectedness(edges: DataFrame, classes: DataFrame, thresholds: Sequence[int] = EDGE_THRESHOLDS) -> DataFrame:
    """Twice the mean share of above-median contacts of an area's other residents; all thresholds in one pass over the edges."""
    flag = lambda side: classes.select(F.col("area_id").alias(f"area_{side}"), F.col("high").alias(f"high_{side}"))
    seen = edges.filter(F.col("n_total") >= min(thresholds)).join(flag("u"), "area_u").join(flag("v"), "area_v")
    ends = seen.select("n_total", F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("area_u").alias("area_id"), F.col("high_u").alias("own"),
                 F.col("high_v").alias("friend")),
        F.struct(F.col("v").alias("node"), F.col("area_v").alias("area_id"), F.col("high_v").alias("own"),
                 F.col("high_u").alias("friend")))).alias("_e")).select("n_total", "_e.*")
    share = lambda t: F.avg(F.when(F.col("n_total") >= t, F.col("friend").cast("double")))
    per_node = ends.filter(~F.col("own")).groupBy("area_id", "node").agg(
        *[share(t).alias(f"_f{i}") for i, t in enumerate(thresholds)])
    wide = per_node.groupBy("area_id").agg(*[(F.avg(f"_f{i}") * 2).alias(f"_ec{i}") for i in range(len(thresholds))])
    return wide.select("area_id", _by_threshold(thresholds, ec="_ec")).filter("ec is not null").select("threshold_m", "area_id", "ec")


def metric_sweep(edges: DataFrame, users: DataFrame, income: DataFrame,
                 thresholds: Sequence[int] = EDGE_THRESHOLDS, min_edges: int = 3) -> DataFrame:
    """The three area metrics at every threshold, long, from one enumeration of triangles."""
    triangles = staged(weighted_triangles(edges.filter(F.col("n_total") >= min(thresholds))), "triangles")
    clust = area_clustering(local_clustering(edges, thresholds, triangles), users, thresholds)
    ratio = support_ratio(edges, min_edges, thresholds, triangles)
    ec = economic_connectedness(edges, area_income_class(users, income), thresholds)
    tag = lambda df, name, col: df.select("threshold_m", F.lit(name).alias("metric"), "area_id", F.col(col).alias("value"))
    return tag(clust, "clust", "clustering").unionByName(tag(ratio, "sr", "support_ratio")).unionByName(
        tag(ec, "ec", "ec"))


def metric_sweep_kde(metrics: DataFrame, points: int = 500) -> DataFrame:
    """Density of each area metric at each threshold on the metric's fixed range."""
    top = F.lit(None).cast("double")
    for name, (_, hi) in METRIC_RANGES.items():
        top = F.when(F.col("metric") == name, F.lit(hi)).otherwise(top)
    return kde(metrics, "value", 0.0, top, points, ["threshold_m", "metric"], METRIC_BANDWIDTH, 5)


def area_comparison(edges: DataFrame, users: DataFrame, published: DataFrame,
                    threshold: int = MIN_EDGE_INTERACTIONS) -> DataFrame:
    """Own area metrics beside published ones. ``published``: ``area_id``, ``support_ratio``, ``clustering``."""
    triangles = staged(weighted_triangles(edges.filter(F.col("n_total") >= threshold)), "triangles")
    clust = area_clustering(local_clustering(edges, [threshold], triangles), users, [threshold]).select(
        "area_id", F.col("clustering").alias("clustering_own"), "n_users")
    ratio = support_ratio(edges, 0, [threshold], triangles).select("area_id", "n_edges", F.col("support_ratio").alias("support_ratio_own"))
    other = published.select("area_id", F.col("support_ratio").alias("support_ratio_pub"),
                             F.col("clustering").alias("clustering_pub"))
    return ratio.join(clust, "area_id", "full").join(other, "area_id", "inner")


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over complete pairs; null with fewer than three."""
    both = df.select(*by, finite_or_null(x).alias(x), finite_or_null(y).alias(y)).dropna(subset=[x, y])
    return both.groupBy(*by).agg(
        F.when(F.count("*") >= 3, F.corr(x, y)).alias("rho"), F.count("*").alias("n"))


def stable_areas(comparison: DataFrame, min_edges: int = 50) -> DataFrame:
    return comparison.filter(F.coalesce("n_edges", F.lit(0)) >= min_edges)
