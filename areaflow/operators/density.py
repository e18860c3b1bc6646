"""Distributions on fixed grids: histograms, shares, pmf, kernel densities, 2-D and hex bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.columns import as_col, finite_or_null
from areaflow.functions.frames import attach, exact_quantiles, numbered, spread


def linear_edges(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / n
    return [lo + i * step for i in range(n)] + [hi]


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    a, b = math.log10(lo), math.log10(hi)
    step = (b - a) / n
    return [10 ** (a + i * step) for i in range(n)] + [10 ** b]


def _constants(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def bin_of(x: str | Column, edges: Sequence[float], log: bool = False, last_closed: bool = True) -> Column:
    """Index of the half-open bin holding ``x``; null outside the edges.

    The position is computed from the even spacing and then corrected against the exact
    edges, so the cost does not grow with the number of bins.
    """
    x = as_col(x).cast("double")
    n, lo, hi = len(edges) - 1, float(edges[0]), float(edges[-1])
    edge = _constants(edges)
    if log:
        safe = F.when(x > 0, x)
        pos = (F.log10(safe) - math.log10(lo)) / ((math.log10(hi) - math.log10(lo)) / n)
    else:
        pos = (x - lo) / ((hi - lo) / n)
    inside = (x >= lo) & ((x <= hi) if last_closed else (x < hi))
    guess = F.least(F.greatest(F.floor(F.when(inside, pos)), F.lit(0)), F.lit(n - 1)).cast("int")
    low, high = F.element_at(edge, guess + 1), F.element_at(edge, guess + 2)
    moved = F.when(x < low, guess - 1).when((x >= high) & (guess < n - 1), guess + 1).otherwise(guess)
    return F.when(inside, moved).cast("long")


def _edge_at(edges: Sequence[float], k: Column) -> Column:
    return F.element_at(_constants(edges), k.cast("int") + 1)


def midpoints(edges: Sequence[float], k: str = "bin", log: bool = False) -> Column:
    a, b = _edge_at(edges, F.col(k)), _edge_at(edges, F.col(k) + 1)
    return F.sqrt(a * b) if log else (a + b) * 0.5


def histogram(df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = (),
              log: bool = False, last_closed: bool = True) -> DataFrame:
    """Counts and densities per bin with empty bins present; values out of range are dropped."""
    counts = (
        df.withColumn("bin", bin_of(value, edges, log, last_closed)).filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    filled = numbered(totals, len(edges) - 1).join(counts, [*by, "bin"], "left")
    width = _edge_at(edges, F.col("bin") + 1) - _edge_at(edges, F.col("bin"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return filled.select(*by, "bin", midpoints(edges, log=log).alias("x"), n.alias("n"),
                         F.try_divide(n.cast("double"), F.col("_total") * width).alias("density"))


def shares(df: DataFrame, count: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Each row's part of its group's total. For tables already reduced to one row per bin or value."""
    total = F.sum(count).over(Window.partitionBy(*(by or [F.lit(0)])))
    return df.withColumn(name, F.col(count) / total)


def binned_share(df: DataFrame, value: str, width: float, upper: float, by: Sequence[str] = ()) -> DataFrame:
    """Share per bin of fixed width over (0, upper]; a value at ``upper`` opens its own bin."""
    x = F.col(value)
    counts = df.filter((x > 0) & (x <= upper)).groupBy(
        *by, F.floor(x / F.lit(width)).alias("bin")).agg(F.count("*").alias("n"))
    return shares(counts, "n", by, "y").select(
        *by, ((F.col("bin") + 0.5) * width).alias("x"), "y")


def pmf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return shares(counts, "n", by, "p").drop("n")


def kde(df: DataFrame, value: str, lo: float | Column, hi: float | Column | None, points: int = 500,
        by: Sequence[str] = (), factor: float | str = "scott", min_values: int = 2,
        hi_quantile: float | None = None, zero_upto: float | None = None,
        with_stats: bool = False, weight: str | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid, per group.

    Equal values are merged with their counts first, so the kernel sum grows with distinct
    values. Each value is spread over the grid points it can reach: beyond 40 bandwidths
    the kernel is exactly zero in double precision. The sums are combined per task before
    the shuffle, so at most ``points`` rows per group and task travel.
    ``lo``/``hi`` may be expressions over the group keys; ``hi_quantile`` sets the upper end
    from the data; ``weight`` is a whole-number count of equal observations per row. Groups
    with too few or only equal values give no rows.
    """
    by = list(by)
    count = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    vals = (
        df.select(*by, finite_or_null(F.col(value).cast("double")).alias("_v"), count.alias("_n"))
        .filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    )
    size = vals.groupBy(*by).agg(F.sum("_n").alias("_size"), F.count("*").alias("_distinct"),
                                 (F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")).alias("_mean"))
    dev = F.col("_v") - F.col("_mean")
    shape = attach(vals, size, by).groupBy(*by).agg(
        F.max("_size").alias("_size"), F.max("_distinct").alias("_distinct"), F.max("_mean").alias("_mean"),
        F.sqrt(F.try_divide(F.sum(F.col("_n") * dev * dev), F.max("_size") - 1)).alias("_sd"),
    ).filter((F.col("_size") >= min_values) & (F.col("_distinct") >= 2))
    if hi_quantile is not None:
        top = exact_quantiles(vals, "_v", {"_hi": hi_quantile}, by, "_n")
        shape = attach(shape, top, by)
    else:
        shape = shape.withColumn("_hi", hi if isinstance(hi, Column) else F.lit(float(hi)))
    scale = F.pow(F.col("_size").cast("double"), F.lit(-0.2)) if factor == "scott" else F.lit(float(factor))
    params = (
        shape.withColumn("_lo", lo if isinstance(lo, Column) else F.lit(float(lo)))
        .withColumn("_h", scale * F.col("_sd"))
        .withColumn("_step", (F.col("_hi") - F.col("_lo")) / (points - 1))
        .select(*by, "_size", "_mean", "_lo", "_hi", "_h", "_step")
    )
    reach = 40 * F.col("_h")
    first = F.greatest(F.lit(0), F.ceil((F.col("_v") - reach - F.col("_lo")) / F.col("_step"))).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("_v") + reach - F.col("_lo")) / F.col("_step"))).cast("int")
    x = F.when(F.col("k") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("k") * F.col("_step"))
    z = (x - F.col("_v")) / F.col("_h")
    parts = (
        attach(spread(vals, "_v"), params, by).withColumn("_a", first).withColumn("_b", last).filter("_a <= _b")
        .withColumn("k", F.explode(F.sequence("_a", "_b")))
        .groupBy(*by, "k").agg(F.sum(F.col("_n") * F.exp(z * z * -0.5)).alias("_part"))
    )
    grid = numbered(params, points, "_k").withColumn("k", F.col("_k").cast("int"))
    summed = grid.join(parts, [*by, "k"], "left")
    density = F.coalesce("_part", F.lit(0.0)) / (F.col("_size") * F.col("_h") * math.sqrt(2 * math.pi))
    if zero_upto is not None:
        density = F.when(x <= zero_upto, 0.0).otherwise(density)
    extra = [F.col("_mean").alias("mean"), F.col("_size").alias("n")] if with_stats else []
    return summed.select(*by, x.alias("x"), density.alias("density"), *extra)


# --- two dimensions --------------------------------------------------------------

def histogram2d(df: DataFrame, x: str, y: str, edges: Sequence[float], by: Sequence[str] = (),
                log: bool = True) -> DataFrame:
    """Occupied cells of a square grid with their counts."""
    return (
        df.select(*by, bin_of(x, edges, log).alias("ix"), bin_of(y, edges, log).alias("iy"))
        .filter(F.col("ix").isNotNull() & F.col("iy").isNotNull())
        .groupBy(*by, "ix", "iy").agg(F.count("*").alias("n"))
    )


def class_breaks(cells: DataFrame, by: Sequence[str] = (), classes: int = 5) -> DataFrame:
    """Class boundaries of the occupied cells' counts: quantiles, or even steps when those repeat.

    The input is one row per grid cell, so its size is bounded by the grid.
    """
    qs = [i / classes for i in range(classes + 1)]
    agg = cells.groupBy(*by).agg(F.percentile("n", [float(q) for q in qs]).alias("_q"),
                                 F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    even = F.array(*[F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / classes) for i in range(classes + 1)])
    chosen = F.when(F.size(F.array_distinct("_q")) == classes + 1, F.col("_q")).otherwise(even)
    return agg.select(*by, F.posexplode(chosen).alias("k", "boundary"))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 40) -> DataFrame:
    """Counts per hexagon of a regular lattice over the data's bounding box.

    Two interleaved rectangular lattices hold the hexagon centres; a point belongs to the
    nearer one. ``hx``/``hy`` are lattice coordinates (whole or half).
    """
    ny = int(gridsize / math.sqrt(3))
    pts = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    box = pts.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
                  F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    fx = F.try_divide(F.col("_x") - F.col("_x0"), F.col("_x1") - F.col("_x0")) * gridsize
    fy = F.try_divide(F.col("_y") - F.col("_y0"), F.col("_y1") - F.col("_y0")) * ny
    scaled = attach(pts, box, ()).select(fx.alias("fx"), fy.alias("fy"))
    ax, ay = F.floor(F.col("fx") + 0.5), F.floor(F.col("fy") + 0.5)
    bx, by_ = F.floor("fx") + 0.5, F.floor("fy") + 0.5
    gap = lambda cx, cy: (F.col("fx") - cx) * (F.col("fx") - cx) + 3.0 * (F.col("fy") - cy) * (F.col("fy") - cy)
    on_a = gap(ax, ay) < gap(bx, by_)
    return scaled.select(
        F.when(on_a, ax.cast("double")).otherwise(bx).alias("hx"),
        F.when(on_a, ay.cast("double")).otherwise(by_).alias("hy"),
    ).groupBy("hx", "hy").agg(F.count("*").alias("n"))


def value_clamp(df: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.02, high: float = 0.98) -> DataFrame:
    return exact_quantiles(df, value, {"lo": low, "hi": high}, by)


def support_trim(curves: DataFrame, by: Sequence[str], x: str = "x", density: str = "density",
                 floor: float = 0.005, pad: float = 0.08, min_span: float = 0.25) -> DataFrame:
    """Range of x where the curves of a group have mass, padded."""
    peak = curves.groupBy(*by).agg(F.max(density).alias("_peak"))
    span = attach(curves, peak, by).filter(F.col(density) > F.col("_peak") * floor).groupBy(*by).agg(
        F.min(x).alias("_a"), F.max(x).alias("_b"))
    margin = pad * F.greatest(F.col("_b") - F.col("_a"), F.lit(min_span))
    return span.select(*by, (F.col("_a") - margin).alias("lo"), (F.col("_b") + margin).alias("hi"))


def span_matrix(levels: DataFrame, rows: str, cols: str, count: str, columns: Sequence[int] | None = None) -> DataFrame:
    """Long to wide with zero fill and log10(count + 1)."""
    wide = levels.groupBy(rows)
    wide = (wide.pivot(cols, list(columns)) if columns else wide.pivot(cols)).agg(F.sum(count))
    names = [c for c in wide.columns if c != rows]
    return wide.fillna(0, names).select(rows, *[F.log10(F.col(f"`{c}`") + 1).alias(f"s{c}") for c in names])
