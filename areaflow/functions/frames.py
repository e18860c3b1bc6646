"""DataFrame helpers: attaching group statistics, exact quantiles, rounding, domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Add per-group statistics (one row per group) to every row.

    A plain equi-join: Spark broadcasts statistics whose size it has seen to be small, and splits
    hot keys of others. ``few`` forces the broadcast; only for keys whose combinations are listed in
    the job's parameters.
    Without keys the single statistics row is read as a scalar subquery.
    """
    if by:
        return df.join(F.broadcast(stats) if few else stats, list(by), how)
    # Unpacked by a generator, so the subquery stands in the plan once, not once per column.
    row = stats.select(F.struct(*stats.columns).alias("s"))
    return df.select("*", F.inline(F.array(row.scalar())))


def zscore(df: DataFrame, values: Sequence[str], by: Sequence[str] = (),
           suffix: str = "_z", flat: float | None = 0.0) -> DataFrame:
    """Standardise columns in a group by population sd; ``flat`` is used where nothing varies."""
    stats = df.groupBy(*by).agg(
        *[F.avg(v).alias(f"_m_{v}") for v in values],
        *[F.stddev_pop(v).alias(f"_s_{v}") for v in values],
    )
    out = attach(df, stats, by)
    for v in values:
        z = F.when(F.col(f"_s_{v}") > 0, (F.col(v) - F.col(f"_m_{v}")) / F.col(f"_s_{v}"))
        out = out.withColumn(f"{v}{suffix}", z if flat is None else F.coalesce(
            z, F.when(F.col(v).isNotNull(), F.lit(float(flat)))))
    return out.drop(*[f"_m_{v}" for v in values], *[f"_s_{v}" for v in values])


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key under a total order.

    Filtering ``row_number`` to 1 lets Spark keep a single row per key and map task
    before the shuffle (window group limit), so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for rows that are few bytes but much work.

    Adaptive execution merges small shuffle partitions by size alone; a fixed count keeps
    the following stage parallel.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def exact_quantiles_of(df: DataFrame, wanted: Mapping[str, Mapping[str, float]], by: Sequence[str] = (),
                       accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles with linear interpolation of several columns, in two passes over the rows.

    ``wanted`` lists, for each column, result names and their shares. A sketch gives two bounds around every wanted rank; its
    error is at most ``1 / accuracy`` of the rows, and the bounds leave three times that on either side.
    Then rows below, between and above the bounds are only counted, per task first, and just the values within bounds are kept and
    sorted: some 6 in ``accuracy`` of a group (all of one shorter than ``accuracy``), and equal values as one. A rank outside its bounds would
    be an error, never a wrong value. Nulls and NaN are left out; a group without values in any column is absent.
    Only groups of ``accuracy`` rows or more have bounds, so these are at most one row for as many of the input; they are broadcast, and
    no row travels before it is counted. A shuffled join would bring each group whole to one task.
    """
    shares = sorted({p for names in wanted.values() for p in names.values()})
    one = lambda i, c: F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
    long = df.select(*by, F.inline(F.array(*[one(i, c) for i, c in enumerate(wanted)]))).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = [*by, "_c"]
    around = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-3 / accuracy, 3 / accuracy)]
    bounds = long.groupBy(*keys).agg(F.percentile_approx("_v", around, accuracy).alias("_q"), F.count("*").alias("_size")).filter(
        F.col("_size") >= accuracy)
    # Bounds at the ends lie beyond every value, and so do those of a group too short for a margin of two rows: it has none.
    bound = lambda k, end, name: f"CASE WHEN _q IS NULL OR {0.0 < around[k] < 1.0} = false THEN {end} ELSE _q[{k}] END AS {name}"
    low = [bound(2 * i, "-double('inf')", f"l{i}") for i in range(len(shares))]
    high = [bound(2 * i + 1, "double('inf')", f"h{i}") for i in range(len(shares))]
    named = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_q")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    seen = long.join(F.broadcast(named), same, "left").selectExpr(*keys, "_v", *low, *high)
    within = " OR ".join(f"_v BETWEEN l{i} AND h{i}" for i in range(len(shares)))
    passed = " + ".join(f"CAST(_v > h{i} AS INT) + CAST(_v >= l{i} AS INT)" for i in range(len(shares)))
    counted = seen.selectExpr(*keys, "_v", f"{passed} AS _slot", f"{within} AS _in").groupBy(
        *keys, "_slot", "_in", F.when(F.col("_in"), F.col("_v")).alias("_value")).agg(
        F.count("*").alias("_n"), F.max("_v").alias("_o"))
    run = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = counted.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_hi", F.sum("_n").over(run)).withColumn(
        "_lo", F.col("_hi") - F.col("_n"))
    picks, outs = [], []
    for i, names in enumerate(wanted.values()):
        for name, p in names.items():
            pos = (F.col("_total") - 1) * F.lit(float(p))
            at = lambda r, i=i: (F.col("_c") == i) & (F.col("_lo") <= r) & (r < F.col("_hi"))
            value = F.when(F.col("_in"), F.col("_value")).otherwise(F.raise_error(F.lit("a rank lies outside its bounds")).cast("double"))
            k = F.floor(pos)
            picks += [F.max(F.when(at(k), value)).alias(f"_a_{name}"), F.max(F.when(at(k + 1) & (pos > k), value)).alias(f"_b_{name}"),
                      F.max(F.when(F.col("_c") == i, pos - k)).alias(f"_f_{name}")]
            first = F.col(f"_a_{name}")
            outs.append((first + F.col(f"_f_{name}") * (F.coalesce(f"_b_{name}", first) - first)).alias(name))
    return spans.groupBy(*by).agg(*picks).select(*by, *outs)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), weight: str | None = None,
                    accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles of one column; with ``weight``, each row counts so many times."""
    if weight is None:
        return exact_quantiles_of(df, {value: probs}, by, accuracy)
    return _weighted_quantiles(df, value, probs, by, weight)


def _weighted_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str], weight: str,
                        buckets: int = 64) -> DataFrame:
    """Exact weighted percentiles without gathering a group in one task.

    Values are first reduced to distinct values with their weights. A sketch of the distinct values
    only chooses cut points; exact weights between them then tell which buckets hold
    the wanted ranks, and only those are sorted.
    """
    n = F.sum(weight)
    vals = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(n.cast("long").alias("_n"))
        .filter("_n > 0")
    )
    cuts = vals.groupBy(*by).agg(
        F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"),
        F.sum("_n").alias("_total"),
    )
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = attach(spread(vals, *by, "_v"), cuts, by).select(*by, "_v", "_n", "_total", below.alias("_bucket"))
    ranks = F.array(*[F.floor((F.col("_total") - 1) * F.lit(float(p))) for p in probs.values()])
    # At most ``buckets`` rows per group reach this window; only buckets with a wanted rank stay.
    offsets = (
        placed.groupBy(*by, "_bucket", "_total").agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(
            Window.partitionBy(*by).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .filter(F.exists(ranks, lambda k: (k + 1 >= F.col("_before")) & (k < F.col("_upto"))))
        .select(*by, "_bucket", "_before")
    )
    wanted = placed.join(offsets, [*by, "_bucket"])
    run = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    spans = wanted.withColumn("_hi", F.col("_before") + F.sum("_n").over(run)).withColumn(
        "_lo", F.col("_hi") - F.col("_n"))
    picks, outs = [], []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        k = F.floor(pos)
        at = lambda r: (F.col("_lo") <= r) & (r < F.col("_hi"))
        picks += [F.max(F.when(at(k), F.col("_v"))).alias(f"_a_{name}"),
                  F.max(F.when(at(k + 1), F.col("_v"))).alias(f"_b_{name}")]
        low, high = F.col(f"_a_{name}"), F.coalesce(F.col(f"_b_{name}"), F.col(f"_a_{name}"))
        outs.append((low + (pos - k) * (high - low)).alias(name))
    return spans.groupBy(*by).agg(*picks, F.max("_total").alias("_total")).select(*by, *outs)


def complete(df: DataFrame, domain: DataFrame, keys: Sequence[str],
             fill: dict[str, object] | None = None) -> DataFrame:
    """Every row of a fixed domain, with values where present and ``fill`` elsewhere."""
    out = domain.join(df, list(keys), "left")
    return out.fillna(fill) if fill else out


def numbered(df: DataFrame, n: int, name: str = "bin") -> DataFrame:
    """Rows 0..n-1 for each row of ``df`` (generated in place, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; used where results are compared or published."""
    return df.select(*[
        F.round(F.col(f.name).cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
