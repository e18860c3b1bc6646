"""Connected components of a table of links, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: link neighbours of a node to the least id around it.

    ``large`` moves greater neighbours, else the node and its smaller neighbours move. The least id is found by
    an aggregate that combines per task; a node with very many neighbours is split by the join.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with, over any way) of every node in ``edges(a, b)``.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of
    the number of nodes; two numbers a round reach the driver.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, mark = None, print_of(now)
    while mark != was:
        now = staged(_stars(_stars(now, True), False), "links")
        was, mark = mark, print_of(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
