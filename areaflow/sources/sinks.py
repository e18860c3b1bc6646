"""Sinks: result tables, daily partitions, the disclosure switch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", small: bool = False) -> None:
    """Replace a table. ``small`` marks published result tables: ordered by their keys over as few files as their size allows.

    The order is a range partitioning, of which adaptive execution merges what is small: a short table is
    one file, a long one several in order, and no task writes a table of any size alone.
    """
    keys = [n for n, t in df.dtypes if t in ("string", "int", "bigint", "date")]
    out = df
    if small:
        out = df.orderBy(*keys) if keys else df.hint("rebalance")
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], out: str, private: Sequence[str] = (), release_private: bool = False,
                 fmt: str = "csv") -> list[str]:
    """Write result tables under ``out``; tables about single persons only when asked for."""
    names = [n for n in tables if release_private or n not in private]
    for n in names:
        write_table(tables[n], f"{out.rstrip('/')}/{n}", "parquet" if n in private else fmt, n not in private)
    return names


def write_daily(df: DataFrame, path: str) -> None:
    """Write or replace exactly the days present in ``df``.

    Rebalancing groups rows by day for few files per folder and still splits a large day over
    several tasks.
    """
    (df.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def written_days(df_path: str, spark) -> list:
    """Days already written. One value per day folder."""
    try:
        done = spark.read.parquet(df_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r["day"] for r in done.select("day").distinct().collect()]


def incremental_daily(events: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str) -> list:
    """Aggregate the days not written yet and add them to the table of daily partial results.

    ``aggregate`` keeps ``day`` among its keys. Only the list of days (one per calendar day)
    comes to the driver, so the filter on new days prunes the scan of a day-partitioned
    source. Rerunning writes nothing new; rerunning after a failure replaces whole days.
    """
    spark = events.sparkSession
    done = set(written_days(path, spark))
    new = sorted(r["day"] for r in events.select(F.col("day").cast("date").alias("day")).distinct().collect()
                 if r["day"] not in done)
    if new:
        write_daily(aggregate(events.filter(F.col("day").isin(new))), path)
    return new


# --- folders of daily files, with a ledger ---------------------------------------------

def daily_files(spark: SparkSession, source: str, files: str = "*") -> DataFrame:
    """``day`` and a ``digest`` of the names, lengths and times of its files; the files themselves are not opened.

    The day is the date in a file's path, as a ``day`` folder or in its name; files without one are no daily files.
    """
    # Of this source only the listing is used, no content column.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(source)
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return listed.select(F.try_to_date(F.regexp_extract("path", r".*(\d{4}-\d{2}-\d{2})", 1)).alias("day"), entry.alias("e")).filter(
        F.col("day").isNotNull()).groupBy("day").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("e"))), 256).alias("digest"))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of every day."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "day date, digest string")
    return rows.groupBy("day").agg(F.max_by("digest", "run").alias("digest"))


def incremental_folder(spark: SparkSession, source: str, aggregate: Callable[[DataFrame], DataFrame], path: str,
                       files: str = "*") -> list:
    """Aggregate the days of a folder of Parquet files whose files are new or have changed; returns those days.

    Beside the daily partial results lies a ledger of the files each day was made from. A late or replaced
    file changes its day's entry, and the day is done again from all its files. Days come from the listing, so no data is
    read to find them, and only changed days are scanned. The ledger is written last: after a failure the
    same days are simply done again. A day whose files are all gone keeps its results.
    """
    ledger = f"{path.rstrip('/')}-ledger"
    now = daily_files(spark, source, files)
    known = _ledger(spark, ledger).withColumnRenamed("digest", "known")
    changed = now.join(known, "day", "left").filter(~F.col("digest").eqNullSafe(F.col("known"))).select("day", "digest").collect()
    if not changed:
        return []
    days = sorted(r.day for r in changed)  # one value per calendar day
    events = spark.read.option("pathGlobFilter", files).parquet(source)
    if "day" not in events.columns:
        events = events.withColumn("day", F.to_date(F.regexp_extract("_metadata.file_path", r".*(\d{4}-\d{2}-\d{2})", 1)))
    events = events.withColumn("day", F.col("day").cast("date"))
    write_daily(aggregate(events.filter(F.col("day").isin(days))), path)
    entries = spark.createDataFrame([(r.day, r.digest) for r in changed], "day date, digest string")
    entries.withColumn("run", F.current_timestamp()).coalesce(1).write.mode("append").parquet(ledger)
    return days


def merged(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Final sums over daily partial sums."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
