"""Readers: daily Parquet, Parquet datasets, typed CSV, the OD index; column checks."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from datetime import date
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from areaflow.functions.columns import norm_area_code


class MissingColumns(ValueError):
    """An input table lacks columns an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{name} lacks columns {missing}; it has {df.columns}")
    return df


def _parquet(spark: SparkSession, path: str, files: str, skip_corrupt: bool) -> DataFrame:
    """Columns come from one file; where that is damaged and may be skipped, from the footers of all, read as a job."""
    read = spark.read.option("ignoreCorruptFiles", skip_corrupt).option("pathGlobFilter", files)
    try:
        return read.parquet(path)
    except AnalysisException as e:
        if not skip_corrupt or e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return read.option("mergeSchema", True).parquet(path)


def read_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 skip_corrupt: bool = False) -> DataFrame:
    """All Parquet files under a folder or glob, only the named columns."""
    df = _parquet(spark, path, "*", skip_corrupt)
    return require_columns(df, columns, path).select(*columns) if columns else df


def unread_files(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """``file`` and ``bytes`` of the files below a folder or glob that ``skip_corrupt`` passes over: no row of them can be read.

    Files are listed by name and compared with the files that rows come from. Only footers are read for that, no column.
    A readable file without rows counts as well, as nothing of it reaches a result.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
              .select(F.col("path").alias("file"), F.col("length").alias("bytes")))
    seen = (spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", files)
            .schema("unused string").parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct())
    # Both sides name a file by its URI, one with escapes.
    place = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"^file:/+", "/")
    return listed.withColumn("at", F.regexp_replace("file", r"^file:/+", "/")).join(
        seen.select(place.alias("at")), "at", "left_anti").select("file", "bytes")


def read_daily(spark: SparkSession, path: str, columns: Sequence[str], start: date, end: date,
               files: str = "*", skip_corrupt: bool = False) -> DataFrame:
    """Files or partitions of the days in ``[start, end]``; days without a file are simply absent.

    A ``day`` partition column is used where the data has one. Otherwise the day is the date in
    the file name, and the filter on it prunes files before any is opened.
    """
    df = _parquet(spark, path, files, skip_corrupt)
    require_columns(df, columns, path)
    if "day" not in df.columns:
        df = df.withColumn("day", F.to_date(F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})", 1)))
    return df.filter(F.col("day").between(F.lit(start), F.lit(end))).select(
        *[c for c in columns if c != "day"], F.col("day").cast("date").alias("day"))


def header_groups(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """Column names of every distinct header line among CSV files, with the files that have it. Empty files have none.

    One pass over the lines; a file's header is its first line, kept per file while lines are read. Only headers and
    file names come to the driver.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at")).filter("start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    rows = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(next(csv.reader([r.header.removeprefix("\ufeff")]), []), [unquote(f) for f in r.files]) for r in rows]


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """CSV columns by name with declared types, so codes declared as strings keep leading zeros.

    Files may have their columns in any order and further columns beside them: each distinct header is read by one scan
    of its files. A file that lacks a column is an error that names it. A value that does not fit its type becomes null.
    """
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = None
    for names, files in header_groups(spark, path):
        if missing := [n for n in want.names if n not in names]:
            raise MissingColumns(f"{files[0]} lacks columns {missing}; it has {names}")
        # Names may repeat among columns that are not read.
        places = StructType([StructField(f"_{k}", StringType()) for k in range(len(names))])
        raw = spark.read.option("header", True).schema(places).csv(files)
        part = raw.select(*[F.col(f"_{names.index(f.name)}").try_cast(f.dataType).alias(f.name) for f in want.fields])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], want) if out is None else out


def read_optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV, or no rows of that schema when the path does not exist."""
    try:
        return read_typed_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# Column names of the published index files.
OD_COLUMNS = "user_country string, friend_country string, user_region string, friend_region string, scaled_sci double"


def read_od_index(spark: SparkSession, path: str | list[str], country: str = "US", width: int = 5) -> DataFrame:
    """Sharded CSV of pairwise weights for one country, area codes padded before any comparison."""
    raw = read_typed_csv(spark, path, OD_COLUMNS)
    return raw.filter((F.col("user_country") == country) & (F.col("friend_country") == country)).select(
        norm_area_code("user_region", width).alias("home_area"), norm_area_code("friend_region", width).alias("dest_area"),
        F.col("scaled_sci").alias("weight"))
