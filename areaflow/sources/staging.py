"""Intermediate tables written to the shared folder and read back.

A result that several branches use (users, edges, area metrics) is written once as Parquet:
the branches then scan a small columnar table instead of recomputing it from raw events, and
losing executors costs only the running stage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _scratch() -> str:
    """Folder for a local session without a configured one (tests); removed when Python ends."""
    path = tempfile.mkdtemp(prefix="areaflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a scratch folder; on a cluster, whose machines would
    each write to their own disk, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _scratch()


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/areaflow/{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
