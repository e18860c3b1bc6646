"""Shared by the text operators: row keys, bounded Arrow batches, staged tables, string columns."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.sources.staging import staged

__all__ = ["KEY", "back_to", "batches", "keeps", "keyed", "map_arrow", "partitions", "same_row", "staged"]

#: Name of the row key among the columns that operators hand to each other.
KEY = "row_key"
#: Bytes of text that reach a Python worker at once; a longer single text is a batch of its own.
BATCH_BYTES = 4 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the key of its row, the text (null: empty) and ``columns``; everything else is left behind.

    The key is a hash of id and text, so it is the same whenever a task is run again. Together with
    ``doc_id`` it names a row; rows equal in both are one document and get one result each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias(KEY),
                       text.alias("text"), *[F.col(c) for c in columns])


def same_row(a: str, b: str) -> Column:
    """Equality of two aliases on document id (null equals null) and row key."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.{KEY}") == F.col(f"{b}.{KEY}"))


def back_to(docs: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """Every row of ``docs`` with its result row: columns ``d`` (a struct of all its columns) and ``r``.

    Packing both sides into structs keeps any clash of column names away. Texts are the large side of any size of
    input, so the join is by sorting at all of them: what is shuffled then follows the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("doc_id", text).alias(KEY)).alias("l")
    right = results.select(F.struct("*").alias("r"), "doc_id", KEY).alias("x")
    return left.join(right.hint("merge"), same_row("l", "x"), how)


def batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches sent to Python, so that long texts do not add up.

    Python workers started on this machine also learn where the package lies.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, known)))


#: What a worker keeps between tasks, as functions that drop it, and the operator of its last task.
_KEPT: list[Callable[[], object]] = []
_RAN = {"module": ""}


def keeps(drop: Callable[[], object]) -> None:
    """Name how to drop what a module keeps in a worker."""
    _KEPT.append(drop)


def starts(module: str) -> None:
    """Drop what is kept where the worker's last task was another operator's: workers outlive stages, and what each keeps adds up."""
    if _RAN["module"] != module:
        for drop in _KEPT:
            drop()
        gc.collect()  # encoders and their parts refer to each other
        pa.default_memory_pool().release_unused()
        _RAN["module"] = module


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns a dictionary of columns of the Spark ``schema``."""
    batches(df.sparkSession)
    names, module = arrow_schema(schema), fn.__module__

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts(module)
        for batch in it:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in names], schema=names)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow schema of a Spark DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(seq: Sequence, size: int) -> Iterator[Sequence]:
    for i in range(0, len(seq), size):
        yield seq[i:i + size]
