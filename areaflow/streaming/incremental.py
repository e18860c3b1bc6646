"""Daily files as a stream: each new file is aggregated once, whenever the job is run.

The stream's checkpoint remembers which files were taken, and a replayed batch overwrites
its own folder, so partial results are neither lost nor counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def aggregate_new_files(spark: SparkSession, source: str, aggregate: Callable[[DataFrame], DataFrame], out: str,
                        checkpoint: str, files: str = "*", files_per_batch: int = 1000) -> int:
    """Aggregate the files that arrived since the last run; returns the number of batches.

    ``aggregate`` must be a sum-like reduction whose results can be added up later.
    """
    schema = spark.read.option("pathGlobFilter", files).parquet(source).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    batches = []

    def write(batch: DataFrame, batch_id: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")
        batches.append(batch_id)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return len(batches)
