"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of column expressions cost several driver round trips per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "areaflow", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    return build_session(master=f"local[{cores}]", extra={
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
