"""Spark session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch between the JVM and Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def session(name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer; `conf` overrides.

    Shuffle partitions are left to the cluster's own setting: adaptive execution coalesces small ones and splits
    skewed ones.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of what the session runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
