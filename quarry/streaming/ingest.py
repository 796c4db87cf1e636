"""Chunks of a corpus as a stream: each new text once, with the index of what was seen kept by the state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import duplicates

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps what it can't hold in memory on disk, for the queries that start inside."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def chunks(spark: SparkSession, path: str, schema, files: int = 2) -> DataFrame:
    """A stream of the Parquet files under a path, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def new_texts(rows: DataFrame, code: str) -> DataFrame:
    """Of a stream, the first row of each text; the index is keyed by digest and grows with the texts."""
    return rows.withColumn("digest", duplicates.digest(F.col(code))).dropDuplicates(["digest"])


def counts(rows: DataFrame, at: str, by: str, window: str, late: str) -> DataFrame:
    """Rows by window and kind; windows close when the watermark has passed them."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"))


def run_to_end(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what there is now and appends it to Parquet files; goes on from the checkpoint when run again."""
    with on_disk_state(rows.sparkSession):
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def near_new(batch: DataFrame, kept: DataFrame, code: str, order: str) -> DataFrame:
    """The rows of a batch that neither repeat nor nearly repeat a kept row or an earlier one of the batch; to be appended to kept.

    order must rise from batch to batch. kept holds the columns of the batch.
    """
    both = kept.unionByName(batch)
    first = duplicates.first_of_equal(both, code, [F.col(order)]).filter("keep").drop("keep", "first")
    near = duplicates.near_dropped(first, code, order, True)
    return first.join(near, first[order] == near["at"], "left_anti").join(kept.select(order), order, "left_anti")
