"""A near-duplicate index that grows with a stream: what was kept, by digest and by band, in buckets that a batch reads only where it meets them.

The index is three Parquet tables, each parted by batch and by a bucket of its key: digests of kept texts, their bands,
and their sets with marks. A batch looks up its digests, its bands, and the marks and sets of what it meets there; the
buckets that it needs become a filter on partitions, so no other file is opened, and nothing that was kept is hashed
again. Then the batch's own rows are settled among themselves. What it keeps is written under its number, and a row in
the log of batches ends it: parts of a batch that was broken off are not in the log, are not read, and are written over
when the batch comes again. So a batch that is repeated gives what it gave before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import duplicates
from quarry.sources.places import shared

#: Buckets of each table; an index keeps the number that it was begun with.
BUCKETS = 64
TABLES = {"digests": "digest binary", "bands": "band long, at long", "sets": "at long, n int, mark array<long>, shingles array<long>"}
LOG = "batch long, n_rows long, n_kept long, buckets int"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class NearIndex:
    """An index in a folder, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        log = self.log().collect() if self._there("log") else []
        self.buckets = log[0]["buckets"] if log else buckets

    def _files(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _there(self, table: str) -> bool:
        system, place = self._files(table)
        return system.exists(place)

    def log(self) -> DataFrame:
        """(batch, n_rows, n_kept, buckets) of the batches that ended."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log") if self._there("log") else self.spark.createDataFrame([], LOG)

    def before(self, table: str, batch: int, met: list[int] | None = None) -> DataFrame:
        """The rows of a table from batches before this one; only the buckets met, if given."""
        done = [r["batch"] for r in self.log().filter(F.col("batch") < batch).select("batch").distinct().collect()]
        columns = TABLES[table]
        if not done or not self._there(table):
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(f"{columns}, batch long, bucket int").parquet(f"{self.path}/{table}").filter(F.col("batch").isin(done))
        return (rows if met is None else rows.filter(F.col("bucket").isin(met))).drop("batch", "bucket")

    def _met(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets of some keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(_bucket(F.col(key), self.buckets)).distinct().collect())

    def _add(self, table: str, rows: DataFrame, key: str, batch: int) -> None:
        system, place = self._files(f"{table}/batch={batch}")
        system.delete(place, True)  # of a run of this batch that was broken off
        dealt = rows.withColumns({"batch": F.lit(batch).cast("long"), "bucket": _bucket(F.col(key), self.buckets)})
        dealt.repartition("bucket").write.partitionBy("batch", "bucket").mode("append").parquet(f"{self.path}/{table}")

    def absorb(self, rows: DataFrame, batch: int, code: str, order: str) -> DataFrame:
        """rows with `reason`: kept, or exact or near where an earlier kept row equals or nearly equals it; kept ones join the index.

        order is a number of its own for each row; earlier are the rows of earlier batches, and in a batch those of smaller
        order. Blank and null codes are kept and not indexed. An empty batch adds nothing but its line in the log.
        """
        marked = duplicates.first_of_equal(rows, code, [F.col(order)])
        first = duplicates._written(marked.filter(F.col("keep") & (F.coalesce(strip(F.col(code)), F.lit("")) != "")).select(F.col(order).alias("at"), F.col(code).alias("code"), F.unhex(duplicates.digest(F.col(code))).alias("digest")), "first")
        exact = duplicates._written(first.join(self.before("digests", batch, self._met(first, "digest")), "digest", "left_semi").select("at"), "exact")
        new = first.join(exact, "at", "left_anti")
        made = duplicates._written(duplicates.banded(duplicates.with_shingles(new, "code"), "at", "shingles", "digest", "shingles"), "sets")
        full = made.drop("bands")
        bands = made.select("at", F.posexplode("bands").alias("i", "h")).select("at", F.xxhash64("i", "h").alias("band"))
        near = self._near_kept(full, bands, batch)
        again = duplicates.dropped(full, duplicates.shared_bands(bands.join(near, "at", "left_anti")))
        gone = duplicates._written(near.unionByName(again).withColumn("__reason", F.lit("near")).unionByName(exact.withColumn("__reason", F.lit("exact"))).withColumnRenamed("at", "__at"), "gone")
        kept = full.join(gone.select(F.col("__at").alias("at")), "at", "left_anti")
        self._add("sets", kept.select("at", "n", "mark", "shingles"), "at", batch)
        self._add("bands", bands.join(kept.select("at"), "at", "left_semi"), "band", batch)
        short = first.join(gone.select(F.col("__at").alias("at")), "at", "left_anti")
        self._add("digests", short.select("digest"), "digest", batch)
        self.spark.createDataFrame([(batch, rows.count(), short.count(), self.buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        out = marked.join(gone, marked["first"] == gone["__at"], "left")
        return out.withColumn("reason", F.when(F.col("__reason") == "near", "near").when(F.col("__reason").isNotNull() | ~F.col("keep"), "exact").otherwise("kept")).select(*rows.columns, "reason")

    def _near_kept(self, sets: DataFrame, bands: DataFrame, batch: int) -> DataFrame:
        """(at) of the batch's rows that a kept row of earlier batches is near to.

        They are first held against the earliest kept row of each of their bands, which settles the copies of what is
        copied most; only what is left meets all kept rows of its bands, as marks.
        """
        known = self.before("bands", batch, self._met(bands, "band")).select("band", F.col("at").alias("a"))
        met = duplicates._written(bands.join(known, "band").select("band", "a", F.col("at").alias("b")), "met")
        heads = met.groupBy("band", "b").agg(F.min("a").alias("a")).select("a", "b").distinct()
        easy = duplicates._written(self._verified(heads, sets, batch), "easy")
        rest = met.join(easy.select(F.col("at").alias("b")), "b", "left_anti").select("a", "b").distinct().join(heads, ["a", "b"], "left_anti")
        return easy.unionByName(duplicates._written(self._verified(rest, sets, batch), "hard"))

    def _verified(self, pairs: DataFrame, sets: DataFrame, batch: int) -> DataFrame:
        """(at): b of the pairs (a of the index, b of the batch) that are near."""
        pairs = duplicates._written(pairs, "pairs")
        kept = self.before("sets", batch, self._met(pairs, "a"))
        return duplicates.near_pairs(pairs, kept, kept, sets, sets).select(F.col("b").alias("at")).distinct()


def run_near_to_end(rows: DataFrame, index: str, out: str, checkpoint: str, code: str, order: str, buckets: int = BUCKETS) -> None:
    """Takes what a stream has now, batch by batch, and writes each row with its reason under `out`; goes on from the checkpoint and the index when run again."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = shared(spark, "batch")
        batch.write.parquet(here)
        found = NearIndex(spark, index, buckets).absorb(spark.read.schema(batch.schema).parquet(here), number, code, order)
        found.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)

    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
