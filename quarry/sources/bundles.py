"""Several outputs of one run under one folder, with a manifest that is written last: what a run that broke off has left is never read.

Counts and digests in the manifest are those of the written files, read again, so it says what is there. (Spark's observed
metrics would save that pass, but a session that has used them can't serialise Spark ML's models any more.)
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "name string, format string, n_rows long, digest long, columns string"


class Bundle:
    """Outputs by name: add() each, then close(); read() and manifest() need a closed one. A folder that is closed takes no more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._rows = spark, path.rstrip("/"), []

    def _closed(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def add(self, name: str, rows: DataFrame, kind: str = "parquet", by: tuple[str, ...] = ()) -> Bundle:
        """Writes rows as an output (parquet, json or csv), parted by columns; what an earlier run left under the name is written over."""
        if self._closed():
            raise ValueError(f"{self.path} is complete")
        writer = rows.write.mode("overwrite").format(kind)
        (writer.partitionBy(*by) if by else writer).save(f"{self.path}/{name}")
        there = self.spark.read.format(kind).schema(rows.schema).load(f"{self.path}/{name}")
        n, digest = there.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 31))), F.lit(0))).first()
        self._rows.append((name, kind, n, digest, rows.schema.json()))
        return self

    def close(self) -> Bundle:
        """Writes the manifest, after which the outputs can be read."""
        self.spark.createDataFrame(self._rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/_manifest")
        return self

    def manifest(self) -> DataFrame:
        """(name, format, n_rows, digest, columns) of each output."""
        if not self._closed():
            raise ValueError(f"{self.path} is not complete")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/_manifest")

    def read(self, name: str) -> DataFrame:
        """An output with the columns that it was written with."""
        found = self.manifest().filter(F.col("name") == name).collect()
        if not found:
            raise KeyError(name)
        return self.spark.read.format(found[0]["format"]).schema(StructType.fromJson(json.loads(found[0]["columns"]))).load(f"{self.path}/{name}")


def windowed(bundle: Bundle, windows: DataFrame, split: str = "split") -> Bundle:
    """Token windows, parted by split."""
    return bundle.add("windowed", windows, by=(split,))


def embedded(bundle: Bundle, rows: DataFrame, split: str = "split") -> Bundle:
    """window_id, function_group_id, label and embedding, parted by split."""
    return bundle.add("embeddings", rows.select("window_id", "function_group_id", "label", "embedding", split), by=(split,))


def predicted(bundle: Bundle, rows: DataFrame, models: list[str], key: str, split: str = "split") -> Bundle:
    """(key, prob, label) of each model and split, in one pass over the rows with all models' columns."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("prob")) for m in models])).alias("x")
    return bundle.add("predictions", rows.select(key, "label", split, each).select(key, "x.model", split, "x.prob", "label"), by=("model", split))


def calibrated(bundle: Bundle, rows: DataFrame, key: str, raw: str, made: str) -> Bundle:
    """(key, raw_score, calibrated_score, label)."""
    return bundle.add("calibrated", rows.select(key, F.col(raw).alias("raw_score"), F.col(made).alias("calibrated_score"), "label"))


def aggregated(bundle: Bundle, records: DataFrame, key: str, slim: list[str], breakdowns: dict[str, DataFrame]) -> Bundle:
    """Function records whole as JSON lines, their slim columns as Parquet, and breakdowns as CSV. The records should be a written table, as all outputs read it."""
    bundle.add("records", records, "json").add("slim", records.select(key, *slim))
    for name, rows in breakdowns.items():
        bundle.add(name, rows.coalesce(1), "csv")
    return bundle
