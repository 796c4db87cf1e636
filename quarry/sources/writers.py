"""Writers of chunks, splits, JSON lines and reports of curves, as folders of part files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.places import shared
from quarry.sources.readers import without_nan


def chunks(rows: DataFrame, path: str, prefix: str, n: int, key: str, flush_rows: int = 25_000) -> None:
    """n chunks by a hash of the key, as Parquet files of at most flush_rows rows."""
    dealt = rows.withColumn("chunk", (F.pmod(F.xxhash64(key), F.lit(n)) + 1).cast("int")).repartition("chunk", F.pmod(F.hash(key), F.lit(16)))
    dealt.write.option("maxRecordsPerFile", max(1_000, flush_rows)).partitionBy("chunk").parquet(f"{path}/{prefix}")


def splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split; rows without one are left out."""
    rows.filter(F.col(split).isNotNull()).write.partitionBy(split).parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """An object a line; NaN and infinities are written as nulls."""
    finite = without_nan(rows)
    kinds = {f.name: f.dataType.typeName() for f in finite.schema}
    inf = lambda c: F.abs(F.col(f"`{c}`")) == F.lit(float("inf"))
    finite.select(*[F.when(~inf(c), F.col(f"`{c}`")).alias(c) if k in ("float", "double") else F.col(f"`{c}`") for c, k in kinds.items()]).write.json(path)


def named_files(rows: DataFrame, folder: str) -> int:
    """A file for each row (name, text) of a table of small files; how many there are."""
    from quarry.sources.datasource import opened

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(folder)
        n = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with system.open_output_stream(f"{place}/{name}") as file:
                    file.write((text.as_py() or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    system, place = opened(folder)
    system.create_dir(place, recursive=True)
    return rows.select("name", "text").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def renamed(spark: SparkSession, folder: str, target: str, name: str) -> int:
    """Moves the part files of a folder to `target` as {name with {} as a number}; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(target))
    parts = sorted(f.getPath().getName() for f in system.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        system.rename(path(f"{folder}/{part}"), path(f"{target}/{name.format(i)}"))
    return len(parts)


def in_order(spark: SparkSession, pieces: list[DataFrame], target: str) -> None:
    """Tables of lines (line), one after another, as text files whose names tell the order of the pieces; a piece is written by as many tasks as it has."""
    for k, piece in enumerate(pieces):
        place = shared(spark, "piece")
        piece.select("line").write.text(place)
        renamed(spark, place, target, f"{k:04d}-{{:06d}}.txt")


def curve(rows: DataFrame, path: str, best: DataFrame) -> None:
    """A curve of bounded size as one CSV file, and the chosen row as one text file."""
    rows.coalesce(1).write.csv(f"{path}/curve", header=True)
    best.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in best.columns]).alias("value")).coalesce(1).write.text(f"{path}/chosen")
