"""CSV with line breaks inside quotes, read in splits: whether a split begins inside a quote follows from how many quotes come before it.

Spark reads the lines of each split as it reads any text. A first pass notes for each split whether its quotes are odd in
number, and whether a record ends in it if it begins inside one. Over this table, a row a
split, a running parity says how each split begins, and which split its first record was begun in. The second pass puts
lines together to records in each split; what a split's border cuts is put together from its parts, a row for each record
that is cut. Fields are read by Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is read, beside the lines: which split they are in.
LINE = ["file", "block", "value"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(split, lines) of a task's batches, cut where the split changes."""
    for batch in batches:
        file, block = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(file):
            continue
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(file[a]), int(block[a])), batch.column(2).slice(a, b - a)


def _inside(lines: pa.Array, quote: str, before: bool) -> np.ndarray:
    """Whether each line ends inside a quote, if the first begins inside or not."""
    return (np.cumsum(pc.count_substring(lines, quote).to_numpy()) + before) % 2 == 1


def _noted(lines: DataFrame, quote: str) -> DataFrame:
    """(file, block, odd, odd_end): a split's parity, and whether a line ends after an odd number of its quotes, which is outside for a split that begins inside."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[bool]] = {}
        for split, text in _by_split(batches):
            odd, ends = seen.get(split, (False, False))
            inside = _inside(text, quote, odd)
            seen[split] = bool(inside[-1]), ends or bool(inside.any())
        yield pa.RecordBatch.from_pydict({"file": pa.array([s[0] for s in seen], pa.int64()), "block": pa.array([s[1] for s in seen], pa.int64()), **{n: pa.array([v[i] for v in seen.values()], pa.bool_()) for i, n in enumerate(("odd", "odd_end"))}})

    return lines.mapInArrow(rows, "file long, block long, odd boolean, odd_end boolean")


def _begun(noted: DataFrame) -> DataFrame:
    """(file, block, begins_inside, owner): owner is the split in which the record was begun that a split begins in."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = noted.withColumn("begins_inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    # A record is begun in a split that begins outside quotes, or in which one ends.
    begins = ~F.col("begins_inside") | F.col("odd_end")
    return rows.withColumn("begun", F.when(begins, F.col("block"))).select("file", "block", "begins_inside", F.coalesce(F.last("begun", True).over(before), F.col("block")).alias("owner"))


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(head, value): the records of CSV files as they stand, and whether one is the first of its file. Lines end with \\n or \\r\\n.

    A quote stands only around a whole value, or doubled inside one. Blank lines outside quotes are no records. A quote
    that is never closed makes one record of the rest of its file.
    """
    lines = _lines(spark, path)
    # As many rows as there are splits, of which the driver keeps a task each anyway.
    begun = {(r["file"], r["block"]): (r["begins_inside"], r["owner"]) for r in _begun(_noted(lines, quote)).toLocalIterator()}
    shared = spark.sparkContext.broadcast(begun)
    names = ["file", "owner", "block", "part", "head", "value"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, first, start = None, [], False, False, False
        out: list[tuple] = []

        def fragment(part: int) -> None:
            """What is held as a part of a record that goes on; part 0 stands at a split's beginning, 1 at its end."""
            if held:
                owner = shared.value[now][1] if part == 0 else now[1]
                out.append((now[0], owner, now[1], part, start, "\n".join(held)))
                held.clear()

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))], names)
            out.clear()
            return got

        for split, text in _by_split(batches):
            if split != now:
                if now is not None:
                    fragment(0 if first else 1)
                now, inside = split, shared.value[split][0]
                first, start = inside, split[1] == 0  # inside: what comes first was begun in an earlier split
            ends = _inside(text, quote, inside)
            inside = bool(ends[-1])
            for line, open_ in zip(text.to_pylist(), ends.tolist(), strict=True):
                held.append(line)
                if open_:
                    continue
                if first:
                    fragment(0)
                    first = False
                else:
                    out.append((None, None, None, None, start, "\n".join(held)))
                    held.clear()
                start = False
            if len(out) >= 1000:
                yield batch_of()
        if now is not None:
            fragment(0 if first else 1)
        yield batch_of()

    cut = lines.mapInArrow(rows, "file long, owner long, block long, part int, head boolean, value string")
    whole = cut.filter("file is null").select("head", "value")
    parts = cut.filter("file is not null").groupBy("file", "owner").agg(F.bool_or("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "value"))), lambda x: x["value"]), "\n").alias("value"))
    found = whole.unionByName(parts.select("head", "value"))
    return found.select("head", F.regexp_replace("value", r"\r\z", "").alias("value")).filter(F.trim("value") != "")


def csv_rows(spark: SparkSession, path: str, schema: str, quote: str = '"') -> DataFrame:
    """Rows of CSV files with a header each; quoted values may go over lines, quotes in them are doubled. A file of any size is read in splits."""
    options = {"quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE"}
    return records(spark, path, quote).filter("not head").select(F.from_csv("value", schema, options).alias("r")).select("r.*")
