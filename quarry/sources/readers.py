"""Readers of the corpus formats: JSON lines, CSV, Parquet, text, COPY dumps, patches, tables in reports, chunks and shards.

All take explicit schemas or read them from the files' own; none reads a file on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import split_name, strip

#: Suffixes of C and C++ files in patches, and letters that stand for signs after a backslash.
C_SUFFIXES = [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"]
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def json_lines(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """An object a line; blank lines are nothing, lines that can't be read are nulls. `split` stands where a row names none."""
    rows = spark.read.schema(schema).json(path)
    return rows if split is None else rows.withColumn("split", F.coalesce("split", F.lit(split)) if "split" in rows.columns else F.lit(split))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header; quoted values may go over lines, quotes in them are doubled. Read in splits."""
    from quarry.sources import csv_splits

    return csv_splits.csv_rows(spark, path, schema)


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN in columns of fractions made null."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    return rows.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if k in ("float", "double") else F.col(f"`{c}`") for c, k in kinds.items()])


def parquet_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only these columns of a Parquet file, with NaN as null."""
    return without_nan(spark.read.parquet(path).select(*columns))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, packed ones too; bytes that are no UTF-8 become the replacement sign."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("line"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of whole small text files."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.make_valid_utf8("value").alias("text"))


def split_of_path(path: Column) -> Column:
    """The split that a file's name or folder tells; null for others."""
    return split_name(F.regexp_extract(path, r"(?:^|[/_.-])(train|valid|test|dev|val)[a-z]*[^/]*$", 1))


def dump_fields(line: str) -> list[str | None]:
    """The fields of a row of a COPY dump: tabs part them, a backslash keeps or names the sign after it, \\N alone is null."""
    if "\\" not in line:
        return list(line.split("\t"))
    if (len(line) - len(line.rstrip("\\"))) % 2:  # a backslash at the end stands for itself
        line += "\\"
    parts = re.findall(r"((?:[^\t\\]|\\.)*)\t", line + "\t", re.DOTALL)
    return [None if p == "\\N" else re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), p, flags=re.DOTALL) for p in parts]


def dump_tables(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The tables of a COPY dump and their columns."""
    heads = text_lines(spark, path).filter("line LIKE 'COPY %'").select(F.regexp_extract("line", r"(?i)^COPY\s+(?:public\.)?(\w+)\s*\(([^)]+)\)\s+FROM\s+stdin\s*;\s*$", 1).alias("t"), F.regexp_extract("line", r"\(([^)]+)\)", 1).alias("c"))
    return {r["t"]: [c.strip().strip('"') for c in r["c"].split(",")] for r in heads.filter("t <> ''").collect()}


def dump_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table of a COPY dump, all columns as text; rows with another number of fields are left out.

    Only the lines that begin or end a table reach the driver; rows are then those of a range of places in the file, so
    a dump of any size is read in splits.
    """
    columns = dump_tables(spark, path).get(table)
    if columns is None:
        raise ValueError(f"no table {table} in {path}")
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    marks = sorted((tuple(r["at"]), r["line"]) for r in lines.filter("line LIKE 'COPY %' OR line = '\\\\.'").collect())
    begin = next(i for i, (_, x) in enumerate(marks) if re.match(rf"(?i)COPY\s+(public\.)?{re.escape(table)}\s*\(", x))
    place = lambda at: F.struct(F.lit(at[0]).alias("file"), F.lit(at[1]).cast("long").alias("block"), F.lit(at[2]).cast("long").alias("row"))
    own = lines.filter(F.col("at") > place(marks[begin][0]))
    if begin + 1 < len(marks):
        own = own.filter(F.col("at") < place(marks[begin + 1][0]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([dump_fields(x.as_py()) for x in batch.column(0)], pa.list_(pa.string()))], ["f"])

    fields = own.filter("line <> ''").select("line").mapInArrow(rows, "f array<string>")
    return fields.filter(F.size("f") == len(columns)).select(*[F.col("f")[i].alias(c) for i, c in enumerate(columns)])


def removed_runs(patch: str, min_lines: int = 3, min_chars: int = 10) -> list[tuple[str, str]]:
    """(file, code) of each run of removed lines in C and C++ files of a patch."""
    out: list[tuple[str, str]] = []
    file, run = None, []

    def close() -> None:
        code = "\n".join(run).strip()
        if file and len(run) >= min_lines and len(code) >= min_chars:
            out.append((file, code))
        run.clear()

    for line in patch.splitlines():
        if line.startswith("diff --git "):
            close()
            parts = line.split()
            name = parts[3].removeprefix("b/") if len(parts) > 3 else ""
            file = name if any(name.lower().endswith(s) for s in C_SUFFIXES) else None
        elif line.startswith(("+++ ", "--- ")) or file is None:
            continue
        elif line.startswith("-") and not line.startswith("---"):
            run.append(line[1:])
        elif line.startswith(("+", " ")):
            close()
    close()
    return out


def patch_snippets(spark: SparkSession, path: str, min_lines: int = 3) -> DataFrame:
    """(commit, file, n, code) of the removed runs of all *.patch files under a path; a file's name is its commit."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(c, f, n, code) for c, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for n, (f, code) in enumerate(removed_runs(t.as_py() or "", min_lines))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["commit", "file", "n", "code"])

    found = files(spark, f"{path}/*.patch").select("stem", "text")
    return found.mapInArrow(rows, "commit string, file string, n int, code string")


def table_rows(lines: DataFrame, *columns: str) -> DataFrame:
    """Rows of a table written with bars (`| a | b |`), by line; rules and rows with another number of cells are left out."""
    cells = F.transform(F.split(F.regexp_replace(strip(F.col("line")), r"^\||\|$", ""), r"\|"), strip)
    rows = lines.filter(F.col("line").rlike(r"^\s*\|")).select(cells.alias("c")).filter((F.size("c") == len(columns)) & ~F.forall("c", lambda x: x.rlike(r"^:?-+:?$")))
    return rows.select(*[F.col("c")[i].alias(c) for i, c in enumerate(columns)]).filter(F.col(columns[0]) != F.lit(columns[0]))


def chunks(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """All chunks that writers.chunks wrote under a name, with `chunk`, the number of each; a filter on it reads only those."""
    return spark.read.parquet(f"{path}/{prefix}")


def shard(spark: SparkSession, path: str, split: str, columns: list[str]) -> DataFrame:
    """These columns of {split}_embeddings.parquet, or of {split}_windowed.parquet where that isn't there (missing ones null)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{split}_embeddings.parquet")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.parquet(f"{path}/{split}_{'embeddings' if there else 'windowed'}.parquet")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def evaluation_rows(rows: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """Code and label where neither is missing nor the code blank."""
    return rows.select(F.col(code).alias("code"), F.col(label).alias("label")).dropna().filter(strip(F.col("code")) != "")
