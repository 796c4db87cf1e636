"""Spark data sources for corpus formats that no built-in reader has: JSON lines over folders with splits told by file names, and patch folders.

    spark.dataSource.register(JsonLines); spark.read.format("quarry_json_lines").schema(...).load(root)

Partitions are ranges of bytes of files (JSON lines) or groups of files (patches), so a file of any size is read by many
tasks. Files are opened inside tasks through Arrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StructType

from quarry.sources.readers import removed_runs

#: Bytes of a partition, and of one read.
PART, STEP = 128 << 20, 8 << 20
#: Bytes that are read at once beyond a range.
BEYOND = 16 << 10
#: Rows of an Arrow batch.
ROWS = 1000
#: Tasks beyond which small ranges share one, up to PART bytes of them.
TASKS = 512
#: Splits that file names tell, in this order, and what a commit's hash at the end of a patch's name is.
SPLITS = ("train", "valid", "test")
HASH = re.compile(r"[0-9a-fA-F]{7,40}")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files right in a folder whose names match, by name; nothing where there is no folder."""
    system, place = opened(path)
    found = system.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and re.fullmatch(pattern, f.base_name))


def split_of(path: str) -> str | None:
    """The first of SPLITS that a file's name holds."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    return next((s for s in SPLITS if s in name), None)


@dataclass
class Range(InputPartition):
    """Bytes of a file, from the first line that begins in them to the last."""

    path: str
    begin: int
    end: int
    split: str | None


@dataclass
class Ranges(InputPartition):
    """Ranges that a task reads one after another."""

    ranges: list[Range]


@dataclass
class Files(InputPartition):
    """Whole small files."""

    paths: list[str]


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _value(x, kind: DataType):
    """A JSON value as a value of a column; null where it can't be one."""
    if isinstance(kind, ArrayType):
        return None if x is None else [_text(v) for v in (x if isinstance(x, list) else [x])]
    if isinstance(kind, IntegerType | LongType):
        return int(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    if isinstance(kind, FloatType | DoubleType):
        return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    return (x if isinstance(x, bool) else None) if isinstance(kind, BooleanType) else _text(x)


class JsonLines(DataSource):
    """Options: path; folders, comma-separated, whose *.jsonl files are read; fallback, files that are read where the folders have none, or folders of such names, all files in which are read; part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "quarry_json_lines"

    def schema(self) -> str:
        return "line string, split string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonLinesReader(schema, self.options)


class JsonLinesReader(DataSourceReader):
    """Rows of JSON objects, a line each; `split` is the file name's where a row has none. Blank lines are nothing, what is no object is a row of nulls."""

    def __init__(self, schema: StructType, options):
        self.wanted, self.arrow = schema, to_arrow_schema(schema)
        self.root, self.part = options["path"].rstrip("/"), int(options.get("part_bytes", PART))
        self.folders, self.fallback = ([x for x in options.get(k, "").split(",") if x] for k in ("folders", "fallback"))

    def partitions(self) -> list[Ranges]:
        files = [(*f, split_of(f[0])) for folder in self.folders for f in listed(f"{self.root}/{folder}", r".*\.jsonl")]
        if not files:
            for name in self.fallback:
                files += [(*f, split_of(name)) for f in listed(self.root, re.escape(name)) or listed(f"{self.root}/{name}", r"[^._].*")]
        ranges = [Range(path, at, min(at + self.part, size), split) for path, size, split in files for at in range(0, size, self.part)]
        each = max(1, min(-(-len(ranges) // TASKS), PART // self.part))
        return [Ranges(ranges[i : i + each]) for i in range(0, len(ranges), each)] or [Ranges([])]

    def _lines(self, part: Range) -> Iterator[bytes]:
        """The lines that begin in a range: a range that doesn't begin with a file goes past the line that it begins in."""
        system, _ = opened(self.root)
        with system.open_input_file(part.path) as file:
            at = max(0, part.begin - 1)
            file.seek(at)
            held, skip = b"", part.begin > 0
            while True:
                # No more than the range needs; past its end a line goes on for a little, mostly.
                block = file.read(min(STEP, max(part.end - at - len(held), BEYOND, len(held))))
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    begin, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                    elif begin < part.end:
                        yield line
                    if at >= part.end:
                        return
                if skip and at + len(held) >= part.end:  # one line goes over the whole range
                    return
                if not block:
                    if held and not skip and at < part.end:
                        yield held
                    return

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for split, line in ((r.split, line) for r in part.ranges for line in self._lines(r)):
            if not line.strip():
                continue
            try:
                got = json.loads(line.decode(errors="replace"))
            except ValueError:
                got = None
            got = got if isinstance(got, dict) else {}
            row = {f.name: _value(got.get(f.name), f.dataType) for f in self.wanted}
            if "split" in row:
                row["split"] = row["split"] or split
            rows.append(row)
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, self.arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


class Patches(DataSource):
    """The removed runs of *.patch files whose names end in a commit's hash. Options: path, min_lines, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "quarry_patches"

    def schema(self) -> str:
        return "method_id string, method_before string, commit_hash string, file_path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PatchReader(schema, self.options)


class PatchReader(DataSourceReader):
    """A row for each run of removed lines of a C or C++ file."""

    def __init__(self, schema: StructType, options):
        self.arrow = to_arrow_schema(schema)
        self.root, self.part, self.least = options["path"].rstrip("/"), int(options.get("part_bytes", PART)), int(options.get("min_lines", 3))

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, n in listed(self.root, r".*\.patch"):
            if size and size + n > self.part:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for path in part.paths:
            commit = path.rsplit("/", 1)[-1].removesuffix(".patch").rpartition("_")
            if not commit[1] or not HASH.fullmatch(commit[2]):
                continue
            name = commit[2].lower()
            with system.open_input_file(path) as file:
                found = removed_runs(file.read().decode(errors="replace"), self.least)
            slug = lambda f: re.sub(r"[^A-Za-z0-9]+", "_", f)[-40:]
            rows = [{"method_id": f"patch_{name[:12]}_{slug(f)}_{i}", "method_before": code, "commit_hash": name, "file_path": f} for i, (f, code) in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, self.arrow)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(JsonLines)
    spark.dataSource.register(Patches)
