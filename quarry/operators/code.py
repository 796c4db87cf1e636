"""Code files line by line: comments of single lines removed with their line numbers, functions cut out by their braces."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import small_batches

#: Words that lead no function's header.
NOT_NAMES = frozenset("if else for while do switch case default catch try return goto break continue sizeof namespace class struct union enum typedef template using".split())
WORD = re.compile(r"[A-Za-z_]\w*")
PASSED = re.compile(r"\s*(?:#|//|/\*|\*)")
NOTES = re.compile(r"/\*.*?\*/|//[^\n]*", re.DOTALL)


def kept_lines(text: str) -> list[tuple[int, str]]:
    """(number from 1, line) of lines that aren't blank without their comments; of `/*` and `//`, the first in a line counts.

    A string is not known as such; an open block goes on over lines.
    """
    out, inside = [], False
    for number, line in enumerate(text.splitlines(), 1):
        parts, at = [], 0
        while at < len(line):
            if inside:
                end = line.find("*/", at)
                if end < 0:
                    break
                inside, at = False, end + 2
                continue
            block, rest = line.find("/*", at), line.find("//", at)
            if rest >= 0 and not 0 <= block < rest:
                parts.append(line[at:rest])
                break
            if block < 0:
                parts.append(line[at:])
                break
            parts.append(line[at:block])
            inside, at = True, block + 2
        left = "".join(parts).rstrip()
        if left.strip():
            out.append((number, left))
    return out


def _name(header: str) -> str | None:
    """The function that a header up to its brace defines; null if it defines none."""
    text = NOTES.sub("", " ".join(filter(None, map(str.strip, header.split("\n"))))).strip()
    before = text.partition("{")[0].strip() if "{" in text else ""
    first, last = before.find("("), before.rfind("(")
    if first < 1 or before.rfind(")") < last:
        return None
    if before.lower().startswith("extern ") and '"' in before[:last] and "(" not in before[:last]:
        return None
    lead, own = WORD.findall(before[:last]), WORD.findall(before[:first])
    if not own or not lead or {lead[-1].lower(), own[-1].lower()} & NOT_NAMES or re.match(r"(?i)typedef\s+(?:struct|union|enum)\b", before):
        return None
    return own[-1]


def functions(text: str) -> list[tuple[str, str, int, int]]:
    """(name, code without preprocessor lines, first line, last line) of each function of a C or C++ file."""
    lines = text.splitlines()
    idle = [not x.strip() or bool(PASSED.match(x)) for x in lines]
    depth = [x.count("{") - x.count("}") for x in lines]
    out, at = [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and (idle[end] or not ("{" in lines[end] or ";" in lines[end])):
            end += 1
        if idle[at] or end == len(lines) or "{" not in lines[end]:
            at += 1
            continue
        defined = _name("\n".join(x for x, no in zip(lines[at : end + 1], idle[at : end + 1], strict=True) if not no))
        if defined is None:
            at = end + 1
            continue
        level, stop = depth[end], end
        while level and stop + 1 < len(lines):
            stop += 1
            level += depth[stop]
        if level:
            at += 1
            continue
        code = "\n".join(x for x in lines[at : stop + 1] if not x.lstrip().startswith("#")).strip()
        head, bracket, _ = NOTES.sub("", lines[at]).partition("{")[0].partition("(")
        own = WORD.findall(head) if bracket else []
        out.append((own[-1] if own else f"function_{len(out) + 1}", code, at + 1, stop + 1))
        at = stop + 1
    return out


def extracted(files: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """A row for each function of each file: id_col, function_id ({id}_fn{n}, from 1), name, code, start_line, end_line. A null text has none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[str, list] = {c: [] for c in ("i", "function_id", "name", "code", "start_line", "end_line")}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, (name, code, a, b) in enumerate(functions(t.as_py() or ""), 1):
                    if code:
                        for c, v in zip(got, (i, f"{i}_fn{n}", name, code, a, b), strict=True):
                            got[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(got["i"], batch.column(0).type), *(pa.array(got[c], pa.string()) for c in ("function_id", "name", "code")), *(pa.array(got[c], pa.int32()) for c in ("start_line", "end_line"))], list(got))

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, code_col).mapInArrow(rows, f"i {kind}, function_id string, name string, code string, start_line int, end_line int").withColumnRenamed("i", id_col)


def without_comments_by_line(files: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """id_col, code of the kept lines and line_map, the number in the file of each. A null text has no lines.

    Texts go to Python in small batches, and of a batch the lines of one text at a time are held.
    """
    small_batches(files.sparkSession)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, maps = [], []
            for t in batch.column(1):
                kept = kept_lines(t.as_py() or "")
                code.append("\n".join(x for _, x in kept).strip())
                maps.append(pa.array([n for n, _ in kept], pa.int32()))
            ends = np.cumsum([0, *map(len, maps)], dtype=np.int32)
            line_map = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(maps) if maps else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), line_map], ["i", "code", "line_map"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, code_col).mapInArrow(rows, f"i {kind}, code string, line_map array<int>").withColumnRenamed("i", id_col)


def file_lines(found: DataFrame, start: str = "start", end: str = "end", line_map: str = "line_map") -> DataFrame:
    """Line numbers of cleaned code turned into those of the file; places beyond the map become its nearest."""
    at = lambda c: F.when(F.size(line_map) > 0, F.element_at(line_map, F.greatest(F.lit(1), F.least(F.size(line_map), F.col(c))).cast("int"))).otherwise(F.col(c))
    return found.withColumns({f"file_{start}": at(start), f"file_{end}": at(end)})
