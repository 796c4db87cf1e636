"""Benchmark decontamination by the q-gram lemma over diagonal bands.

A benchmark item of m characters that occurs in a text with at most e edits shares (m - q + 1) - q * e character q-grams
with it at least, and they lie on diagonals (place in the text less place in the item) at most e apart from the match's.
All q-grams of a batch of texts are looked up in an index of the benchmark; hits are counted for each text, item and band
of diagonals, where every band overlaps the next by half, so each possible match lies inside one band; regions that reach
the bound are verified by an alignment restricted to the band. No match within the edit budget is lost.

Text and item are compared in lower case with white space as single spaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, texts, written
from quarry.llm.words import U, mixed, powers

#: Greatest length of a q-gram, edits allowed as a share of an item's characters, characters of the benchmark in a broadcast block.
Q, EDITS, BLOCK_CHARS = 8, 0.1, 1_000_000
#: Characters of text that are indexed at once.
TEXT_CHARS = 1 << 20
FILTER_BITS = 22


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def chars(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for each run of q code points."""
    if len(points) < q:
        return np.zeros(0, U)
    base = powers(0x9E3779B97F4A7C15, q + 1)
    power, size, total, done = points.astype(U) + U(1), 1, None, 0
    while size <= q:  # the bits of q say which runs of 1, 2, 4, ... make up its runs
        if q & size:
            part = power[done : len(points) - q + 1 + done]
            total = part if total is None else total * base[size] + part
            done += size
        if 2 * size <= q:
            power = power[: len(power) - size] * base[size] + power[size:]
        size *= 2
    return mixed(total)


@dataclass
class Index:
    """Items of a block of the benchmark with one q: their distinct q-grams in order, and for each the items and places where it occurs."""

    q: int
    ids: list
    items: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray


def index(rows: list[tuple[object, str]], edits: float = EDITS) -> list[Index]:
    """Indexes of items (id, text), one for each q that they need; null and empty items match nothing."""
    by: dict[int, list] = {}
    for i, t in rows:
        c = chars(normal(t or ""))
        if len(c):
            by.setdefault(min(Q, len(c) // (int(len(c) * edits) + 1)), []).append((i, c))
    return [_index(q, kept, edits) for q, kept in sorted(by.items())]


def _index(q: int, kept: list[tuple[object, np.ndarray]], edits: float) -> Index:
    size = np.array([len(c) for _, c in kept])
    allowed = (size * edits).astype(int)
    all_grams = [grams(c, q) for _, c in kept]
    gram = np.concatenate(all_grams)
    item = np.repeat(np.arange(len(kept)), [len(g) for g in all_grams])
    place = np.concatenate([np.arange(len(g)) for g in all_grams])
    order = np.argsort(gram, kind="stable")
    gram, item, place = gram[order], item[order], place[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    known = np.zeros(1 << FILTER_BITS, bool)
    known[gram >> U(64 - FILTER_BITS)] = True
    return Index(q, [i for i, _ in kept], [c for _, c in kept], allowed, size - q + 1 - q * allowed, gram[first], np.append(first, len(gram)), item.astype(np.int64), place.astype(np.int64), known)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits that turn item into a part of text, and where that part ends, on diagonals low to high only.

    Row by row of the item, all diagonals at once; a run of insertions is a running minimum. Places outside the text
    match nothing. Of equal results, the first end counts.
    """
    width = high - low + 1
    far = len(item) + len(text) + 1
    at = np.arange(width) + low
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    step = np.arange(width)
    padded = np.full(len(item) + width + 1, -1, np.int64)
    begin, end = max(low, 0), min(len(text), low + len(padded))
    if end > begin:
        padded[begin - low : end - low] = text[begin:end]
    for i, c in enumerate(item):
        new = row + (padded[i : i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - step) + step
        ends = at + i + 1
        new[(ends < 0) | (ends > len(text))] = far
        row = new
    best = int(row.argmin())
    return int(row[best]), best + low + len(item)


def matched(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best match within the edit budget that lies on diagonals low to high, or None."""
    n, end = aligned(item, text, low - edits, high + edits)
    if n > edits:
        return None
    back = text[max(0, end - len(item) - edits) : end][::-1]
    _, length = aligned(item[::-1], back, 0, 0) if n == 0 else aligned(item[::-1], back, -edits, edits)
    return n, end - length, end


def found(points: list[np.ndarray], idx: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, begin, end): the best match of each item in each text, if any is within the budget."""
    size = np.array([len(p) for p in points])
    ends = np.cumsum(size)
    whole = np.concatenate(points) if points else np.zeros(0, np.uint32)
    h = grams(whole, idx.q)
    at = np.flatnonzero(idx.known[h >> U(64 - FILTER_BITS)])
    g = np.minimum(np.searchsorted(idx.gram, h[at]), len(idx.gram) - 1)
    real = idx.gram[g] == h[at]
    at, g = at[real], g[real]
    doc = np.searchsorted(ends, at, side="right")
    inside = at + idx.q <= ends[doc] if len(at) else at.astype(bool)
    at, g, doc = at[inside], g[inside], doc[inside]
    n = idx.first[g + 1] - idx.first[g]
    if not n.sum():
        return
    which = np.repeat(idx.first[g], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    doc, at = np.repeat(doc, n), np.repeat(at - (ends - size)[doc], n)
    item, diagonal = idx.item[which], at - idx.place[which]
    # Items with too few hits in a text need no bands.
    pair, cells = doc * len(idx.items) + item, len(points) * len(idx.items)
    if cells <= len(pair):
        count = np.bincount(pair, minlength=cells)[pair]
    else:
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        count = count[back]
    enough = count >= idx.bound[item]
    doc, item, diagonal, place = doc[enough], item[enough], diagonal[enough], idx.place[which[enough]]
    if not len(doc):
        return
    # In a band each q-gram of the item counts once: a match shares so many different ones.
    step = 2 * idx.edits[item] + 1
    low, wide = int((diagonal // step).min()) - 1, 1 << int(place.max() + 1).bit_length()
    many = int((diagonal // step).max()) - low + 2
    key = (doc * len(idx.items) + item) * many + diagonal // step - low
    key = np.sort(np.concatenate([key * wide + place, (key - 1) * wide + place]))
    key = key[np.append(True, key[1:] != key[:-1])] // wide
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count, key = np.diff(np.append(first, len(key))), key[first]
    pair, band = key // many, key % many + low
    reach = count >= idx.bound[pair % len(idx.items)]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for p, b in zip(pair[reach].tolist(), band[reach].tolist(), strict=True):
        d, i = divmod(p, len(idx.items))
        if best.get((d, i), (1,))[0] == 0:  # bands come in order, so this one has no earlier match
            continue
        e = int(idx.edits[i])
        width = 2 * e + 1
        m = matched(idx.items[i], points[d], b * width, (b + 2) * width - 1, e)
        if m and (old := best.get((d, i), m)) >= m:
            best[d, i] = min(old, m)
    for (d, i), m in sorted(best.items()):
        yield d, i, *m


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", edits: float = EDITS) -> Iterator[list[Index]]:
    """The indexes of the benchmark's items in blocks of at most BLOCK_CHARS characters (an item longer than that is alone)."""
    rows, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        n = len(r[1] or "")
        if rows and size + n > BLOCK_CHARS:
            if got := index(rows, edits):
                yield got
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if got := index(rows, edits):
        yield got


def batch_hits(column: pa.Array, block: list[Index]) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item's id, edits, begin, end): found() over a column by all indexes of a block, in runs of about TEXT_CHARS characters."""
    run, begin, size = [], 0, 0
    for k, text in enumerate(texts(column)):
        run.append(chars(normal(text)))
        size += len(run[-1])
        if size >= TEXT_CHARS or k + 1 == len(column):
            for idx in block:
                yield from ((begin + d, idx.ids[i], *rest) for d, i, *rest in found(run, idx))
            run, begin, size = [], k + 1, 0


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id_col, item_col, edits, begin, end) for each document and benchmark item that it holds within the edit budget.

    begin and end are places in the normalised text, end exclusive; of several matches of an item in a document, the one
    with the fewest edits, then the first, counts. Each block of the benchmark is broadcast (its size is bounded, one at a
    time) and passes over all whole texts as a map, without a shuffle. Null and empty texts and items match nothing; repeated rows
    and items give rows of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {c: t for c, t in docs.select(id_col).dtypes} | {c: t for c, t in benchmark.select(item_col).dtypes}
    schema = f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds[item_col]}, edits int, begin long, end long"
    narrow = docs.select(F.col(id_col), F.col("text"))

    def over(shared):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(batch_hits(batch.column(1), shared.value))
                columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                items = pa.array(list(columns[1]), from_ddl(kinds[item_col]))
                yield pa.RecordBatch.from_arrays([ids, items, pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], [id_col, item_col, "edits", "begin", "end"])

        return rows

    out, found_, shared = None, None, None
    for block in blocks(benchmark, item_col, edits=edits):
        if shared is not None:  # the block before goes over all texts before the next one is held
            found_ = written(found_, "hits")
            out = found_ if out is None else out.unionByName(found_)
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        found_ = narrow.mapInArrow(over(shared), schema)
    if found_ is None:
        return spark.createDataFrame([], schema)
    return found_ if out is None else out.unionByName(found_)


def from_ddl(kind: str) -> pa.DataType:
    """The Arrow type of an item id."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns: a map for each block of the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")

    def over(shared):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in batch_hits(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        return rows

    shared = None
    for block in blocks(benchmark, edits=edits):
        if shared is not None:
            docs = written(docs, "clean")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        docs = docs.mapInArrow(over(shared), docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
