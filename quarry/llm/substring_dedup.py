"""Exact substring dedup with fixed-block anchors.

Every text is cut into non-overlapping blocks of 18 words, which are the index; every run of 18 words of every text, at
any place, probes it. A window of 35 words always holds a whole block wherever it lies, so a window that occurs twice has
a run that hits a block of its other occurrence. Hits are extended: the windows around them are compared by 128-bit
fingerprints of their 35 words, and overlapping repeated windows make up the maximal exact repeats. Every word that one
covers is removed; what repeats is judged on the input, so the result doesn't depend on any order.

Documents are grouped into chunks by a hash of the row and of the partition that it is read in, so that a row that very
many repeat is dealt over chunks; docs must come in the same partitions each time it is read, as files do. A chunk sends each run at most twice, packed in byte strings by
ranges of the hash, and gets back which of them are anchors, then which windows repeat. So a passage that a third of all
documents share costs two entries a chunk, no two of its occurrences are ever paired, and work grows as the input does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.links import free
from quarry.llm.words import U, Words, runs

WINDOW = 35
#: Any WINDOW consecutive words hold a whole block when 2 * BLOCK - 1 <= WINDOW.
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in a chunk, and entries in a range of hashes that one task sorts.
CHUNK_BYTES, RANGE_ENTRIES = 2_000_000, 1_000_000
#: Bytes of a packed run hash (its range comes on top) and of a packed window fingerprint.
RUN_BYTES, PRINT_BYTES = 5, 16

SCHEMA = "range int, chunk long, entries binary, blocks binary"


def _inside(words: Words, n: int) -> np.ndarray:
    """Places where a run of n words begins that lies in one text."""
    size = np.diff(words.of)
    count = np.maximum(size - n + 1, 0)
    return np.repeat(words.of[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits that stand for a run: those of its range and RUN_BYTES more."""
    return h >> U(64 - bits - 8 * RUN_BYTES)


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES]).tobytes()


def _unpack(entries: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, RUN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :RUN_BYTES] = raw
    return out.view("<u8").ravel()


def _twice(sorted_: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array to keep so that each value is there twice at most."""
    keep = np.ones(len(sorted_), bool)
    keep[2:] = sorted_[2:] != sorted_[:-2]
    return keep


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    a, b, c, d = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table({"range": pa.array(a, pa.int32()), "chunk": pa.array(b, pa.int64()), "entries": pa.array(c, pa.binary()), "blocks": pa.array(d, pa.binary())})


def _probes(bits: int):
    """For a chunk of texts: every run (each at most twice) and every block, by range."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        words = Words(table.column("text"))
        h = _short(runs(words.hashes(), BLOCK), bits)
        at = _inside(words, BLOCK)
        first = np.repeat(words.of[:-1], np.maximum(np.diff(words.of) - BLOCK + 1, 0))
        blocks = np.unique(h[at[(at - first) % BLOCK == 0]])
        probes = np.sort(h[at])
        probes = probes[_twice(probes)]
        edges = np.arange(1, 1 << bits, dtype=U) << U(8 * RUN_BYTES)
        cut = lambda x: np.split(x, np.searchsorted(x, edges))
        return _table([(r, key[0].as_py(), _pack(p), _pack(b)) for r, (p, b) in enumerate(zip(cut(probes), cut(blocks), strict=True)) if len(p)])

    return of


def _anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For a range: each chunk's runs that are a block somewhere and occur more than once."""
    entries = table.column("entries").to_pylist()
    h = _unpack(entries)
    chunk = np.repeat(np.arange(len(entries)), [len(e) // RUN_BYTES for e in entries])
    blocks = np.unique(_unpack(table.column("blocks").to_pylist()))
    order = np.argsort(h, kind="stable")
    h, chunk = h[order], chunk[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    h, chunk = h[again], chunk[again]
    if not len(h) or not len(blocks):
        return _table([])
    real = blocks[np.minimum(np.searchsorted(blocks, h), len(blocks) - 1)] == h
    h, chunk = h[real], chunk[real]
    if not len(h):
        return _table([])
    order = np.argsort(chunk, kind="stable")
    h, chunk = h[order], chunk[order]
    ids, first = np.unique(chunk, return_index=True)
    chunks = table.column("chunk").to_pylist()
    return _table([(key[0].as_py(), chunks[c], _pack(np.unique(part)), b"") for c, part in zip(ids.tolist(), np.split(h, first[1:]), strict=True)])


def _prints(words: Words) -> np.ndarray:
    """Two 64-bit fingerprints for each window, by where it starts."""
    return np.stack([runs(words.hashes(f), WINDOW, f) for f in (0, 1)], 1)


def _extended(bits: int, print_bits: int):
    """For a chunk of texts and its anchors: the windows around them (each at most twice), by range."""

    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        words = Words(left.column("text"))
        whole = [(U(r) << U(8 * RUN_BYTES)) | _unpack([e]) for r, e in zip(right.column("range").to_pylist(), right.column("entries").to_pylist(), strict=True)]
        anchors = np.sort(np.concatenate(whole))
        h = _short(runs(words.hashes(), BLOCK), bits)
        hit = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
        before = np.cumsum(np.append(0, hit))
        at = _inside(words, WINDOW)
        at = at[before[at + WINDOW - BLOCK + 1] > before[at]]
        if not len(at):
            return _table([])
        prints = _prints(words)[at]
        prints = prints[np.lexsort((prints[:, 1], prints[:, 0]))]
        keep = np.ones(len(prints), bool)
        keep[2:] = (prints[2:] != prints[:-2]).any(1)
        prints = prints[keep]
        parts = np.split(prints, np.searchsorted(prints[:, 0], np.arange(1, 1 << print_bits, dtype=U) << U(64 - print_bits)))
        return _table([(r, key[0].as_py(), p.astype("<u8").tobytes(), b"") for r, p in enumerate(parts) if len(p)])

    return of


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """For a range: each chunk's windows that occur more than once."""
    entries = table.column("entries").to_pylist()
    p = np.frombuffer(b"".join(entries), "<u8").reshape(-1, 2)
    chunk = np.repeat(np.arange(len(entries)), [len(e) // PRINT_BYTES for e in entries])
    order = np.lexsort((p[:, 1], p[:, 0]))
    p, chunk = p[order], chunk[order]
    again = np.zeros(len(p), bool)
    again[1:] = (p[1:] == p[:-1]).all(1)
    again[:-1] |= again[1:]
    p, chunk = p[again], chunk[again]
    if not len(p):
        return _table([])
    order = np.argsort(chunk, kind="stable")
    p, chunk = p[order], chunk[order]
    ids, first = np.unique(chunk, return_index=True)
    chunks = table.column("chunk").to_pylist()
    return _table([(key[0].as_py(), chunks[c], part.tobytes(), b"") for c, part in zip(ids.tolist(), np.split(p, first[1:]), strict=True) if len(part)])


def _removed(id_col: str, keep_text: bool):
    """For a chunk of texts and its repeated windows: each text without the words that they cover."""

    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {id_col: left.column("id"), "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
        n = left.num_rows
        gone, of_ = None, None
        if n and right.num_rows:
            words = Words(left.column("text"))
            of_ = words.of
            prints, at = _prints(words), _inside(words, WINDOW)
            found = np.frombuffer(b"".join(right.column("entries").to_pylist()), "<u8").reshape(-1, 2)
            found = found[np.argsort(found[:, 0], kind="stable")]
            mine = prints[at]
            near = np.searchsorted(found[:, 0], mine[:, 0])
            bad = np.zeros(len(mine), bool)
            for step in range(int(np.unique(found[:, 0], return_counts=True)[1].max())):  # more than 1 only where 64 bits collide
                k = np.minimum(near + step, len(found) - 1)
                bad |= (found[k] == mine).all(1)
            cover = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(cover, at[bad], 1)
            np.add.at(cover, at[bad] + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
        for i, text in enumerate(left.column("text")):
            own = (text.as_py() or "").encode().split()
            total, lost = len(own), 0
            if gone is not None:
                mask = gone[of_[i] : of_[i + 1]]
                lost = int(mask.sum())
                if lost:
                    own = [w for w, m in zip(own, mask.tolist(), strict=True) if not m]
            kept = b" ".join(own)
            out["n_words"].append(total)
            out["n_removed"].append(lost)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                out["kept"].append(kept.decode())
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({k: v if k == id_col else pa.array(v, kinds[k]) for k, v in out.items()})

    return of


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) for each document, with keep_text also the kept text.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by single spaces. A null, empty or short text loses
    nothing. Repeated rows are occurrences like any other, so both lose what they share. Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(64, size // CHUNK_BYTES)
    # About a word for each six bytes; windows that need comparing are a part of them.
    bits = max(6, (size // 6 // RANGE_ENTRIES).bit_length())
    print_bits = max(6, bits - 1)
    bits = min(bits, 23)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(chunks)).alias("chunk"))
    grouped = own.groupBy("chunk")
    probes = grouped.applyInArrow(_probes(bits), SCHEMA)
    anchors = written(probes.groupBy("range").applyInArrow(_anchors, SCHEMA), "anchors")
    free(docs)
    windows = grouped.cogroup(anchors.groupBy("chunk")).applyInArrow(_extended(bits, print_bits), SCHEMA)
    repeats = written(windows.groupBy("range").applyInArrow(_repeated, SCHEMA), "repeats")
    free(docs)
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return grouped.cogroup(repeats.groupBy("chunk")).applyInArrow(_removed(id_col, keep_text), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
