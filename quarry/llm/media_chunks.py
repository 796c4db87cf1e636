"""Content-defined chunking of media columns with deduplicated chunks.

A payload is stored as the samples of an 8-bit mono WAV file. The file is cut where a rolling gear hash of the last 32
bytes has leading zeros, so equal passages are cut alike wherever they are. Chunk digests that occur more than once are
found by a Spark aggregate; such chunks go to a chunk store, one row for each digest, deduplicated by Spark, and all
others stay in their medium's row, which keeps the ordered list of its chunks. Reading joins the listed digests with the
store, puts the chunks in order, and verifies the digest of every chunk and of the whole. Equal media are reconstructed
once; their documents get the result by a join on the medium's digest. The file header is a chunk that always stays in
its row: it is small, and a join for its sake would move nearly every medium.

Whether a chunk may be shared is asked of a bitmap of fixed size: a false hit only moves a chunk to the store, a shared
chunk is never missed, and with very many shared chunks the store simply holds most chunks. A second bitmap marks
chunks that occur very often; their rows in the store are repeated SALTS times and their references dealt over these.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, small_batches, texts, written
from quarry.llm.links import bitmap, hit
from quarry.llm.words import U, mixed

#: Payload unit; least, usual (a power of two) and most bytes of a chunk; bytes of a digest; digests a task remembers.
UNIT, LEAST, USUAL, MOST, DIGEST, SEEN = 192, 256, 1024, 8192, 16, 200_000
#: Places over which the references to a chunk are dealt that occurs in more than OFTEN batches.
SALTS, OFTEN = 16, 1_000
#: Frequency of the stored samples.
RATE = 8_000
GEAR = (mixed(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)
HEADER = 44
SEEN_IN_MEDIUM = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean"
FEATURES = f"doc_id long, n_bytes long, {SEEN_IN_MEDIUM}"


def padded(data: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of UNIT."""
    return data + b" " * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file with the payload as its samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of wav()'s file; ValueError for anything else."""
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or n != len(media) - HEADER or size != n + 36:
        raise ValueError("no 8-bit mono WAV file")
    return media[HEADER:]


def cuts(media: bytes) -> list[int]:
    """Ends of a file's chunks. The header is a chunk of its own; chunks have LEAST to MOST bytes, the last may be shorter.

    The gear hash sum(gear[b[i - j]] << j for j < 32) is made by doubling: a run of 2k bytes is two of k bytes.
    """
    h = GEAR[np.frombuffer(media, np.uint8, offset=HEADER)]
    for step in (1, 2, 4, 8, 16):
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    marks = (np.flatnonzero(h >> np.uint32(32 - (USUAL.bit_length() - 1)) == 0) + HEADER + 1).tolist()
    out, at, end = [HEADER], HEADER, len(media)
    while end - at > LEAST:
        k = bisect_left(marks, at + LEAST)
        at = min(marks[k] if k < len(marks) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of a file's chunks in order."""
    at = 0
    for end in cuts(media):
        part = media[at:end]
        yield hashlib.blake2b(part, digest_size=DIGEST).digest(), part
        at = end


def short(digest: bytes) -> int:
    """A digest's first 8 bytes as a signed integer."""
    return int.from_bytes(digest[:8], "little", signed=True)


def feature(payload: bytes) -> str:
    """Mean and energy of the samples around silence (128), peak, and sign changes, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    loud = np.signbit(x)
    return f"mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};peak={int(np.abs(x).max())};crossings={int((loud[1:] != loud[:-1]).sum())}"


def described(media: bytes, declared: bytes, sound: bool) -> tuple:
    """What a medium's stored bytes tell: SEEN_IN_MEDIUM."""
    payload, digest = samples(media), hashlib.sha256(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), digest.hexdigest(), feature(payload), sound and digest.digest() == declared


def _shared(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the short digests of chunks that occur more than once, and of those that occur in over OFTEN batches."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[int, int] = {}
            for text in texts(batch.column(0)):
                for d, _ in islice(chunks(wav(padded(text.encode()))), 1, None):
                    count[short(d)] = count.get(short(d), 0) + 1
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(count), pa.int64()), "n": pa.array([min(n, 2) for n in count.values()], pa.int64())})

    found = docs.select(text_col).mapInArrow(rows, "digest long, n long")
    known = written(found.groupBy("digest").agg(F.sum("n").alias("n"), F.count("n").alias("batches")).filter("n > 1"), "shared")
    both = bitmap(known, "digest"), bitmap(known.filter(F.col("batches") > OFTEN), "digest")
    discard(known)
    return both


def xxhash64_places(keys: list[int], bits: int) -> np.ndarray:
    """The bits of keys, as links.place() has them."""
    return np.array([xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % bits for k in keys], np.int64)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes all texts as media; returns the written tables of media and of shared chunks.

    Media: row (a number of its own), docs (the ids of a batch's documents with this medium and n_bytes), n_bytes,
    media_sha256, list (digest and length of each chunk in order), inline (the chunks that are not in the store, one after
    the other) and outside (the distinct digests that are, each with its place in the store). Store: digest, place, chunk.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(_shared(docs, text_col))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "docs", "n_bytes", "media_sha256", "list", "inline", "outside", "digest", "places", "chunk"]
        ref = pa.struct([("digest", pa.binary()), ("place", pa.int32())])
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(ref), pa.binary(), pa.int32(), pa.binary()]
        shared, often = marks.value
        seen: set[bytes] = set()
        for batch in batches:
            out, found = {}, []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                data = text.encode()
                media = wav(padded(data))
                whole = hashlib.sha256(media).digest()
                if (whole, len(data)) in out:
                    out[whole, len(data)][1].append(doc)
                    continue
                parts = list(chunks(media))
                at = xxhash64_places([short(d) for d, _ in parts], shared.size * 8)
                outside, hot = hit(shared, at), hit(often, at)
                outside[0] = False
                listed = b"".join(d + struct.pack("<I", len(p)) for d, p in parts)
                refs = {d: {"digest": d, "place": row % SALTS if h else 0} for (d, _), o, h in zip(parts, outside, hot, strict=True) if o}
                out[whole, len(data)] = (row, [doc], len(data), whole, listed, b"".join(p for (_, p), o in zip(parts, outside, strict=True) if not o), list(refs.values()), None, None, None)
                for (d, p), o, h in zip(parts, outside, hot, strict=True):
                    if o and d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        found.append((None,) * 7 + (d, SALTS if h else 1, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.values(), *found, strict=True), kinds, strict=True)], names)

    schema = "row long, docs array<long>, n_bytes long, media_sha256 binary, list binary, inline binary, outside array<struct<digest:binary,place:int>>, digest binary, places int, chunk binary"
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    both = written(own.mapInArrow(rows, schema), "media")
    media = both.filter("row is not null").drop("digest", "places", "chunk")
    once = both.filter("digest is not null").groupBy("digest").agg(F.first("places").alias("places"), F.first("chunk").alias("chunk"))
    store = written(once, "chunks")
    return media, store.select("digest", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), "chunk")


def read_media(media: DataFrame, store: DataFrame) -> DataFrame:
    """Reconstructs every medium from its ordered chunk list and describes it: FEATURES' columns.

    Media whose chunks are all their own are read where they are. Of others, one row for each digest gets the chunks that
    it lists by a join, grouped by medium, so a group is at most one medium; the documents of all rows with that digest
    get its result by a join of narrow rows, of which a batch gives one for each medium. What such a row stores itself, its
    list and its own chunks, is read, too, and must be what the rebuilt row stores, byte for byte (by SHA-256), as shared
    chunks are stored once for all. verified says whether all digests hold.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for docs, n_bytes, declared, listed, inline, near in zip(*(batch.column(i) for i in range(6)), strict=True):
                listed, inline = listed.as_py(), memoryview(inline.as_buffer())
                other = {x["digest"].as_py(): x["chunk"].as_py() for x in near} if near.is_valid else {}
                parts, at, sound = [], 0, True
                for i in range(0, len(listed), DIGEST + 4):
                    d, n = listed[i : i + DIGEST], struct.unpack_from("<I", listed, i + DIGEST)[0]
                    part = other.get(d)
                    if part is None:
                        part, at = bytes(inline[at : at + n]), at + n
                    sound = sound and len(part) == n and hashlib.blake2b(part, digest_size=DIGEST).digest() == d
                    parts.append(part)
                out.append((docs.as_py(), n_bytes.as_py(), declared.as_py(), hashlib.sha256(listed + inline).digest(), *described(b"".join(parts), declared.as_py(), sound)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

    kinds = {"docs": pa.list_(pa.int64()), "n_bytes": pa.int64(), "declared": pa.binary(), "own": pa.binary()} | {c.split()[0]: {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SEEN_IN_MEDIUM.split(", ")}
    schema = f"docs array<long>, n_bytes long, declared binary, own binary, {SEEN_IN_MEDIUM}"
    wide = ["docs", "n_bytes", "media_sha256", "list", "inline"]
    told = [F.explode("docs").alias("doc_id"), "n_bytes", *(c.split()[0] for c in SEEN_IN_MEDIUM.split(", "))]
    alone = media.filter(F.size("outside") == 0).select(*wide, F.lit(None).cast("array<struct<digest:binary,chunk:binary>>").alias("near"))
    more = media.filter(F.size("outside") > 0)
    chosen = more.groupBy(F.col("media_sha256").alias("declared")).agg(F.min("row").alias("row")).select("row")
    ours = more.join(chosen, "row", "left_semi")
    refs = ours.select("row", F.explode("outside").alias("ref")).select("row", "ref.*").join(store, ["digest", "place"])
    near = refs.groupBy("row").agg(F.collect_list(F.struct("digest", "chunk")).alias("near"))
    built = ours.join(near, "row").select(*wide, "near").mapInArrow(rows, schema).drop("docs", "n_bytes")
    mine = F.unhex(F.sha2(F.concat("list", "inline"), 256))
    copies = more.select("docs", "n_bytes", F.col("media_sha256").alias("declared"), mine.alias("mine")).join(built, "declared").withColumn("verified", F.col("verified") & (F.col("mine") == F.col("own")))
    return alone.mapInArrow(rows, schema).select(*told).unionByName(copies.select(*told))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media and read back."""
    return read_media(*stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
