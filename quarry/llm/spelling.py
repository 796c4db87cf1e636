"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion makes of it, over
the alphabet that the vocabulary was seen to use. Strings that are words of the vocabulary are found by a hash join on
the string itself, so equality is all there is to check: no distance is computed. A deletion within a run of equal
letters is made once, at its end, and a letter is inserted beside an equal one once, after it; so no string comes twice.

A word of L letters has about 2 L times as many neighbours as the alphabet has letters, nearly all of them no words. In
tasks they are hashes first, each in constant time from hashes of what stands before and behind the edit; a bitmap of the
vocabulary's hashes, of bounded size, drops most. Only what is left becomes a string and is shuffled, summed up by
candidate before the shuffle. As nearness is mutual, the words that emitted a candidate are the candidate's near words.

Counts of words are partial sums in each task before the shuffle. A word's form is more frequent than the word by a
factor of RATIO, so chains of forms are no longer than the logarithm of the largest count, and roots need a number of
pointer-doubling joins that is the logarithm of that.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, small_batches, written
from quarry.llm.words import U, mixed, powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have MIN_LENGTH code points and MIN_COUNT occurrences at least; a form has RATIO times a word's occurrences.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: A letter of a run goes where this number divides the run's hash.
LOSS = 199
#: Most binary digits of the bitmap's size (2 ** 27 bits are 16 MB); the vocabulary gets 256 bits a word up to that.
MAX_BITS = 27
#: Neighbours that are hashed at once.
BLOCK = 1 << 21
#: Odd base of the rolling hash, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _lowered(run: Column) -> Column:
    """A run of letters with A-Z alone in lower case."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the words that are long and frequent enough, with their occurrences."""
    run = F.explode(F.split(F.col(f"`{text_col}`"), "[^A-Za-zÀ-ÿ]+"))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.filter(F.length("run") >= MIN_LENGTH).select("id", _lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % LOSS == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return mixed(codes.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9))


def finished(total: np.ndarray, length: int) -> np.ndarray:
    """The hash of a string from the sum of its letters' values times powers of BASE, and its length."""
    return mixed(total + U(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of equally long words, given as a matrix of code points."""
    return finished((letter_values(codes) * powers(BASE, max(64, codes.shape[1]))[: codes.shape[1]]).sum(1, dtype=U), codes.shape[1])


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers and code points of equally long words."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), size)


def neighbours(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, hash, row, place, letter) of all distinct neighbours of equally long words, in blocks: edit is drop, swap or add."""
    rows, size = codes.shape
    power = powers(BASE, max(64, size + 2))[: size + 2]
    value, of = letter_values(letters), letter_values(codes) * power[:size]
    before = np.zeros((rows, size + 1), U)
    np.cumsum(of, 1, out=before[:, 1:])
    total = before[:, -1:]
    keep = np.ones((rows, size), bool)
    keep[:, :-1] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(keep)
    yield "drop", finished(before[row, at] + (total[row, 0] - before[row, at + 1]) * U(BACK), size - 1), row, at, np.zeros(len(row), np.int64)
    step = max(1, BLOCK // max(1, rows * len(letters)))
    for first in range(0, size + 1, step):
        at = np.arange(first, min(first + step, size + 1))
        new = value * power[at][:, None]  # place, letter
        inner = at[at < size]
        if len(inner):
            row, place, letter = np.nonzero(codes[:, inner, None] != letters)
            yield "swap", finished(((total - of[:, inner])[:, :, None] + new[: len(inner)])[row, place, letter], size), row, place + first, letter
        fresh = np.ones((rows, len(at), len(letters)), bool)
        fresh[:, : len(inner)] = codes[:, inner, None] != letters
        row, place, letter = np.nonzero(fresh)
        yield "add", finished(((before[:, at] + (total - before[:, at]) * U(BASE))[:, :, None] + new)[row, place, letter], size + 1), row, place + first, letter


def edited(word: str, edit: str, at: int, letter: str) -> str:
    """The neighbour as a string."""
    return word[:at] + (letter if edit != "drop" else "") + word[at + (edit != "add") :]


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a bitmap of `bits` bits, a power of two."""
    mask = U(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> U(32)) & mask).astype(np.int64)


def _bitmap(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a vocabulary: bits / 8 bytes on the driver, whatever the number of words."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [p for _, codes in by_length(words) for p in _places(word_hashes(codes), bits)] if words else []
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.concatenate(found) + 1 if found else [], pa.int64())})

    at = vocabulary.select("word").mapInArrow(rows, "at long")
    parts = at.select(F.bitmap_bucket_number("at").alias("k"), F.bitmap_bit_position("at").alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(bytes(r["b"]), np.uint8)
        begin = (r["k"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out


def candidates(vocabulary: DataFrame) -> DataFrame:
    """(word, n, candidate): the neighbours of each word that may be words of the vocabulary (all that are, and few others)."""
    spark = vocabulary.sparkSession
    letters = sorted(r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c <> ''").collect())
    count = vocabulary.count()
    bits = 1 << min(MAX_BITS, max(16, (256 * count).bit_length()))
    shared = spark.sparkContext.broadcast((_bitmap(vocabulary, bits), letters))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, letters = shared.value
        codes_of = np.array([ord(c) for c in letters], np.uint32)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at, codes in by_length(words) if words else ():
                # So many words at once that a block of one place has BLOCK neighbours.
                step = max(1, BLOCK // (4 * len(letters)) // codes.shape[1] + 1)
                for i in range(0, len(at), step):
                    for edit, hashes, row, place, letter in neighbours(codes[i : i + step], codes_of):
                        one, two = _places(hashes, bits)
                        maybe = np.flatnonzero((bitmap[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
                        two = two[maybe]
                        maybe = maybe[((bitmap[two >> 3] >> (two & 7).astype(np.uint8)) & 1) == 1]
                        if not len(maybe):
                            continue
                        of = at[i + row[maybe]]
                        made = [edited(words[w], edit, p, letters[c]) for w, p, c in zip(of.tolist(), place[maybe].tolist(), letter[maybe].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in of.tolist()], pa.string()), pa.array(n[of], pa.int64()), pa.array(made, pa.string())], ["word", "n", "candidate"])

    # The vocabulary is small beside its neighbourhoods: dealt out so that no task has more than some thousand words.
    return vocabulary.repartition(max(1, min(20_000, count // 4_000)), "word").select("word", "n").mapInArrow(rows, "word string, n long, candidate string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): near words and the form of each word of the vocabulary."""
    near = candidates(vocabulary).groupBy("candidate").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "word")).alias("best"))
    out = vocabulary.join(near, F.col("word") == F.col("candidate"), "left")
    far = -F.col("best.minus") >= RATIO * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.minus")).alias("form_n"))


def rooted(words: DataFrame) -> DataFrame:
    """words (word, n, form, ...) with root, the last of the forms that follow each other; the word itself if it has none."""
    now = written(words.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    most = words.agg(F.max("n")).first()[0] or 1
    chain = int(math.log(most, RATIO)) + 1
    for _ in range(max(0, chain - 1).bit_length()):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(now)
        now = after
    return words.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of MIN_LENGTH code points and MIN_COUNT occurrences at least.

    Words are maximal runs of Latin letters, A-Z lower-cased; a run whose hash with the document's id LOSS divides loses a
    letter. Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
    most frequent near word (ties: the smallest in code-point order) if that has RATIO times its occurrences; root follows
    forms to the last. Null and empty texts have no words, a null id counts as empty; repeated rows count as often as they
    come. An empty table gives no words. Columns but the two are not read.
    """
    small_batches(docs.sparkSession)
    vocabulary = written(counted(docs, id_col, text_col), "vocabulary")
    words = written(near_words(vocabulary), "near-words")
    return rooted(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
