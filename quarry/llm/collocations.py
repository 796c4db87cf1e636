"""Phrase collocations from generalised suffix automata of bounded depth.

Each task reads its documents in shards of bounded size and builds a shard's suffix automaton up to DEPTH words, level by
level in numpy: a node is a different phrase of d words, known by its (d - 1)-word prefix's node and its last word; its
suffix link is the node of the phrase without its first word; its count is the size of its endpos set. Phrases with equal
endpos sets are one state, which is emitted once, as its longest phrase with the range of lengths that its suffixes have.
Spark spells states out, sums counts globally, and follows suffix links (and prefixes, the links of the reversed texts)
from every frequent phrase to the phrases that it subsumes. As a longer phrase is no more frequent than what it holds,
it is enough to look at phrases that are longer by one word.

Only phrases that are frequent in the whole corpus matter, as a part of a frequent phrase is frequent, too. So before
automata are built, a first pass counts the hashes of words and of pairs of words of the whole corpus, summed up in each
shard and then by a shuffle; a bitmap of bounded size tells the frequent ones. Nodes are made only where all pairs of a
phrase pass. Equal hashes of unlike pairs only add up, so no frequent pair is missed, and counts of phrases are made
anew from what passes. In a corpus with so many frequent pairs that the bitmap is full it prunes nothing, and what is
shuffled are the states of all shards.

Words are known in a task by two 64-bit hashes, everywhere else by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.bits import MAX_BITS, bitmap, passes, size_for
from quarry.llm.common import small_batches, utf8, written
from quarry.llm.words import U, Words, mixed

#: Words of the longest phrases, occurrences of a candidate, and rows that are returned for each language.
DEPTH, MIN_COUNT, TOP = 5, 100, 2000
#: Bytes that end a piece: . , ; : ! ? and the line breaks 10 to 13.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words of a shard, about.
SHARD = 400_000
#: Rows that one task ranks in a language before the last one does.
RANKED = 100_000

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[list(BREAKS)] = 10


class Tokens:
    """Words of texts, A-Z lower-cased: id (equal words of a language have equal ones), code (hash) and piece of each.

    Names of languages are column 0 of a batch, texts column 1; a null language is `und`.
    """

    def __init__(self, batches: list[pa.RecordBatch]):
        self.words, hashes, other, pieces, langs, seen = [], [], [], [], [], 0
        self.counts: dict[str, int] = {}
        known: dict[str, int] = {}
        for batch in batches:
            raw, at = utf8(batch.column(1))
            raw = _TABLE[raw]
            words = Words(pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(raw)]))
            size = np.diff(words.of)
            names = [x.as_py() if x.is_valid else "und" for x in batch.column(0)]
            number = np.repeat(np.array([known.setdefault(x, len(known)) for x in names], np.int64), size)
            for name, k in zip(names, size.tolist(), strict=True):
                self.counts[name] = self.counts.get(name, 0) + k
            breaks = np.cumsum((raw >= 10) & (raw <= 13))
            text = np.repeat(np.arange(len(size)), size)
            piece = (breaks[words.starts] if len(raw) else np.zeros(0, np.int64)) + text
            pieces.append(piece + seen)
            seen += (int(breaks[-1]) if len(breaks) else 0) + len(size) + 1
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in known], U)[number]
            hashes.append(mixed(words.hashes() ^ salt))
            other.append(words.hashes(1) ^ salt)
            langs.append(number)
            self.words.append(words)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.code, self.other, self.piece, self.lang = join(hashes, U), join(other, U), join(pieces, np.int64), join(langs, np.int64)
        self.langs = list(known)
        self.first = np.cumsum([0, *(len(w.starts) for w in self.words)])

    def text(self, i: int) -> str:
        """The i-th word."""
        b = int(np.searchsorted(self.first, i, "right")) - 1
        words, k = self.words[b], i - int(self.first[b])
        return words.raw[words.starts[k] : words.ends[k]].tobytes().decode(errors="replace")


def pairs(code: np.ndarray) -> np.ndarray:
    """Hashes of two consecutive words, by the first's place."""
    return mixed(code[:-1] * U(0xD6E8FEB86659FD93) + code[1:] + U(2)) if len(code) else code


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[Tokens]:
    """The tokens of a task in shards of about SHARD words; a single text is never cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= 6 * SHARD:
            yield Tokens(held)
            held, size = [], 0
    if held:
        yield Tokens(held)


def _hash_counts(docs: DataFrame) -> DataFrame:
    """(h, n): hashes of words and of pairs, with what each shard counts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            h, n = np.unique(np.concatenate([t.code, pairs(t.code)[t.piece[:-1] == t.piece[1:]]]), return_counts=True)
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000].astype(np.int32))], ["h", "n"])

    return docs.mapInArrow(rows, "h long, n int")


def automaton(code: np.ndarray, other: np.ndarray, piece: np.ndarray, single: np.ndarray, double: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The states of a shard's suffix automaton: (last word's place, length, shortest length, count) for each level.

    single and double say at which places a word, and the pair that starts there, may be frequent; no other nodes are made.
    A state is its longest phrase and, down to the shortest length, those suffixes of it that occur no more often.
    """
    kept = np.flatnonzero(single)
    _, word = np.unique(code[kept], return_inverse=True)
    _, word2 = np.unique(other[kept], return_inverse=True)
    _, word = np.unique(word * (int(word2.max(initial=0)) + 1) + word2, return_inverse=True)
    many = int(word.max(initial=0)) + 1
    last = np.full(len(code), -1, np.int64)
    last[kept] = word
    ends, node = kept, word  # where phrases of the level end, and their nodes
    levels = []
    for d in range(1, depth + 1):
        if d > 1:
            before = np.full(len(code), -1, np.int64)
            before[ends] = node
            ends = ends[ends + 1 < len(code)] + 1  # the prefix ends a place earlier
            ends = ends[(last[ends] >= 0) & (piece[ends] == piece[ends - 1]) & double[ends - 1]]
            _, node = np.unique(before[ends - 1] * many + last[ends], return_inverse=True)
            link_at = before  # by end: the node of the phrase without its first word
        count = np.bincount(node) if len(node) else np.zeros(0, np.int64)
        place = np.zeros(len(count), np.int64)
        place[node] = ends
        levels.append((place, count, link_at[place] if d > 1 and len(count) else np.zeros(len(count), np.int64)))
    # From the longest down: a phrase that occurs no more often than one that it is the suffix of is in the latter's state.
    states: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    shortest = [np.full(len(count), d, np.int64) for d, (_, count, _) in enumerate(levels, 1)]
    inside = [np.zeros(len(count), bool) for _, count, _ in levels]
    for d in range(2, depth + 1):
        _, count, link = levels[d - 1]
        if not len(count):
            continue
        same = levels[d - 2][1][link] == count
        shortest[d - 1][same] = shortest[d - 2][link[same]]
        inside[d - 2][link[same]] = True
    for d, (place, count, _) in enumerate(levels, 1):
        top = ~inside[d - 1]
        states.append((place[top], np.full(int(top.sum()), d), shortest[d - 1][top], count[top]))
    return states


def _states(docs: DataFrame, frequent: np.ndarray, depth: int) -> DataFrame:
    """(lang, words, shortest, n): the states of all shards' automata, each as its longest phrase; the root counts a language's words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["lang", "words", "shortest", "n"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            single = passes(shared.value, t.code)
            double = np.zeros(len(t.code), bool)
            double[:-1] = passes(shared.value, pairs(t.code))
            langs = pa.array(t.langs, pa.string())
            k = len(t.counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(t.counts), pa.string()), pa.array([[]] * k, pa.list_(pa.string())), pa.array([0] * k, pa.int32()), pa.array(list(t.counts.values()), pa.int64())], names)
            for place, length, shortest, count in automaton(t.code, t.other, t.piece, single, double, depth):
                for i in range(0, len(place), 50_000):
                    p, k = place[i : i + 50_000], int(length[0])
                    at = (p[:, None] + np.arange(1 - k, 1)).ravel()
                    # Each different word becomes a string once.
                    _, first, which = np.unique(t.code[at] ^ mixed(t.other[at]), return_index=True, return_inverse=True)
                    words = pa.array([t.text(w) for w in at[first].tolist()], pa.string()).take(pa.array(which))
                    rows_ = [langs.take(pa.array(t.lang[p])), pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, k), pa.int32()), words)]
                    yield pa.RecordBatch.from_arrays([*rows_, pa.array(shortest[i : i + 50_000], pa.int32()), pa.array(count[i : i + 50_000], pa.int64())], names)

    return docs.mapInArrow(rows, "lang string, words array<string>, shortest int, n long")


def phrase_counts(docs: DataFrame, lang_col: str, text_col: str, depth: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, d, f) of all phrases of up to `depth` words that occur `least` times, and (lang, n) for all languages."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    frequent = written(_hash_counts(docs).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), "frequent-pairs")
    states = _states(docs, bitmap(frequent, "h", size_for(frequent.count(), MAX_BITS)), depth)
    # States of all shards are added up as they are; then come a state's suffixes, down to its shortest.
    states = states.groupBy("lang", "words", "shortest").agg(F.sum("n").alias("n"))
    spelt = states.select("lang", "n", F.explode(F.transform(F.sequence(F.col("shortest"), F.size("words")), lambda d: F.struct(d.alias("d"), F.array_join(F.slice("words", F.size("words") - d + 1, d), " ").alias("phrase")))).alias("x"))
    counts = spelt.groupBy("lang", F.col("x.phrase").alias("phrase"), F.col("x.d").alias("d")).agg(F.sum("n").alias("f"))
    found = written(counts.filter((F.col("f") >= least) | (F.col("d") == 0)), "phrases")
    return found.filter("d > 0"), found.filter("d = 0").select("lang", F.col("f").alias("n"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer phrase subsumes, from phrase_counts()."""
    words = F.split("phrase", " ")
    part = lambda i, k: F.array_join(F.slice("__w", i, k), " ")
    long = phrases.filter("d >= 2").withColumn("__w", words)
    # Suffix links, and those of the reversed automaton: what is one word shorter and occurs as often is subsumed.
    shorter = long.filter("d >= 3").select("lang", F.explode(F.array(part(F.lit(2), F.col("d") - 1), part(F.lit(1), F.col("d") - 1))).alias("phrase"), "f")
    longer = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    free = long.join(longer, ["lang", "phrase"], "left").filter("most is null or most < f")
    cut = free.select("lang", "phrase", F.col("f").alias("a"), "d", "__w", F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("d") - F.col("k")).alias("right"))
    f = phrases.filter(F.col("d") < DEPTH)
    both = cut.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    both = both.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    least = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank; each of several parts of a language is ranked first."""
    found = written(found, "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, found.count() // RANKED)
    some = found.withColumn("__p", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("__r", F.row_number().over(W.partitionBy("lang", "__p").orderBy(*order))).filter(F.col("__r") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("__p", "__r")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, then a, then phrase.

    A phrase has 2 to DEPTH words of one piece of a text and occurs a >= `least` times in the language, which has n words.
    Of its cuts in two parts, with l and r occurrences, that with the smallest score floor(1000 a n / (l r)) counts (ties:
    the shortest first part), in exact arithmetic. A phrase inside a longer one that occurs as often is dropped. Null and
    empty texts have no words; a null lang is `und`; repeated rows count as often as they come; an empty table
    gives no rows. Columns but the two are not read.
    """
    phrases, totals = phrase_counts(docs, lang_col, text_col, DEPTH, least)
    return ranked(scored(phrases, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  {" UNION ALL ".join(f"SELECT lang, {d} AS d, unnest(list_transform(range(1, len(w) - {d} + 2), lambda i: array_to_string(w[i:i + {d - 1}], ' '))) AS phrase FROM words" for d in range(1, DEPTH + 1))}
), f AS (
  SELECT lang, phrase, d, count(*) AS f FROM grams GROUP BY lang, phrase, d HAVING count(*) >= {MIN_COUNT}
), parts AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + d - 2], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE d >= 3)
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM parts GROUP BY lang, phrase
), cuts AS (
  SELECT f.lang, f.phrase, f.f AS a, unnest(range(1, d)) AS k, string_split(f.phrase, ' ') AS w, d
  FROM f LEFT JOIN longer USING (lang, phrase) WHERE d >= 2 AND (most IS NULL OR most < f.f)
), scores AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.d], ' ') JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least QUALIFY rank <= {TOP}
"""
