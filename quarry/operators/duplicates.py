"""Exact and near duplicates, the first of each kept in a given order.

Near duplicates are texts whose sets of five-word shingles have a similarity of 0.85. 128 minimum hashes find them, of
which 126 make 21 bands of 6 (a pair at 0.85 is met with a probability of 0.99995); what is met is verified on whole sets. A row is dropped if an earlier kept row is a near duplicate of it, as if rows came one at a time: of a chain
a ~ b ~ c where a and c are unlike, a and c stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.sources.places import shared

#: Words of a shingle, least similarity, permutations; and the bands they are cut into.
SHINGLE, LEAST, PERMUTATIONS, BANDS, EACH = 5, 0.85, 128, 21, 6
#: Words of 64 bits of a parity bitmap.
MARK_WORDS = 8
#: Values that ids are hashed to, to tell which sets pairs ask for: a fixed size at every size of the input.
PLACES = 1 << 22
#: Rounds of heads before what is left is compared in pairs.
ROUNDS = 12
#: The order of splits.
PRIORITY = {"train": 0, "valid": 1, "test": 2}
WORDS = r"(?U)[\s\x1c-\x1f]+"


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def priority(split: Column) -> Column:
    """0 to 2 for known splits, 50 for others, 99 for none."""
    known = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.lower(strip(split))]
    return F.when(split.isNull(), 99).otherwise(F.coalesce(known, F.lit(50)))


def digest(code: Column) -> Column:
    return F.sha1(code.cast("binary"))


def first_of_equal(rows: DataFrame, code: str, order: list[Column], scope: str | None = None) -> DataFrame:
    """rows with `keep`: whether no earlier row has the same code, and `first`: the place of the first that has it.

    Blank codes all stay. scope: a column that parts the index.
    The first of each digest is an aggregate with partial minima; no group is gathered.
    """
    key = [digest(F.col(code)).alias("__digest")] + ([F.col(scope).alias("__scope")] if scope else [])
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    first = rows.groupBy(*key).agg(F.min(place).alias("__first"))
    on = F.col("__own").eqNullSafe(F.col("__digest"))
    if scope:
        on = on & F.col(scope).eqNullSafe(F.col("__scope"))
    # What the code is asked for comes before the join, so that codes move only for callers that want them.
    joined = rows.withColumns({"__own": digest(F.col(code)), "__blank": F.coalesce(strip(F.col(code)), F.lit("")) == ""}).join(first, on, "left")
    return joined.withColumn("keep", F.col("__blank") | (place == F.col("__first"))).withColumn("first", F.col("__first.o0")).drop("__own", "__blank", "__digest", "__scope", "__first")


def with_shingles(rows: DataFrame, code: str, out: str = "shingles") -> DataFrame:
    """rows with the distinct hashes of all runs of five words; a shorter text is one, a blank or null one has none."""
    words = F.filter(F.split(F.coalesce(F.col(code), F.lit("")), WORDS), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)])
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n > 0, F.array_distinct(F.transform(runs, lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(SHINGLE)])))).otherwise(whole)

    return rows.withColumn(out, F.transform(F.array(words), hashes)[0])


def banded(rows: DataFrame, key: str, shingles: str, *more: str) -> DataFrame:
    """(key, bands, n, mark) and the columns of `more`: a hash for each band of minimum hashes, the number of shingles, and their parity bitmap; rows without shingles are left out.

    Bit i of a parity bitmap says whether an odd number of shingles falls on it: sets that differ in d shingles have
    bitmaps that differ in d bits at most.
    """
    rng = np.random.default_rng(20_240_101)
    a, b = (rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    mix = rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, marks = [], [], []
            for s in batch.column(1):
                h = s.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
                for at in range(0, len(h), 4096):
                    least = np.minimum(least, (h[at : at + 4096, None] * a + b).min(0))
                out.append((least * mix)[: BANDS * EACH].reshape(BANDS, EACH).sum(1, dtype=np.uint64).view(np.int64))
                sizes.append(len(h))
                odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * MARK_WORDS), minlength=64 * MARK_WORDS) & 1
                marks.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64())), *batch.columns[2:]], ["k", "bands", "n", "mark", *more])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join([f"k {kind(key)}, bands array<long>, n int, mark array<long>", *[f"`{c}` {kind(c)}" for c in more]])
    return rows.filter(F.size(shingles) > 0).select(key, F.col(shingles).alias("__s"), *more).mapInArrow(made, schema).withColumnRenamed("k", key)


def similarity(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def may_be_near(n: Column, x: Column, m: Column, y: Column) -> Column:
    """Whether sizes and parity bitmaps allow two sets a similarity of LEAST: they then differ in (n + m) (1 - LEAST) / (1 + LEAST) shingles at most."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (F.least(n, m) >= LEAST * F.greatest(n, m)) & (apart <= (n + m) * ((1 - LEAST) / (1 + LEAST)) + 1e-6)


def _needed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (at, ...) whose place one of the ids (at) has, and few others: PLACES values at most are sent to all tasks, so that what nobody asks for isn't shuffled."""
    place = lambda: F.pmod(F.xxhash64("at"), F.lit(PLACES)).cast("int").alias("__place")
    return rows.withColumn("__place", place()).join(F.broadcast(ids.select(place()).distinct()), "__place", "left_semi").drop("__place")


def near_pairs(pairs: DataFrame, a_marks: DataFrame, a_sets: DataFrame, b_marks: DataFrame, b_sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near duplicates. Marks (at, n, mark) come first; sets (at, shingles) move for what they leave."""
    side = lambda rows, c: rows.select(F.col("at").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in rows.columns if x in ("n", "mark", "shingles")])
    some = pairs.join(side(a_marks.select("at", "n", "mark"), "a"), "a").join(side(b_marks.select("at", "n", "mark"), "b"), "b")
    some = _written(some.filter(may_be_near(F.col("n_a"), F.col("mark_a"), F.col("n_b"), F.col("mark_b"))).select("a", "b"), "likely")
    sets = lambda rows, c: side(_needed(rows.select("at", "shingles"), some.select(F.col(c).alias("at"))), c)
    j = some.join(sets(a_sets, "a"), "a").join(sets(b_sets, "b"), "b")
    return j.filter(similarity(F.col("shingles_a"), F.col("shingles_b")) >= LEAST).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of the same table that are near duplicates, by their whole sets."""
    return near_pairs(pairs, sets, sets, sets, sets)


def _placed(rows: DataFrame, code: str, order: str, firsts: bool) -> tuple[DataFrame, DataFrame]:
    """(at, shingles, n, mark) of the first row of each code, and (at, band) rows; `at` is the place in the order. firsts: rows are those already."""
    first = rows.select(F.col(order).alias("at"), F.col(code).alias("code")) if firsts else rows.groupBy(digest(F.col(code)).alias("d")).agg(F.min(F.struct(F.col(order).alias("at"), F.col(code).alias("code"))).alias("x")).select("x.*")
    sets = _written(banded(with_shingles(first, "code"), "at", "shingles", "shingles"), "sets")
    bands = sets.select("at", F.posexplode("bands").alias("i", "h")).select("at", F.struct("i", "h").alias("band"))
    return sets.drop("bands"), shared_bands(bands)


def shared_bands(bands: DataFrame) -> DataFrame:
    """Of (at, band) rows those of bands that several rows have."""
    met = bands.groupBy("band").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi").select("band")
    return _written(bands.join(met, "band", "left_semi"), "bands")


def near_dropped(rows: DataFrame, code: str, order: str, firsts: bool = False) -> DataFrame:
    """(at) of the rows that an earlier kept row makes a near duplicate, among the first rows of each code; firsts: rows are those already, as first_of_equal() keeps them.

    In each round the first row left in a band is its head. Rows that head all their bands stay: whatever comes earlier
    and shares a band has been settled. They are compared with what is left in their bands, so a round makes at most one
    pair a row and band. Rows left after ROUNDS rounds are settled from their verified pairs.
    """
    return dropped(*_placed(rows, code, order, firsts))


def dropped(sets: DataFrame, left: DataFrame) -> DataFrame:
    """near_dropped() for rows whose sets (at, shingles, n, mark) and shared bands (at, band) are there already."""
    gone: list[DataFrame] = []
    for _ in range(ROUNDS):
        heads = left.groupBy("band").agg(F.min("at").alias("head"))
        met = _written(left.join(heads, "band"), "met")
        if met.isEmpty():
            break
        kept = met.groupBy("at").agg(F.min("head").alias("h")).filter("h = at").select("at")
        pairs = met.filter("head < at").join(kept.select(F.col("at").alias("head")), "head", "left_semi").select(F.col("head").alias("a"), F.col("at").alias("b")).distinct()
        dropped = _written(_near(pairs, sets).select(F.col("b").alias("at")).distinct(), "dropped")
        gone.append(dropped)
        left = _written(met.select("at", "band").join(kept.unionByName(dropped), "at", "left_anti"), "left")
    else:
        if not left.isEmpty():
            gone.append(_settled(left, sets))
    out = gone[0] if gone else sets.select("at").limit(0)
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def _settled(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The dropped ones of rows left, from their verified pairs: row by row in waves, each wave the rows whose earlier ones are known."""
    links = _written(_near(left.join(left.select(F.col("at").alias("b"), "band"), "band").filter("at < b").select(F.col("at").alias("a"), "b").distinct(), sets), "links")
    gone = None
    while not links.isEmpty():
        free = links.select(F.col("a").alias("at")).join(links.select(F.col("b").alias("at")), "at", "left_anti").distinct()
        now = _written(links.join(free, links["a"] == free["at"], "left_semi").select(F.col("b").alias("at")).distinct(), "dropped")
        gone = now if gone is None else gone.unionByName(now)
        links = _written(links.join(free.unionByName(now), links["a"] == F.col("at"), "left_anti").join(now, links["b"] == now["at"], "left_anti"), "links")
    return gone if gone is not None else left.select("at").limit(0)


def near_matched(rows: DataFrame, code: str, order: str, firsts: bool = False) -> DataFrame:
    """(at) of the rows that have any earlier near duplicate, kept or not, among the first rows of each code; firsts: rows are those already.

    Each row is compared with its bands' heads; only what no head is near to is compared with all earlier rows of its bands.
    """
    sets, bands = _placed(rows, code, order, firsts)
    heads = bands.groupBy("band").agg(F.min("at").alias("a"))
    easy = _written(_near(bands.join(heads, "band").filter("a < at").select("a", F.col("at").alias("b")).distinct(), sets).select(F.col("b").alias("at")).distinct(), "easy")
    hard = bands.join(easy, "at", "left_anti").select(F.col("at").alias("b"), "band")
    pairs = hard.join(bands, "band").filter("at < b").select(F.col("at").alias("a"), "b").distinct()
    return easy.unionByName(_near(pairs, sets).select(F.col("b").alias("at")).distinct())
