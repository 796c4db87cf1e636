"""Connected components of links, and bounded bitmaps of keys, as Spark jobs."""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written

#: Bits of a bitmap: a fixed size at every size of the input; more keys give more false hits, never a miss.
BITS = 1 << 25


def place(key: Column, bits: int = BITS) -> Column:
    """The bit of a key."""
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, col: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of the keys in a column: bits / 8 bytes on the driver, whatever the number of keys."""
    at = place(F.col(col), bits) + 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["b"]), np.uint8)
        begin = (r["k"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out


def hit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set."""
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def free(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of jobs whose frames nobody holds any more.

    Twice, with time for Spark's cleaner, as it learns of a frame's end only after Python and the JVM have.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.4)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps: each node's smallest neighbour becomes the neighbour of its larger, then
    of its smaller ones, until only stars are left; rounds grow as the logarithm of a component. Each round is a written
    table. Only two numbers a round reach the driver.
    """
    state = lambda t: tuple(t.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after_table = written(small, "small-star")
        discard(now)
        now, after = after_table, state(after_table)
        free(links)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
