"""Ranks and running totals over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with running totals, this row included, in the order of `order`; `bucket` must be monotone in it.

    Each bucket is summed apart, then moved on by the totals of the buckets before it, which are as many rows as there
    are buckets. Rows that are equal in `order` are told apart arbitrarily.
    """
    by = by or []
    df = df.withColumn("__bucket", bucket)
    names = list(sums)
    df = df.withColumns({f"__{n}": c for n, c in sums.items()})
    totals = df.groupBy(*by, "__bucket").agg(*[F.sum(f"__{n}").alias(n) for n in names])
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "__bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}_before") for n in names])
    inside = W.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumns({n: F.sum(f"__{n}").over(inside) for n in names}).join(starts, [*by, "__bucket"])
    out = out.withColumns({n: F.col(n) + F.col(f"__{n}_before") for n in names})
    return out.drop("__bucket", *[f"__{n}" for n in names], *[f"__{n}_before" for n in names])


def first_by_hash(df: DataFrame, label: str, id_col: str, keep: DataFrame, seed: str) -> DataFrame:
    """Of each label, as many rows as `keep` (label, keep) says, those with the smallest SHA-1 of seed and id."""
    h = df.withColumn("__h", F.sha1(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary")))
    ranked = running(h, F.substring("__h", 1, 3), [F.col("__h"), F.col(id_col)], {"__rank": F.lit(1)}, [label])
    return ranked.join(F.broadcast(keep), label).filter(F.col("__rank") <= F.col("keep")).drop("__h", "__rank", "keep")
