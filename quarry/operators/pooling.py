"""Scores of parts pooled into a score of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scores import FLAG, WEIGHT


def composite(parts: DataFrame, group: str, score: str = "score", threshold: float = FLAG, weight: float = WEIGHT, near: float = 1e-9) -> DataFrame:
    """(group, base, uplift, pooled, n, n_top): the highest score plus a share of how far the others exceed the threshold.

    Two aggregates with partial sums and a join of parts with their group's maximum, so no group is sorted or gathered.
    """
    base = parts.groupBy(group).agg(F.max(score).alias("base"))
    lower = F.col(score) < F.col("base") - near
    both = parts.select(group, score).join(base, group).groupBy(group).agg(
        F.first("base").alias("base"), F.coalesce(F.avg(F.when(lower, F.greatest(F.lit(0.0), F.col(score) - threshold))), F.lit(0.0)).alias("excess"), F.count("*").alias("n"), F.count_if(~lower).alias("n_top")
    )
    uplift = weight * F.col("excess")
    return both.select(group, "base", uplift.alias("uplift"), F.least(F.lit(1.0), F.col("base") + uplift).alias("pooled"), "n", "n_top")
