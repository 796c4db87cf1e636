"""Splits by time without leaks between them."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of train, valid and test rows.
RATIOS = (0.7, 0.2, 0.1)


def year_counts(rows: DataFrame, year: Column) -> dict[int, int]:
    """Rows for each year: as many numbers on the driver as there are years."""
    return {r["y"]: r["n"] for r in rows.groupBy(year.alias("y")).agg(F.count("*").alias("n")).filter("y is not null").collect()}


def _named(years: list[int], i: int, j: int) -> dict[int, str]:
    return {y: "train" if k < i else "valid" if k < j else "test" for k, y in enumerate(years)}


def optimized(counts: dict[int, int], ratios: tuple[float, float, float] = RATIOS) -> dict[int, str]:
    """The cut into three runs of years with the least squared error against the ratios; empty later splits cost extra."""
    years = sorted(counts)
    n, total = len(years), sum(counts.values())
    if n < 2:
        return dict.fromkeys(years, "train")
    best = None
    for i, j in combinations_with_replacement(range(1, n + 1), 2):
        sizes = [sum(counts[y] for y in part) for part in (years[:i], years[i:j], years[j:])]
        cost = sum((s - r * total) ** 2 for s, r in zip(sizes, ratios, strict=True))
        if n >= 3:
            cost += (0.05 * total) ** 2 * sum(s == 0 for s in sizes[1:])
        if best is None or cost < best[0]:
            best = (cost, i, j)
    return _named(years, best[1], best[2])


def chronological(counts: dict[int, int], ratios: tuple[float, float, float] = RATIOS) -> dict[int, str]:
    """Years join a split while its rows stay in its budget; each of train and valid takes one year at least."""
    years, total, at, ends = sorted(counts), sum(counts.values()), 0, []
    for r in ratios[:2]:
        size, first = 0, at
        while at < len(years) and (at == first or size + counts[years[at]] <= r * total):
            size += counts[years[at]]
            at += 1
        ends.append(at)
    return _named(years, *ends)


def fixed(year: Column, valid_from: int, test_from: int, excluded_from: int) -> Column:
    return F.when(year < valid_from, "train").when(year < test_from, "valid").when(year < excluded_from, "test")


def mapped(year: Column, names: dict[int, str]) -> Column:
    """Each row's split by its year; null for years that have none."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[year] if names else F.lit(None).cast("string")


def whole_groups(rows: DataFrame, group: str, split: str = "split", dated: Column | None = None) -> DataFrame:
    """(group, split) of the groups whose rows all have one and the same split; with `dated`, of its dated rows only.

    A row without a date then goes with its group, and a dated row that lies in no split keeps its group out.
    """
    asked = F.count("*") if dated is None else F.count(F.when(dated, 1))
    by = rows.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi"), asked.alias("n"), F.count(split).alias("known"))
    return by.filter("lo = hi and n = known").select(group, F.col("lo").alias(split))
