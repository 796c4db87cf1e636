"""Forests that Spark ML has not: extra trees, whose thresholds are drawn at random for each node, and bootstraps in which both classes weigh the same in each tree.

All trees grow together, a level at a time. A level is one or two passes over the rows: for extra trees the least and
largest value of the drawn features in each node, from which thresholds are drawn; then counts of both classes on both
sides of each candidate split, summed up in each task before the shuffle. The best candidate of each node is chosen in
Spark; what reaches the driver is a row a node. How often a row is in a tree's sample is a Poisson draw by a hash of tree
and key, so it is the same in every pass, whatever the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Most levels of a tree: a tree has 2 ** (MOST_LEVELS + 1) nodes at most, all trees' nodes are broadcast.
MOST_LEVELS = 12


def draw(*parts: int) -> float:
    """A number in [0, 1) from whole numbers, the same everywhere."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ (p & MASK)) * 0xBF58476D1CE4E5B9) & MASK
        x ^= x >> 31
        x = (x * 0x94D049BB133111EB) & MASK
        x ^= x >> 29
    return (x >> 11) / (1 << 53)


def draws(seed: int, tree: int, keys: np.ndarray) -> np.ndarray:
    """draw(seed, tree, key) for an array of keys."""
    x = np.full(len(keys), 0x9E3779B97F4A7C15, np.uint64)
    for p in (np.uint64(seed), np.uint64(tree), keys.view(np.uint64)):
        x = (x ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


class Forest:
    """fit(rows, columns, key), then predict(rows): the mean over trees of the share of label 1 in a row's leaf.

    Extra trees (bins=0) draw one threshold for each drawn feature between its least and largest value in the node;
    others try `bins` thresholds, the quantiles of the whole table. A node looks at a share of the features. samples is the
    mean of how often a row is in a tree's sample. Both classes weigh the same in each tree's sample. Of equally good
    splits the first drawn counts. Null features are 0; rows without a label are left out; without rows all is 0.5.
    """

    def __init__(self, trees: int = 40, levels: int = 8, share: float = 0.5, samples: float = 0.8, bins: int = 0, seed: int = 42):
        if levels > MOST_LEVELS:
            raise ValueError(f"at most {MOST_LEVELS} levels")
        self.trees, self.levels, self.share, self.samples, self.bins, self.seed = trees, levels, share, samples, bins, seed

    def drawn(self, tree: int, node: int) -> list[int]:
        """The features that a node looks at, in the order of their draws."""
        k = max(1, math.ceil(self.share * len(self.columns)))
        return sorted(range(len(self.columns)), key=lambda f: draw(self.seed, tree, node, f, 1))[:k]

    def copies(self, tree: int, keys: np.ndarray) -> np.ndarray:
        """How often each row is in a tree's sample."""
        steps = np.cumsum([math.exp(-self.samples) * self.samples**i / math.factorial(i) for i in range(12)])
        return np.searchsorted(steps, draws(self.seed, tree, keys), "right")

    def _rows(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.columns]).alias("x")
        return rows.select(x, F.col("label").cast("int").alias("y"), F.xxhash64(key).alias("k")).filter("y is not null") if key else rows.select(x)

    def places(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            f = self.feature[tree, at]
            inner = f >= 0
            left = x[np.arange(len(x)), np.maximum(f, 0)] < self.threshold[tree, at]
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return at

    def _passed(self, ready: DataFrame, made, schema: str) -> DataFrame:
        """A pass over the rows: made(x, y, copies by tree, node by tree, totals) adds what it counts to totals, a dict that is emitted once a task."""
        shared = ready.sparkSession.sparkContext.broadcast(self)
        names = [c.split()[0] for c in schema.split(", ")]

        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, totals = shared.value, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for t in range(forest.trees):
                    made(forest, totals, t, x, y, forest.copies(t, keys), forest.places(x, t))
            rows = [(*key, *map(float, v)) for key, v in totals.items()]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 10_000]]).cast(pa.int32() if " int" in s else pa.float64()) for c, s in enumerate(schema.split(", "))], names)

        return ready.mapInArrow(counted, schema)

    def fit(self, rows: DataFrame, columns: list[str], key: str) -> Forest:
        self.columns = list(columns)
        size = 2 ** (self.levels + 1) - 1
        self.feature = np.full((self.trees, size), -1, np.int64)
        self.threshold, self.value = np.zeros((self.trees, size)), np.full((self.trees, size), 0.5)
        self.open = {(t, 0) for t in range(self.trees)}
        self.bounds: dict[tuple[int, int, int], tuple[float, float]] = {}
        ready = self._rows(rows, key)
        self.quantiles = self._quantiles(ready)
        counts = self._passed(ready, _classes, "tree int, zero double, one double").groupBy("tree").agg(F.sum("zero"), F.sum("one")).collect()
        self.weight = np.ones((self.trees, 2))
        for t, zero, one in counts:
            self.weight[t] = [(zero + one) / (2 * max(zero, 1)), (zero + one) / (2 * max(one, 1))]
            self.value[t, 0] = 0.5 if zero and one else float(one > 0)
        for _ in range(self.levels):
            if not self.open or not counts:
                break
            if not self.bins:
                found = self._passed(ready, _bounds, "tree int, node int, feature int, lo double, hi double").groupBy("tree", "node", "feature").agg(F.min("lo"), F.max("hi")).collect()
                self.bounds = {(t, n, f): (lo, hi) for t, n, f, lo, hi in found}
            self._split(ready)
        return self

    def _quantiles(self, ready: DataFrame) -> list[list[float]]:
        if not self.bins:
            return []
        at = [F.col("x")[i].alias(f"f{i}") for i in range(len(self.columns))]
        return [sorted(set(q)) for q in ready.select(*at).approxQuantile([f"f{i}" for i in range(len(at))], [(i + 1) / (self.bins + 1) for i in range(self.bins)], 0.001)]

    def candidates(self, tree: int, node: int) -> list[tuple[int, float]]:
        """The splits (feature, threshold) that a node tries: rows below the threshold go left."""
        if self.bins:
            return [(f, q) for f in self.drawn(tree, node) for q in self.quantiles[f]]
        out = []
        for f in self.drawn(tree, node):
            lo, hi = self.bounds.get((tree, node, f), (0.0, 0.0))
            if lo < hi:
                out.append((f, lo + (hi - lo) * (1 - draw(self.seed, tree, node, f, 2))))
        return out

    def _split(self, ready: DataFrame) -> None:
        """Splits the open nodes of a level by their best candidates."""
        self.tried = {(t, n): self.candidates(t, n) for t, n in self.open}
        weights = ready.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(self.weight)], "tree int, w0 double, w1 double")
        sums = self._passed(ready, _sides, "tree int, node int, c int, l0 double, l1 double, r0 double, r1 double").groupBy("tree", "node", "c").agg(*[F.sum(x).alias(x) for x in ("l0", "l1", "r0", "r1")])
        s = sums.join(F.broadcast(weights), "tree").select("tree", "node", "c", *[(F.col(x) * F.col(f"w{x[1]}")).alias(x) for x in ("l0", "l1", "r0", "r1")])
        left, right = F.col("l0") + F.col("l1"), F.col("r0") + F.col("r1")
        pure = lambda a, b, n: (a * a + b * b) / n
        gain = pure(F.col("l0"), F.col("l1"), left) + pure(F.col("r0"), F.col("r1"), right) - pure(F.col("l0") + F.col("r0"), F.col("l1") + F.col("r1"), left + right)
        good = s.filter((left > 0) & (right > 0)).select("*", F.round(gain / (left + right), 9).alias("gain")).filter("gain > 0")
        best = good.groupBy("tree", "node").agg(F.min_by(F.struct("c", "l0", "l1", "r0", "r1"), F.struct(-F.col("gain"), "c")).alias("x")).select("tree", "node", "x.*").collect()
        self.open = set()
        for t, n, c, l0, l1, r0, r1 in best:
            self.feature[t, n], self.threshold[t, n] = self.tried[t, n][c]
            for child, zero, one in ((2 * n + 1, l0, l1), (2 * n + 2, r0, r1)):
                self.value[t, child] = one / (zero + one)
                if zero > 0 and one > 0 and 2 * child + 2 < self.feature.shape[1]:
                    self.open.add((t, child))

    def predict(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """rows with the probability of label 1."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def mean(x: pa.Array) -> pa.Array:
            forest = shared.value
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            return pa.array(np.mean([forest.value[t, forest.places(m, t)] for t in range(forest.trees)], axis=0) if len(m) else [], pa.float64())

        return rows.withColumn(out, mean(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.columns])))


def _classes(forest: Forest, totals: dict, t: int, x: np.ndarray, y: np.ndarray, copies: np.ndarray, at: np.ndarray) -> None:
    v = totals.setdefault((t,), np.zeros(2))
    v += np.bincount(y, copies, 2)[:2]


def _bounds(forest: Forest, totals: dict, t: int, x: np.ndarray, y: np.ndarray, copies: np.ndarray, at: np.ndarray) -> None:
    for node in np.unique(at[copies > 0]).tolist():
        if (t, node) in forest.open:
            own = x[(at == node) & (copies > 0)]
            for f in forest.drawn(t, node):
                v = totals.setdefault((t, node, f), np.array([np.inf, -np.inf]))
                v[:] = min(v[0], own[:, f].min()), max(v[1], own[:, f].max())


def _sides(forest: Forest, totals: dict, t: int, x: np.ndarray, y: np.ndarray, copies: np.ndarray, at: np.ndarray) -> None:
    for node in np.unique(at[copies > 0]).tolist():
        if (t, node) in forest.open:
            own = (at == node) & (copies > 0)
            xs, ys, w = x[own], y[own], copies[own]
            for c, (f, threshold) in enumerate(forest.tried[t, node]):
                v = totals.setdefault((t, node, c), np.zeros(4))
                v += np.bincount(2 * (xs[:, f] >= threshold) + ys, w, 4)[:4]
