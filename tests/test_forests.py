"""Forests against a plain version that grows one tree after another over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import forests, metrics


def plain_tree(forest, t, x, y, copies, weight):
    """Predictor of one tree: each node's best split of its candidates, looked for row by row."""

    def share(rows):
        zero, one = (sum(copies[i] * weight[c] for i in rows if y[i] == c) for c in (0, 1))
        return zero, one

    def grow(rows, node, level):
        zero, one = share(rows)
        leaf = one / (zero + one) if zero + one else 0.5
        if level == forest.levels or not zero or not one:
            return lambda v: leaf
        if not forest.bins:
            for f in range(x.shape[1]):
                forest.bounds[t, node, f] = min(x[i, f] for i in rows), max(x[i, f] for i in rows)
        best = None
        for c, (f, q) in enumerate(forest.candidates(t, node)):
            sides = [i for i in rows if x[i, f] < q], [i for i in rows if x[i, f] >= q]
            if not all(sides):
                continue
            pure = lambda z, o: (z * z + o * o) / (z + o)
            gain = round((sum(pure(*share(s)) for s in sides) - pure(zero, one)) / (zero + one), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, f, q, sides
        if best is None:
            return lambda v: leaf
        _, f, q, (a, b) = best
        left, right = grow(a, 2 * node + 1, level + 1), grow(b, 2 * node + 2, level + 1)
        return lambda v: left(v) if v[f] < q else right(v)

    return grow([i for i in range(len(y)) if copies[i]], 0, 0)


def points(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.random()
        rows.append((i, a, b if rng.random() > 0.05 else None, c, 1.0, int(a * a + b * c + rng.gauss(0, 0.3) > 1.6)))
    return rows


@pytest.mark.parametrize("bins", [0, 6])
def test_a_forest_is_its_plain_version(spark, bins):
    rows = points(1, 240)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int").repartition(3)
    forest = forests.Forest(trees=6, levels=4, bins=bins, seed=7).fit(df, ["a", "b", "c", "d"], "id")
    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    x = np.array([[v or 0.0 for v in r[1:5]] for r in rows])
    y = [r[5] for r in rows]
    other = forests.Forest(trees=6, levels=4, bins=bins, seed=7)
    other.columns, other.bounds, other.quantiles = forest.columns, {}, forest.quantiles
    grown = []
    for t in range(6):
        copies = forest.copies(t, np.array([keys[r[0]] for r in rows]))
        n = [sum(c for c, v in zip(copies, y, strict=True) if v == k) for k in (0, 1)]
        grown.append(plain_tree(other, t, x, y, copies, [sum(n) / (2 * n[0]), sum(n) / (2 * n[1])]))
    got = {r["id"]: r["p"] for r in forest.predict(df, "p").collect()}
    for r, v in zip(rows, x, strict=True):
        assert got[r[0]] == pytest.approx(np.mean([g(v) for g in grown]), abs=1e-9)


def test_forests_tell_unseen_rows_apart(spark):
    df = spark.createDataFrame(points(2, 2000), "id long, a double, b double, c double, d double, label int")
    for bins in (0, 16):
        forest = forests.Forest(trees=20, levels=6, bins=bins).fit(df.filter("id % 4 > 0"), ["a", "b", "c", "d"], "id")
        held = forest.predict(df.filter("id % 4 = 0"), "score").select("label", "score")
        assert metrics.ranking_metrics(held).first()["auc"] > 0.9


def test_forests_of_nothing_and_of_one_class(spark):
    schema = "id long, a double, label int"
    none = forests.Forest(trees=2, levels=2).fit(spark.createDataFrame([], schema), ["a"], "id")
    one = forests.Forest(trees=2, levels=2, samples=3.0).fit(spark.createDataFrame([(i, 1.0, 1) for i in range(9)] + [(9, 2.0, None)], schema), ["a"], "id")
    rows = spark.createDataFrame([(1, 1.0), (2, None)], "id long, a double")
    assert [r["p"] for r in none.predict(rows, "p").collect()] == [0.5, 0.5]
    assert [r["p"] for r in one.predict(rows, "p").collect()] == [1.0, 1.0]
    assert none.predict(rows.limit(0), "p").count() == 0
