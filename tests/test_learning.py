"""Models on rows whose answer is known."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import learning, metrics
from quarry.operators.learning import Calibrator, Meta
from quarry.plans import learning as queries


def pooled(points):
    """Adjacent violators, pooled one by one."""
    blocks = []
    for x, y in sorted(points):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, xs = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
            blocks[-1][2] += xs
    return {x: y / n for y, n, xs in blocks for x in xs}


def test_isotonic_is_pooling_and_holds_its_ends(spark):
    points = [(i / 50, float((i * 37 % 11) < i / 6)) for i in range(60)]
    rows = spark.createDataFrame(points, "score double, label double")
    cal = Calibrator("isotonic").fit(rows)
    got = {r["score"]: r["calibrated"] for r in cal.predict(rows).collect()}
    assert all(abs(got[x] - v) < 1e-9 for x, v in pooled(points).items())
    ends = [r["calibrated"] for r in cal.predict(spark.createDataFrame([(-5.0,), (5.0,)], "score double")).orderBy("score").collect()]
    assert ends == [min(got.values()), max(got.values())] and cal.curve()[0][0] == 0.0


def test_platt_is_a_rising_logistic_curve(spark):
    rows = spark.createDataFrame([(i / 100, int(i * 7919 % 100 < i)) for i in range(100)], "score double, label int")
    cal = Calibrator("platt").fit(rows)
    got = [r["calibrated"] for r in cal.predict(rows).orderBy("score").collect()]
    assert got == sorted(got) and 0 < got[0] < got[-1] < 1
    logit = [math.log(p / (1 - p)) for p in got]
    assert abs((logit[50] - logit[0]) - (logit[99] - logit[49])) < 1e-6
    assert Calibrator("none").fit(rows).predict(rows).filter("calibrated <> score").count() == 0


def test_stack_learns_on_held_out_rows(spark):
    rows = spark.range(1500).select(F.col("id"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("a"), (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 1000).alias("b"))
    rows = rows.withColumn("label", ((F.col("a") > 0.5) != (F.col("b") > 0.5)).cast("int")).cache()
    models = learning.fitted(rows.filter("id % 4 < 2"), rows.filter("id % 4 = 2"), ["a", "b"], queries.NAMES)
    table = learning.stacked(models, rows.filter("id % 4 = 3"), ["a", "b"]).cache()
    for n in queries.NAMES:
        assert learning.judged(table, n).first()["auc"] > 0.9
    meta = Meta("polynomial", queries.NAMES).fit(table.filter("id % 8 = 3")).predict_proba(table.filter("id % 8 = 7"))
    assert meta.columns == [*table.columns, "meta"] and learning.judged(meta, "meta").first()["auc"] > 0.9


def test_search_keeps_the_first_of_equals():
    """Whatever the number of trials at once and the order in which they end."""
    grid = {"x": [1, 2, 3], "y": [0, 5]}

    def slow(p):
        time.sleep(0.02 * (3 - p["x"]))
        return float(p["x"] > 1)

    at, value, trials = learning.searched(grid, 6, slow, parallel=1)
    assert (at, value, trials) == learning.searched(grid, 6, slow, parallel=6)
    assert value == 1.0 and at["x"] > 1 and [t[0] for t in trials] == list(range(6))
    first = next(i for i, p, v, _ in trials if v == 1.0)
    assert at == trials[first][1] and [b for *_, b in trials] == [i in (0, first) for i in range(6)]
    assert learning.searched(grid, 2, slow) == learning.searched(grid, 2, slow)


def test_the_winner_is_that_of_the_keys(spark):
    """Against a sort by the keys in Python, reversed as a whole for the balanced policy, so its tie-break is reversed, too."""
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    for _ in range(25):
        rows = [(k, pick(0.1, 0.2), pick(0.01, 0.02), pick(0.4, 0.6), pick(0.3, 0.5), pick(0.5, 0.7)) for k in ("none", "isotonic", "platt")]
        df = spark.createDataFrame(rows, "calibrator string, brier double, ece double, f1 double, prec double, rec double")
        assert learning.winner(df).first()["calibrator"] == min(rows, key=lambda r: (r[1], r[2], r[0] != "isotonic", r[0]))[0]
        deficit = lambda r: max(0, 0.5 - r[3]) * 2 + max(0, 0.4 - r[4]) + max(0, 0.6 - r[5])
        key = lambda r: (r[3] > 0.5 and r[4] > 0.4 and r[5] > 0.6, r[3], -r[1], -r[2], r[0] != "isotonic", -deficit(r))
        top = max(map(key, rows))
        assert learning.winner(df, (0.5, 0.4, 0.6)).first()["calibrator"] == min(r[0] for r in rows if key(r) == top)


def test_a_recall_that_nothing_reaches_is_an_error(spark):
    curve = spark.createDataFrame([(10, 0.5, 0.9), (20, 0.7, 0.6), (30, 0.7, 0.6)], "k int, prec double, rec double")
    assert tuple(metrics.precision_at_recall(curve, 0.6).first()) == (20, 0.7, 0.6)
    with pytest.raises(Exception, match="no threshold has a recall of 0.95"):
        metrics.precision_at_recall(curve, 0.95).collect()
