"""Models over feature columns with Spark ML: base trees, their stacked probabilities, meta-learners, calibrators, selection.

A frame of rows has feature columns and `label` (0 or 1). What a fit gathers is Spark's own aggregates; rows stay distributed.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations, product

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import metrics

SEED = 42


def assembled(rows: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """rows with a vector of columns; nulls are 0."""
    filled = rows.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol=out).transform(filled).drop(*[f"__{c}" for c in columns])


def balanced(rows: DataFrame, out: str = "weight") -> DataFrame:
    """rows with weights that make both labels count the same; one pair of counts reaches the driver."""
    n, p = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return rows.withColumn(out, F.when(F.col("label") == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1))))


def sampled(rows: DataFrame, most: int, key: str, seed: int = SEED) -> DataFrame:
    """About `most` rows, chosen by a seeded hash of a key; all of them where there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


#: Builders of the base models, by name: each takes options of the estimator.
BUILDERS: dict[str, Callable[..., object]] = {
    "boosted": lambda **o: GBTClassifier(**{"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": SEED, "weightCol": "weight", "validationIndicatorCol": "is_valid"} | o),
    "boosted_shallow": lambda **o: GBTClassifier(**{"maxIter": 30, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, "weightCol": "weight", "validationIndicatorCol": "is_valid"} | o),
    "random_forest": lambda **o: RandomForestClassifier(**{"numTrees": 40, "maxDepth": 8, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5", "seed": SEED, "weightCol": "weight"} | o),
    "random_splits": lambda **o: RandomForestClassifier(**{"numTrees": 40, "maxDepth": 8, "maxBins": 8, "subsamplingRate": 1.0, "featureSubsetStrategy": "0.5", "seed": SEED + 1, "weightCol": "weight"} | o),
    "logistic": lambda **o: LogisticRegression(**{"maxIter": 100, "regParam": 0.0, "weightCol": "weight"} | o),
}


def fitted(train: DataFrame, valid: DataFrame, columns: list[str], names: list[str]) -> dict[str, Model]:
    """The named base models; boosting stops early by the valid rows."""
    both = balanced(assembled(train.withColumn("is_valid", F.lit(False)).unionByName(valid.withColumn("is_valid", F.lit(True))), columns)).withColumn("label", F.col("label").cast("double"))
    return {n: BUILDERS[n]().fit(both if n.startswith("boosted") else both.filter("NOT is_valid")) for n in names}


def probability(model: Model, rows: DataFrame, out: str) -> DataFrame:
    """rows with the model's probability of label 1."""
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def stacked(models: dict[str, Model], rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with a probability column for each base model."""
    out = assembled(rows, columns)
    for n, m in models.items():
        out = probability(m, out, n)
    return out.drop("features")


def with_products(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with the products of all pairs of columns, without squares."""
    made = {f"{a}__{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    return rows.withColumns(made), [*columns, *made]


class Meta:
    """A meta-learner over stacked probabilities: fit(rows), predict_proba(rows) adds `meta`. kind: logistic, polynomial or boosted."""

    def __init__(self, kind: str, columns: list[str], c: float = 1.0) -> None:
        self.kind, self.columns, self.c = kind, columns, c
        self.model: Model | None = None

    def _rows(self, rows: DataFrame) -> DataFrame:
        rows, columns = with_products(rows, self.columns) if self.kind == "polynomial" else (rows, self.columns)
        return assembled(rows, columns)

    def fit(self, rows: DataFrame) -> Meta:
        ready = balanced(self._rows(rows)).withColumn("label", F.col("label").cast("double")).withColumn("is_valid", F.lit(False))
        if self.kind == "boosted":
            builder = GBTClassifier(maxIter=20, maxDepth=2, stepSize=0.1, seed=SEED, weightCol="weight")
        else:
            builder = BUILDERS["logistic"](regParam=1.0 / (self.c * max(1, rows.count())))
        self.model = builder.fit(ready)
        return self

    def predict_proba(self, rows: DataFrame, out: str = "meta") -> DataFrame:
        made = probability(self.model, self._rows(rows), out)
        return made.select(*rows.columns, out)


class Calibrator:
    """none, isotonic (ends held beyond the fit's scores) or platt (a logistic curve): fit(rows), predict(rows) adds `calibrated`."""

    def __init__(self, kind: str, score: str = "score") -> None:
        self.kind, self.score = kind, score
        self.model: Model | None = None

    def fit(self, rows: DataFrame) -> Calibrator:
        ready = rows.select(F.col("label").cast("double").alias("label"), F.col(self.score).cast("double").alias("x"))
        if self.kind == "isotonic":
            self.model = IsotonicRegression(featuresCol="x", labelCol="label").fit(ready)
        elif self.kind == "platt":
            self.model = LogisticRegression(regParam=1.0 / max(1, rows.count()), maxIter=100, standardization=False).fit(assembled(ready, ["x"]))
        return self

    def curve(self) -> list[tuple[float, float]]:
        """(score, value) of the isotonic curve's corners."""
        return list(zip(self.model.boundaries.toArray().tolist(), self.model.predictions.toArray().tolist(), strict=True))

    def predict(self, rows: DataFrame, out: str = "calibrated") -> DataFrame:
        if self.kind == "none":
            return rows.withColumn(out, F.col(self.score).cast("double"))
        if self.kind == "platt":
            return rows.withColumn(out, 1 / (1 + F.exp(-(F.lit(float(self.model.coefficients[0])) * F.col(self.score) + F.lit(float(self.model.intercept))))))
        made = self.model.transform(rows.withColumn("x", F.col(self.score).cast("double")))
        return made.withColumn(out, F.col("prediction")).select(*rows.columns, out)


def judged(rows: DataFrame, score: str, **names: str) -> DataFrame:
    """One row: rank measures, Brier score and calibration error of a score, with constant columns that say of what."""
    r = rows.select(F.col("label"), F.col(score).alias("score"))
    one = metrics.ranking_metrics(r).select("auc", "ap").crossJoin(metrics.calibration_error(r).select("brier", "ece")).crossJoin(r.agg(F.stddev_pop("score").alias("spread")))
    return one.withColumns({k: F.lit(v) for k, v in names.items()})


def winner(reports: DataFrame, least: tuple[float, float, float] | None = None) -> DataFrame:
    """The calibrator that wins of reports (calibrator, brier, ece, f1, prec, rec), one row.

    Without `least` that of the smallest Brier score, then of the smallest calibration error, then isotonic. With
    least = (f1, precision, recall), those that exceed all three come first, then the highest F1 counts, Brier score and
    error; of equals one that is not isotonic, then that of the smallest deficit. What is left goes by name.
    """
    isotonic = (F.col("calibrator") != "isotonic").cast("int")
    if least is None:
        return reports.orderBy("brier", "ece", isotonic, "calibrator").limit(1)
    bounds = list(zip(("f1", "prec", "rec"), least, (2.0, 1.0, 1.0), strict=True))
    meets = reduce(lambda a, b: a & b, [F.col(c) > x for c, x, _ in bounds])
    deficit = reduce(lambda a, b: a + b, [F.greatest(F.lit(0.0), x - F.col(c)) * w for c, x, w in bounds])
    return reports.orderBy(meets.desc(), F.desc("f1"), "brier", "ece", isotonic.desc(), deficit, "calibrator").limit(1)


def searched(grid: dict[str, list], trials: int, value: Callable[[dict], float], seed: int = SEED, parallel: int = 4) -> tuple[dict, float, list[tuple[int, dict, float, bool]]]:
    """A random search: `trials` different points of a grid by a seeded draw, `parallel` of them at once; the best point, its value, and all trials.

    Trials are (number, point, value, best): a point must be better than all before it to be the best so far, so the result
    doesn't depend on which trial ends first. Each trial's work is Spark's; a thread only waits for it.
    """
    points = [dict(zip(grid, p, strict=True)) for p in product(*grid.values())]
    chosen = random.Random(seed).sample(points, min(trials, len(points)))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        values = list(pool.map(value, chosen))
    course, top = [], None
    for i, (p, v) in enumerate(zip(chosen, values, strict=True)):
        better = top is None or v > top[1]
        top = (p, v) if better else top
        course.append((i, p, v, better))
    return top[0], top[1], course
