"""Queries on models: stacked base models with calibrated scores, and how calibrators compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import forests, learning, metrics
from quarry.operators.learning import Calibrator, Meta
from quarry.plans import scores
from quarry.sources.places import shared

COLUMNS = ["chars", "words", "lines", "digits", "upper", "signs"]
NAMES = ["boosted", "boosted_shallow", "random_forest", "random_splits"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with numbers that say how their texts look, written once; fold 0 to 9 by id."""
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    t, n = F.coalesce("text", F.lit("")), F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    share = lambda p: F.regexp_count(t, F.lit(p)) / n
    rows = d.select("doc_id", F.coalesce("quality", F.lit(0)).alias("label"), F.log1p(F.length(t)).alias("chars"), F.log1p(F.regexp_count(t, F.lit(r"\S+"))).alias("words"), share("\n").alias("lines"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"), share(r"[^\p{L}\p{N}\s]").alias("signs"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)).alias("fold"))
    path = shared(spark, "features")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _stack(spark: SparkSession, sf: str) -> DataFrame:
    """Folds 0 to 4 fit the base models, 5 and 6 the meta-learner, 7 the calibrator; all rows get all scores."""
    rows = features(spark, sf)
    part = lambda lo, hi: rows.filter(F.col("fold").between(lo, hi))
    models = learning.fitted(part(0, 3), part(4, 4), COLUMNS, NAMES)
    table = learning.stacked(models, rows, COLUMNS)
    path = shared(spark, "stacked")
    table.write.parquet(path)
    return spark.read.parquet(path)


def stacked_scores(spark, sf):
    """Base probabilities, meta score and calibrated score of each labelled document."""
    table = _stack(spark, sf)
    meta = Meta("logistic", NAMES).fit(table.filter(F.col("fold").between(5, 6))).predict_proba(table)
    cal = Calibrator("isotonic", "meta").fit(meta.filter("fold = 7"))
    return cal.predict(meta).select("doc_id", "label", "fold", *NAMES, "meta", "calibrated")


def model_report(spark, sf):
    """Each base model and meta-learner on held-out folds 8 and 9."""
    table = _stack(spark, sf)
    held = lambda df: df.filter("fold >= 8")
    out = None
    for n in NAMES:
        r = learning.judged(held(table), n, model=n)
        out = r if out is None else out.unionByName(r)
    for kind in ("logistic", "polynomial", "boosted"):
        meta = Meta(kind, NAMES).fit(table.filter(F.col("fold").between(5, 7))).predict_proba(table)
        out = out.unionByName(learning.judged(held(meta), "meta", model=f"meta_{kind}"))
    return out


def forest_report(spark, sf):
    """Extra trees and a forest whose trees see both classes the same, fitted on folds 0 to 4, on held-out folds 8 and 9."""
    rows = features(spark, sf)
    out = None
    for name, bins in (("extra_trees", 0), ("balanced_forest", 16)):
        forest = forests.Forest(trees=20, levels=6, samples=0.7 if bins == 0 else 0.8, bins=bins).fit(rows.filter("fold <= 4"), COLUMNS, "doc_id")
        r = learning.judged(forest.predict(rows.filter("fold >= 8"), "score"), "score", model=name)
        out = r if out is None else out.unionByName(r)
    return out


def _f1(rows: DataFrame, score: str) -> float:
    """The best F1 on a grid of thresholds from 0.20 to 0.80."""
    curve = metrics.sweep(rows.select("label", F.col(score).alias("score"))).filter("k between 20 and 80 and k % 2 = 0")
    return curve.agg(F.coalesce(F.max("f1"), F.lit(0.0))).first()[0]


def meta_search(spark, sf):
    """Trials of a seeded search for a meta-learner: kinds and strengths of regularisation, fitted on folds 5 and 6, by the best F1 on fold 7; then the winner fitted anew on all three folds, by its F1 on folds 8 and 9."""
    table = _stack(spark, sf)
    fit, valid, held = table.filter(F.col("fold").between(5, 6)), table.filter("fold = 7"), table.filter("fold >= 8")
    made = lambda p, rows: Meta(p["kind"], NAMES, p["c"]).fit(rows)
    best, top, trials = learning.searched({"kind": ["logistic", "polynomial"], "c": [0.01, 0.1, 1.0, 10.0]}, 6, lambda p: _f1(made(p, fit).predict_proba(valid), "meta"))
    again = _f1(made(best, table.filter(F.col("fold").between(5, 7))).predict_proba(held), "meta")
    rows = [(i, p["kind"], p["c"], v, better, p == best, again if p == best else None) for i, p, v, better in trials]
    return spark.createDataFrame(rows, "trial int, kind string, c double, f1 double, improved boolean, chosen boolean, held_f1 double")


def calibration_report(spark, sf):
    """No, isotonic and logistic calibration of a score, fitted on even and judged on odd documents."""
    s = scores.scored(spark, sf)
    fit, held = s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1")
    out = None
    for kind in ("none", "isotonic", "platt"):
        r = learning.judged(Calibrator(kind).fit(fit).predict(held), "calibrated", calibrator=kind)
        out = r if out is None else out.unionByName(r)
    return out


def calibration_winner(spark, sf):
    """The calibrators at the threshold of a flag, fitted on even and judged on odd documents, with the winner by error and that by the balanced policy."""
    s = scores.scored(spark, sf)
    fit, held = s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1")
    out = None
    for kind in ("none", "isotonic", "platt"):
        made = Calibrator(kind).fit(fit).predict(held).select("label", F.col("calibrated").alias("score"))
        at = metrics.sweep(made).filter(F.col("k") == round(100 * S.FLAG)).select("prec", "rec", "f1")
        r = learning.judged(made, "score", calibrator=kind).select("calibrator", "brier", "ece").crossJoin(at)  # one row each
        out = r if out is None else out.unionByName(r)
    path = shared(spark, "reports")
    out.write.parquet(path)
    out = spark.read.parquet(path)
    won = lambda policy, rows: rows.select(F.lit(policy).alias("policy"), "calibrator", "brier", "ece", "f1")
    return won("error", learning.winner(out)).unionByName(won("balanced", learning.winner(out, (0.5, 0.4, 0.6))))


def calibration_grid(spark, sf):
    """Recall floors 0.45 to 0.70 with both calibrators, fitted, chosen and judged on different documents.

    Half of the documents fit a calibrator, a quarter chooses the threshold of the highest precision for each floor, and
    the pair with the best F1 at it; the last quarter says what that F1 is on rows that chose nothing (held_f1).
    """
    s = scores.scored(spark, sf)
    out = None
    for kind in ("isotonic", "platt"):
        made = Calibrator(kind).fit(s.filter("doc_id % 2 = 0"))
        curve = lambda part: metrics.sweep(made.predict(s.filter(f"doc_id % 4 = {part}")).select("label", F.col("calibrated").alias("score")))  # noqa: B023, E731
        both = curve(1).join(curve(3).select("k", F.col("f1").alias("held_f1")), "k").withColumn("calibrator", F.lit(kind))
        out = both if out is None else out.unionByName(both)
    at = out.select("calibrator", "k", "prec", "rec", "f1", "held_f1", F.explode(F.array(*[F.lit(x / 100) for x in range(45, 71, 5)])).alias("floor")).filter("rec >= floor")
    first = at.groupBy("calibrator", "floor").agg(F.min_by(F.struct("k", "prec", "rec", "f1", "held_f1"), F.struct(-F.col("prec"), -F.col("rec"), "k")).alias("x")).select("calibrator", "floor", "x.*")
    return first.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), "floor", "calibrator")) == 1)


def isotonic_fit(spark, sf):
    """The isotonic curve at each score of the fit."""
    s = scores.scored(spark, sf)
    cal = Calibrator("isotonic").fit(s)
    return cal.predict(s.select("score").distinct()).select("score", F.round("calibrated", 6).alias("calibrated"))


QUERIES = {
    "stacked_scores": (stacked_scores, None),
    "model_report": (model_report, None),
    "forest_report": (forest_report, None),
    "meta_search": (meta_search, None),
    "calibration_report": (calibration_report, None),
    "calibration_grid": (calibration_grid, None),
    "calibration_winner": (calibration_winner, None),
    "isotonic_fit": (
        isotonic_fit,
        scores.BASE + """, g AS (SELECT score, sum(label) AS y, count(*) AS n, row_number() OVER (ORDER BY score) AS i FROM s GROUP BY score), c AS (SELECT score, i, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM g),
        a AS (SELECT lo.i AS lo, hi.i AS hi, (hi.cy - coalesce(b.cy, 0))::DOUBLE / (hi.cn - coalesce(b.cn, 0)) AS mean FROM c lo JOIN c hi ON hi.i >= lo.i LEFT JOIN c b ON b.i = lo.i - 1),
        m AS (SELECT lo, hi, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS least FROM a)
        SELECT score, round(max(least), 6) AS calibrated FROM c JOIN m ON m.lo <= c.i AND m.hi = c.i GROUP BY score""",
    ),
}
