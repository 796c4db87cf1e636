"""Queries on outputs: what a run writes, under one manifest, and what is read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import records as R
from quarry.operators import windows
from quarry.operators.learning import Calibrator
from quarry.plans import corpus, learning, records, scores
from quarry.sources import bundles, readers, writers
from quarry.sources.bundles import Bundle
from quarry.sources.places import shared

SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"


def windowed_sink(spark, sf):
    """Token windows of all texts by split; the tokens of the train split's texts, read back."""
    w = windows.expanded(corpus._docs(spark, sf), "doc_id", "text").withColumn("split", F.expr(SPLIT.replace("doc_id", "function_group_id")))
    b = bundles.windowed(Bundle(spark, shared(spark, "bundle")), w).close()
    return b.read("windowed").filter("split = 'train'").groupBy(F.col("function_group_id").alias("doc_id")).agg(F.sum("token_count").alias("tokens"))


def embedding_sink(spark, sf):
    """Embeddings as windows of groups, by split, with the manifest's count beside each split's."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select(F.concat_ws("_w", (F.col("vec_id") / 3).cast("long").cast("string"), (F.col("vec_id") % 3).cast("string")).alias("window_id"), (F.col("vec_id") / 3).cast("long").alias("function_group_id"), "label", "embedding", F.expr(SPLIT.replace("doc_id", "vec_id")).alias("split"))
    b = bundles.embedded(Bundle(spark, shared(spark, "bundle")), rows).close()
    n = b.manifest().select(F.col("n_rows").alias("n_all"))
    return b.read("embeddings").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("function_group_id").alias("n_groups"), F.max(F.length("window_id")).alias("longest")).crossJoin(F.broadcast(n))  # one row


def prediction_sink(spark, sf):
    """Each model's probabilities by split, from one pass."""
    rows = scores.scored(spark, sf).withColumn("split", F.expr(SPLIT))
    b = bundles.predicted(Bundle(spark, shared(spark, "bundle")), rows, scores.MODELS, "doc_id").close()
    return b.read("predictions").groupBy("model", "split").agg(F.count("*").alias("n"), F.round(F.sum("prob"), 6).alias("total"), F.sum("label").alias("positive"))


def calibrated_sink(spark, sf):
    """Raw and calibrated scores, read back."""
    s = scores.scored(spark, sf)
    made = Calibrator("isotonic").fit(s).predict(s)
    b = bundles.calibrated(Bundle(spark, shared(spark, "bundle")), made, "doc_id", "score", "calibrated").close()
    return b.read("calibrated").select("doc_id", "raw_score", F.round("calibrated_score", 6).alias("calibrated_score"), "label")


def aggregation_sink(spark, sf):
    """Records whole and slim with their breakdown; flagged windows counted in the JSON, tiers from the Parquet, shares from the CSV."""
    path = shared(spark, "records")
    records._records(spark, sf).write.parquet(path)
    r = spark.read.parquet(path)
    b = bundles.aggregated(Bundle(spark, shared(spark, "bundle")), r, "user_id", ["score", "deployment_tier", "agreement"], {"statuses": R.breakdown(r, "agreement", R.STATUSES)}).close()
    whole = b.read("records").select("user_id", F.size("flagged").alias("n_flagged"), F.size("windows").alias("n_windows"))
    share = b.read("statuses").select(F.col("value").alias("agreement"), "percent")
    return b.read("slim").join(whole, "user_id").join(F.broadcast(share), "agreement").select("user_id", "deployment_tier", "agreement", "n_flagged", "n_windows", "percent")


def curve_sink(spark, sf):
    """A sweep written as CSV with its chosen row as text, both read again: the row that the text names is chosen."""
    path = shared(spark, "curve")
    writers.curve(scores.threshold_sweep(spark, sf), path, scores.best_f1(spark, sf))
    chosen = readers.text_lines(spark, f"{path}/chosen").select(F.regexp_extract("line", r"^k=(\d+) ", 1).cast("int").alias("k"), F.lit(True).alias("chosen"))
    curve = readers.csv_rows(spark, f"{path}/curve", "k int, tp long, fp long, fn long, prec double, rec double, f1 double")
    return curve.join(F.broadcast(chosen), "k", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))  # one row is chosen


PREDICTED = scores.BASE + f", l AS (UNPIVOT s ON m1, m2, m3, m4 INTO NAME model VALUE x) SELECT model, {SPLIT} AS split, count(*) AS n, round(sum(x), 6) AS total, sum(label)::BIGINT AS positive FROM l GROUP BY ALL"

QUERIES = {
    "curve_sink": (curve_sink, scores.CURVE + "SELECT k, tp, fp, fn, prec, rec, f1, k = (SELECT k FROM w WHERE k BETWEEN 20 AND 80 AND k % 2 = 0 ORDER BY f1 DESC, k LIMIT 1) AS chosen FROM w"),
    "windowed_sink": (windowed_sink, f"SELECT doc_id, {corpus.tokens_sql("coalesce(text, '')")}::BIGINT AS tokens FROM documents WHERE doc_id % 10 > 1"),
    "embedding_sink": (embedding_sink, f"SELECT {SPLIT.replace('doc_id', 'vec_id')} AS split, count(*) AS n, count(DISTINCT vec_id // 3) AS n_groups, max(length((vec_id // 3)::VARCHAR)) + 3 AS longest, (SELECT count(*) FROM embeddings) AS n_all FROM embeddings GROUP BY 1"),
    "prediction_sink": (prediction_sink, PREDICTED),
    "calibrated_sink": (calibrated_sink, "WITH i AS (" + learning.QUERIES["isotonic_fit"][1] + "), " + scores.BASE.removeprefix("WITH ") + "SELECT doc_id, s.score AS raw_score, calibrated AS calibrated_score, label FROM s JOIN i ON i.score = s.score"),
    "aggregation_sink": (aggregation_sink, records.WINDOWS + "SELECT user_id, deployment_tier, agreement, n_flagged::INT AS n_flagged, window_count AS n_windows, printf('%.1f%%', 100.0 * count(*) OVER (PARTITION BY agreement) / count(*) OVER ()) AS percent FROM r"),
}
