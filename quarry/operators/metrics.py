"""Binary classification metrics as aggregates over (label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scores import bin_of, slot_of
from quarry.operators.ranking import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates() -> dict[str, Column]:
    """Precision, recall and F1 from the columns tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"prec": ratio(tp, tp + fp), "rec": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn and the rates of `score >= threshold` against `label`."""
    y, f = F.col("label") == 1, F.col("score") >= threshold
    return df.agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn")).withColumns(rates())


def sweep(df: DataFrame, steps: int = 100) -> DataFrame:
    """A row for each threshold k / steps, k = 0 to steps: counts and rates of `score >= k / steps`.

    Scores are counted once by the last threshold that they reach; the curve is a running sum over steps + 1 rows.
    """
    x = F.col("score")
    at = slot_of(x, steps) + F.when(x >= 1.0, 1).otherwise(0)
    hist = df.filter(x >= 0).groupBy(at.cast("int").alias("k")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    total = df.agg(F.count_if(F.col("label") == 1).alias("pos"))
    down = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = grid.join(F.broadcast(hist), "k", "left").select("k", F.sum(F.coalesce("p", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("fp"))
    return counts.join(F.broadcast(total)).withColumn("fn", F.col("pos") - F.col("tp")).drop("pos").withColumns(rates())


def ranking_metrics(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision; 0 if there is one class only."""
    by = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    down = running(by, -slot_of(F.col("score"), buckets), [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    agg = down.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return agg.select(F.when(both, F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(0.0).alias("auc"), F.when(both, F.col("steps") / F.col("pos")).otherwise(0.0).alias("ap"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each bin of equal width, empty ones included: count, mean score, share of label 1."""
    got = df.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("positive", F.lit(0.0)).alias("positive"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error."""
    got = df.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"), F.sum((F.col("score") - F.col("label")) ** 2).alias("q"))
    return got.agg((F.sum("q") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def trust(df: DataFrame, models: list[str], bins: int = 20, weight: float = 2.0) -> DataFrame:
    """(model, bin, n, trust): the share of label 1 in each bin of a model's scores, drawn to the global share."""
    long = df.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("x")) for m in models])).alias("s")).select("label", "s.*")
    got = long.groupBy("model", bin_of(F.col("x"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    grid = df.sparkSession.range(bins).select(F.explode(F.array(*map(F.lit, models))).alias("model"), F.col("id").cast("int").alias("bin"))
    total = df.agg(F.avg("label").alias("g"))
    full = grid.join(F.broadcast(got), ["model", "bin"], "left").join(F.broadcast(total))
    n, y = F.coalesce("n", F.lit(0)), F.coalesce("y", F.lit(0))
    return full.select("model", "bin", n.alias("n"), ((y + F.col("g") * weight) / (n + weight)).alias("trust"))


def precision_at_recall(curve: DataFrame, floor: float) -> DataFrame:
    """The row (k, prec, rec) of the highest precision whose recall reaches a floor, then of the highest recall, then the lowest threshold; an error where none does."""
    best = curve.filter(F.col("rec") >= floor).agg(F.min_by(F.struct("k", "prec", "rec"), F.struct(-F.col("prec"), -F.col("rec"), "k")).alias("x"))
    return best.select(F.when(F.col("x").isNull(), F.raise_error(F.lit(f"no threshold has a recall of {floor}"))).otherwise(F.col("x")).alias("x")).select("x.*")
