"""Functions with their windows as nested records, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores as S

STATUSES = ["agree_positive", "agree_negative", "review_suggested", "diffuse_risk"]


def numbered(windows: DataFrame, group: str, order: str) -> DataFrame:
    """windows with window_index, their place from 0 in their group."""
    return windows.withColumn("window_index", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def assembled(functions: DataFrame, windows: DataFrame, group: str, triage: float = S.REVIEW, confirmed: float = S.CONFIRMED, tolerance: float = 1e-6) -> DataFrame:
    """functions (group, score) with their windows (group, window_id, window_index, window_prob, label) as one record each.

    windows is sorted by index; flagged, confirmed and contributing are those from the triage and confirmed thresholds on
    and those within a tolerance of the highest. A function without windows has empty lists, label 0 and no highest
    probability. A function's windows are gathered in one row, as they are one record.
    """
    w = windows.groupBy(group).agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("window_index", "window_id", "window_prob"))).alias("windows"))
    rows = functions.join(w, group, "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<struct<window_index:int,window_id:bigint,window_prob:double>>")))
    rows = rows.withColumn("max_window_prob", F.array_max(F.transform("windows", lambda x: x["window_prob"])))
    top = F.col("max_window_prob")
    some = lambda test: F.filter("windows", test)
    rows = rows.withColumns({"flagged": some(lambda x: x["window_prob"] >= triage), "confirmed": some(lambda x: x["window_prob"] >= confirmed), "contributing": some(lambda x: F.abs(x["window_prob"] - top) <= tolerance)})
    tiers = S.deployment(F.col("score"))
    tiers["precision_tier"] = S.precision_tier(tiers["function_flagged"], F.size("confirmed") > 0)
    return rows.withColumns({"label": F.coalesce("label", F.lit(0)), "window_count": F.size("windows"), **tiers, "agreement": S.agreement(tiers["function_flagged"], F.size("flagged") > 0)})


def indices(windows: Column) -> Column:
    return F.array_join(F.transform(windows, lambda x: x["window_index"].cast("string")), ",")


def breakdown(records: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count, share and labels of each value of a column, those that don't occur too."""
    n = records.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("label_1"))
    names = records.sparkSession.createDataFrame([(v,) for v in values], "value string")
    full = names.join(F.broadcast(n), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label_1", F.lit(0)).alias("label_1"))
    total = full.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select("value", "n", "label_1", (F.col("n") - F.col("label_1")).alias("label_0"), F.format_string("%.1f%%", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0)).alias("percent"))


def binary(records: DataFrame, **tests: Column) -> DataFrame:
    """Confusion and rates of several predicates at once: a row for each."""
    s = records.select("label", F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*tests.values()))).alias("name", "hit"))
    y = F.col("label") == 1
    g = s.groupBy("name").agg(F.count_if(F.col("hit") & y).alias("tp"), F.count_if(F.col("hit") & ~y).alias("fp"), F.count_if(~F.col("hit") & y).alias("fn"), F.count_if(~F.col("hit") & ~y).alias("tn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return g.withColumns({"prec": rate(tp, tp + fp), "rec": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def located(code: Column, window: Column) -> tuple[Column, Column]:
    """First and last line of a window in its code: where it stands as it is, else from the first line that holds its first line, else all lines."""
    lines, inner = F.split(code, "\n"), F.filter(F.split(window, "\n"), lambda x: F.trim(x) != "")
    at = F.instr(code, F.trim(window))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    exact = breaks(F.left(code, at - 1)) + 1
    head = F.trim(F.element_at(inner, 1))
    found = F.array_position(F.transform(lines, lambda x: F.contains(x, head)), F.lit(True))
    blank, size = F.trim(window) == "", F.size(lines)
    start = F.when(blank, 1).when(at > 0, exact).when(found > 0, found).otherwise(1)
    end = F.when(blank, size).when(at > 0, exact + breaks(F.trim(window))).when(found > 0, F.least(found + F.size(inner) - 1, size)).otherwise(size)
    return start.cast("int"), end.cast("int")
