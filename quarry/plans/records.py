"""Queries on function records: assembly, breakdowns, sweeps, lookups, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import metrics, records
from quarry.plans import scores, snippets


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as windows of users."""
    p = scores.parts(spark, sf).select("user_id", F.col("event_id").alias("window_id"), F.round(F.col("score") - 0.3, 6).alias("window_prob"), (F.col("event_id") % 97 == 0).cast("int").alias("label"))
    return records.numbered(p, "user_id", "window_id")


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """Users as functions with a pooled score; each seventh one's windows are not known, and some have a user number without windows."""
    own = scores.pooled(spark, sf).select("user_id", F.round(F.col("pooled") - 0.32, 6).alias("score"))
    return own.unionByName(own.select((F.col("user_id") + 100_000).alias("user_id"), "score").filter("user_id % 7 = 0"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return records.assembled(functions(spark, sf), windows(spark, sf), "user_id", confirmed=0.25, triage=0.2)


def function_records(spark, sf):
    r = _records(spark, sf)
    return r.select("user_id", "label", "score", "window_count", F.round("max_window_prob", 6).alias("max_window_prob"), records.indices(F.col("flagged")).alias("flagged_indices"), F.size("confirmed").alias("n_confirmed"), F.array_join(F.transform("contributing", lambda x: x["window_id"].cast("string")), ",").alias("contributing_ids"), "deployment_tier", "precision_tier", "agreement")


def status_breakdown(spark, sf):
    return records.breakdown(_records(spark, sf), "agreement", records.STATUSES)


def tier_metrics(spark, sf):
    r = _records(spark, sf)
    return records.binary(r, confirmed=F.col("precision_tier") == "confirmed", user_facing=F.col("precision_tier").isin("confirmed", "investigate"), agree_positive=F.col("agreement") == "agree_positive")


#: The threshold that is deployed; the sweep marks the nearest of its own, the lower of two.
CURRENT = 0.32


def deployed_sweep(spark, sf):
    """Thresholds 0.10 to 0.90: the function's score alone, or any window from triage on, or with a confirmed window; and which is nearest to the deployed one."""
    r = _records(spark, sf).select("label", "score", F.coalesce("max_window_prob", F.lit(0.0)).alias("top"))
    k = r.select("*", F.explode(F.sequence(F.lit(10), F.lit(90))).alias("k"))
    hit, y = F.col("score") >= F.col("k") / 100.0, F.col("label") == 1
    tests = {"function": hit, "union": hit | (F.col("top") >= S.REVIEW), "confirmed": hit & (F.col("top") >= S.CONFIRMED)}
    nearest = min(range(10, 91), key=lambda x: (abs(x / 100 - CURRENT), x))
    return k.groupBy("k").agg(*[F.count_if(t if y_ else ~y & t).alias(f"{n}_{c}") for n, t in tests.items() for c, y_ in (("flagged", True), ("false", False))]).withColumn("current", F.col("k") == nearest)


def disagreement_pool(spark, sf):
    """Scores weighted by trust over how far each is from the others."""
    m = [F.col(c) for c in scores.MODELS]
    trust = [0.9, 0.7, 0.5, 0.3]
    weight = [F.lit(t) / (1e-6 + sum((F.abs(x - o) for j, o in enumerate(m) if j != i), F.lit(0.0)) / 3) for i, (x, t) in enumerate(zip(m, trust, strict=True))]
    total = sum(weight, F.lit(0.0))
    return scores.scored(spark, sf).select("doc_id", F.round(sum((x * w for x, w in zip(m, weight, strict=True)), F.lit(0.0)) / total, 6).alias("pooled"))


def expected_actual(spark, sf):
    """Expected rows with what was found for (file, function), the last of repeated ones; what is missing is marked."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    want = o.select("o_orderkey", (F.col("o_custkey") % 300).alias("file"), (F.col("o_orderkey") % 5).alias("name"))
    found = o.filter("o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 300).alias("file"), (F.col("o_orderkey") % 5).alias("name")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return want.join(found, ["file", "name"], "left").select("o_orderkey", F.coalesce("status", F.lit("missing")).alias("status"))


def window_code_lookup(spark, sf):
    """Code of windows by their id; none where there is no code."""
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("window_id"), "lang")
    return windows(spark, sf).select("window_id").join(d, "window_id", "left").select("window_id", F.coalesce("lang", F.lit("")).alias("code"))


def marker_merge(spark, sf):
    """Alerts of functions and markers of windows of a user in the order of their lines, alerts first."""
    alerts = functions(spark, sf).filter("score >= 0.2 AND user_id < 100000").select("user_id", (F.col("user_id") % 13).alias("line"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"))
    marks = windows(spark, sf).filter("window_prob >= 0.1").select("user_id", (F.col("window_id") % 29).alias("line"), F.lit(1).alias("kind"), F.col("window_id").alias("id"))
    w = Window.partitionBy("user_id").orderBy("line", "kind", "id")
    return alerts.unionByName(marks).withColumn("place", F.row_number().over(w))


def window_location(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", snippets.code(F.col("doc_id"), F.col("text")).alias("code"))
    window = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "  return 0;\n}").when(F.col("doc_id") % 5 == 2, "\n  return\n  nothing").otherwise("no such line")
    start, end = records.located(F.col("code"), window)
    return d.select("doc_id", start.alias("first_line"), end.alias("last_line"))


def candidate_order(spark, sf):
    """Models of each language in the order of policy, F1 and Brier score."""
    s = scores.scored(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    hit, y = F.col("score") >= S.FLAG, F.col("label") == 1
    g = s.groupBy("lang").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.round(F.avg((F.col("score") - F.col("label")) ** 2), 6).alias("brier"))
    f1 = F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 6)
    g = g.select("lang", f1.alias("f1"), "brier").withColumn("meets", F.col("f1") > 0.7)
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("meets"), F.desc("f1"), "brier", "lang")))


def pooled_lift(spark, sf):
    """Trust as a lift over the base rate; a profile has as many rows as models and bins."""
    rows = scores.scored(spark, sf)
    base = rows.agg(F.greatest(F.avg("label"), F.lit(1e-6)).alias("base"))
    return metrics.trust(rows, scores.MODELS).crossJoin(F.broadcast(base)).select("model", "bin", F.round(F.col("trust") / F.col("base"), 6).alias("lift"))


WINDOWS = scores.POOL + """, w AS (SELECT user_id, event_id AS window_id, round(score - 0.3::DOUBLE, 6) AS window_prob, (event_id % 97 = 0)::INT AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS window_index FROM p),
fn AS (SELECT user_id, round(least(1, base + uplift) - 0.32::DOUBLE, 6) AS score FROM u UNION ALL SELECT user_id + 100000, round(least(1, base + uplift) - 0.32::DOUBLE, 6) FROM u WHERE (user_id + 100000) % 7 = 0),
t AS (SELECT user_id, max(window_prob) AS top FROM w GROUP BY user_id),
g AS (SELECT fn.user_id, fn.score, coalesce(max(label), 0) AS label, count(window_id)::INT AS window_count, max(window_prob) AS max_window_prob, count(*) FILTER (window_prob >= 0.2) AS n_flagged, (count(*) FILTER (window_prob >= 0.25))::INT AS n_confirmed,
list(window_index ORDER BY window_index) FILTER (window_prob >= 0.2) AS f, list(window_id ORDER BY window_index) FILTER (abs(window_prob - top) <= 1e-6) AS c FROM fn LEFT JOIN w USING (user_id) LEFT JOIN t USING (user_id) GROUP BY fn.user_id, fn.score),
r AS (SELECT *, CASE WHEN score >= 0.32 THEN 'vuln' WHEN score >= 0.26 THEN 'needs_review' ELSE 'safe' END AS deployment_tier, CASE WHEN score >= 0.32 AND n_confirmed > 0 THEN 'confirmed' WHEN n_confirmed > 0 THEN 'investigate' WHEN score >= 0.32 THEN 'soft_review' ELSE 'safe' END AS precision_tier,
CASE WHEN score >= 0.32 AND n_flagged > 0 THEN 'agree_positive' WHEN score >= 0.32 THEN 'diffuse_risk' WHEN n_flagged > 0 THEN 'review_suggested' ELSE 'agree_negative' END AS agreement FROM g) """
WINDOWS = WINDOWS.replace(", r AS (SELECT user_id, round(least(1, base + uplift), 6) AS score, round(base, 6) AS top FROM u) ", "").replace("\nr AS (SELECT user_id, round(least(1, base + uplift), 6) AS score, round(base, 6) AS top FROM u) , w", " w")
TESTS = {"function": "{h}", "union": "({h} OR top >= 0.26)", "confirmed": "({h} AND top >= 0.42)"}
LOCATED = f"""WITH d AS (SELECT doc_id, {snippets.CODE_SQL} AS code, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN E'  return 0;\\n}}' WHEN 2 THEN E'\\n  return\\n  nothing' ELSE 'no such line' END AS win FROM documents),
e AS (SELECT *, string_split(code, E'\\n') AS lines, list_filter(string_split(win, E'\\n'), lambda x: trim(x) <> '') AS inner_, instr(code, trim(win)) AS pos FROM d), f AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: contains(x, trim(inner_[1]))), true), 0) AS hit, len(code[:pos - 1]) - len(replace(code[:pos - 1], E'\\n', '')) + 1 AS exact FROM e)
SELECT doc_id, CASE WHEN trim(win) = '' THEN 1 WHEN pos > 0 THEN exact WHEN hit > 0 THEN hit ELSE 1 END::INT AS first_line, CASE WHEN trim(win) = '' THEN len(lines) WHEN pos > 0 THEN exact + len(trim(win)) - len(replace(trim(win), E'\\n', '')) WHEN hit > 0 THEN least(hit + len(inner_) - 1, len(lines)) ELSE len(lines) END::INT AS last_line FROM f"""

QUERIES = {
    "function_records": (function_records, WINDOWS + "SELECT user_id, label, score, window_count, max_window_prob, coalesce(array_to_string(f, ','), '') AS flagged_indices, n_confirmed, coalesce(array_to_string(c, ','), '') AS contributing_ids, deployment_tier, precision_tier, agreement FROM r"),
    "status_breakdown": (status_breakdown, WINDOWS + "SELECT v AS value, count(agreement) AS n, count(*) FILTER (label = 1) AS label_1, count(agreement) - count(*) FILTER (label = 1) AS label_0, printf('%.1f%%', 100.0 * count(agreement) / (SELECT count(*) FROM r)) AS percent FROM (SELECT unnest(['agree_positive', 'agree_negative', 'review_suggested', 'diffuse_risk']) AS v) LEFT JOIN r ON agreement = v GROUP BY v"),
    "tier_metrics": (
        tier_metrics,
        WINDOWS + f"""SELECT * FROM (SELECT name, tp, fp, fn, tn, {scores.RATES} FROM (SELECT name, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn, count(*) FILTER (NOT hit AND label = 0) AS tn
        FROM (SELECT label, unnest(['confirmed', 'user_facing', 'agree_positive']) AS name, unnest([precision_tier = 'confirmed', precision_tier IN ('confirmed', 'investigate'), agreement = 'agree_positive']) AS hit FROM r) GROUP BY name))""",
    ),
    "deployed_sweep": (deployed_sweep, WINDOWS + "SELECT k::INT AS k, k = 32 AS current, " + ", ".join(f"count(*) FILTER ({t.format(h='score >= k::DOUBLE / 100')}) AS {n}_flagged, count(*) FILTER ({t.format(h='score >= k::DOUBLE / 100')} AND label = 0) AS {n}_false" for n, t in TESTS.items()) + " FROM (SELECT *, coalesce(max_window_prob, 0) AS top FROM r), range(10, 91) q(k) GROUP BY k"),
    "disagreement_pool": (
        disagreement_pool,
        scores.BASE + ", d AS (SELECT *, " + ", ".join(f"{t}::DOUBLE / (1e-6 + ({' + '.join(f'abs(m{i} - m{j})' for j in range(1, 5) if j != i)}) / 3) AS w{i}" for i, t in zip(range(1, 5), (0.9, 0.7, 0.5, 0.3), strict=True)) + " FROM s) SELECT doc_id, round((m1 * w1 + m2 * w2 + m3 * w3 + m4 * w4) / (w1 + w2 + w3 + w4), 6) AS pooled FROM d",
    ),
    "expected_actual": (expected_actual, "WITH o AS (SELECT o_orderkey, o_custkey % 300 AS file, o_orderkey % 5 AS name, o_orderstatus FROM orders), f AS (SELECT file, name, arg_max(o_orderstatus, o_orderkey) AS status FROM o WHERE o_orderkey % 3 = 0 GROUP BY ALL) SELECT o_orderkey, coalesce(status, 'missing') AS status FROM o LEFT JOIN f USING (file, name)"),
    "window_code_lookup": (window_code_lookup, "SELECT event_id AS window_id, coalesce(lang, '') AS code FROM events LEFT JOIN documents ON doc_id = event_id AND doc_id % 3 = 0"),
    "marker_merge": (marker_merge, WINDOWS + ", a AS (SELECT user_id, user_id % 13 AS line, 0 AS kind, 0::BIGINT AS id FROM fn WHERE score >= 0.2 AND user_id < 100000 UNION ALL SELECT user_id, window_id % 29, 1, window_id FROM w WHERE window_prob >= 0.1) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line, kind, id)::INT AS place FROM a"),
    "window_location": (window_location, LOCATED),
    "candidate_order": (
        candidate_order,
        scores.BASE.replace("SELECT doc_id,", "SELECT doc_id, lang,") + ", g AS (SELECT lang, round(coalesce(2 * count(*) FILTER (score >= 0.32 AND label = 1) / nullif(count(*) FILTER (score >= 0.32) + count(*) FILTER (label = 1), 0)::DOUBLE, 0), 6) AS f1, round(avg((score - label) ** 2), 6) AS brier FROM s GROUP BY lang) SELECT *, f1 > 0.7 AS meets, row_number() OVER (ORDER BY f1 > 0.7 DESC, f1 DESC, brier, lang)::INT AS place FROM g",
    ),
    "pooled_lift": (pooled_lift, scores.TRUST + "SELECT model, bin, round(trust / greatest((SELECT g FROM g), 1e-6), 6) AS lift FROM t"),
}
