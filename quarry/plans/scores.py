"""Queries on scores: metrics, thresholds, calibration, pooling, tiers, boosts, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import metrics, pooling
from quarry.operators.signatures import near_confidence

MODELS = ["m1", "m2", "m3", "m4"]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score and four model columns, all from n_chars."""
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    x = lambda a: ((F.col("n_chars") * a) % 1001).cast("double") / 1000.0
    return d.select("doc_id", F.col("quality").alias("label"), x(1).alias("score"), *[x(a).alias(m) for a, m in zip((1, 3, 7, 11), MODELS, strict=True)])


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as parts of users, with a score that grows with their value."""
    v = F.col("value")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", (v / (v + 400.0)).alias("score"))


def pooled(spark, sf):
    return pooling.composite(parts(spark, sf), "user_id")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def confusion_at_threshold(spark, sf):
    return _rounded(metrics.confusion(scored(spark, sf), S.FLAG), "prec", "rec", "f1")


def threshold_sweep(spark, sf):
    return _rounded(metrics.sweep(scored(spark, sf)), "prec", "rec", "f1")


def _first(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order).limit(1)


def best_f1(spark, sf):
    return _first(threshold_sweep(spark, sf).filter("k between 20 and 80 and k % 2 = 0").select("k", "f1"), F.desc("f1"), "k")


def precision_at_recall(spark, sf):
    return metrics.precision_at_recall(threshold_sweep(spark, sf), 0.6)


def policy_select(spark, sf):
    """The best F1 within the policy's bounds, else the least deficit, with the recall nearest to their middle."""
    s = threshold_sweep(spark, sf).withColumn("meets", (F.col("prec") > 0.4) & (F.col("rec") > 0.6) & (F.col("rec") <= 0.7) & (F.col("f1") > 0.5))
    gap = lambda c, x: F.greatest(F.lit(0.0), F.lit(x) - F.col(c))
    s = s.withColumn("deficit", F.round(F.when(F.col("meets"), 0.0).otherwise(2 * gap("f1", 0.5) + gap("prec", 0.4) + gap("rec", 0.6) + F.greatest(F.lit(0.0), F.col("rec") - 0.7)), 6))
    tie = F.when(F.col("meets"), -F.col("rec")).otherwise(F.round(F.abs(F.col("rec") - 0.65), 6))
    return _first(s.select("k", "meets", "deficit", "f1", "prec", "rec", tie.alias("tie")), F.desc("meets"), "deficit", F.desc("f1"), F.desc("prec"), "tie", "k").drop("tie")


def balanced_select(spark, sf):
    """The same policy without a ceiling for recall."""
    s = threshold_sweep(spark, sf).withColumn("meets", (F.col("prec") > 0.4) & (F.col("rec") > 0.6) & (F.col("f1") > 0.5))
    gap = lambda c, x: F.greatest(F.lit(0.0), F.lit(x) - F.col(c))
    s = s.withColumn("deficit", F.round(F.when(F.col("meets"), 0.0).otherwise(2 * gap("f1", 0.5) + gap("prec", 0.4) + gap("rec", 0.6)), 6))
    tie = F.when(F.col("meets"), -F.col("rec")).otherwise(0.0)
    return _first(s.select("k", "meets", "deficit", "f1", "prec", "rec", tie.alias("tie")), F.desc("meets"), "deficit", F.desc("f1"), F.desc("prec"), "tie", "k").drop("tie")


def curve_lookup(spark, sf):
    """The curve's row at the chosen threshold."""
    return threshold_sweep(spark, sf).join(F.broadcast(precision_at_recall(spark, sf).select("k")), "k")


def ranking(spark, sf):
    return _rounded(metrics.ranking_metrics(scored(spark, sf)), "auc", "ap")


def reliability_bins(spark, sf):
    return _rounded(metrics.reliability(scored(spark, sf)), "mean_score", "positive")


def brier_ece(spark, sf):
    return _rounded(metrics.calibration_error(scored(spark, sf)), "brier", "ece")


def trust_profile(spark, sf):
    return _rounded(metrics.trust(scored(spark, sf), MODELS), "trust")


def meta_reductions(spark, sf):
    m = [F.col(c) for c in MODELS]
    return scored(spark, sf).select("doc_id", F.round(S.mean(*m), 6).alias("mean"), F.round(S.median(*m), 6).alias("median"), F.greatest(*m).alias("top"), F.round(S.closest_pair(*m), 6).alias("closest"))


def range_trust_pool(spark, sf):
    """Model scores weighted by how far their bin can be trusted; the profile has as many rows as models and bins."""
    rows = scored(spark, sf)
    profile = metrics.trust(rows, MODELS)
    maps = profile.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("bin", "trust"))).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("model", "t"))).alias("by"))
    t = {m: F.col("by")[F.lit(m)][S.bin_of(F.col(m), 20)] for m in MODELS}
    total = sum(t.values(), F.lit(0.0))
    value = sum((F.col(m) * t[m] for m in MODELS), F.lit(0.0))
    decay = S.rank_decay([F.col(m) for m in MODELS], [F.round(t[m], 9) for m in MODELS])
    return rows.join(F.broadcast(maps)).select("doc_id", F.round(F.when(total > 0, value / total).otherwise(S.mean(*[F.col(m) for m in MODELS])), 6).alias("pooled"), F.round(decay, 6).alias("decayed"))


def scale_pos_weight(spark, sf):
    return scored(spark, sf).agg(F.round(F.greatest(F.count_if(F.col("label") == 0), F.lit(1)) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1)), 6).alias("weight"))


def composite_pool(spark, sf):
    return _rounded(pooled(spark, sf), "base", "uplift", "pooled")


def file_risk(spark, sf):
    """Users' pooled scores pooled once more by the type of their first event."""
    kind = parts(spark, sf).groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("x")).select("user_id", F.col("x.event_type").alias("event_type"))
    return _rounded(pooling.composite(pooled(spark, sf).join(kind, "user_id").select("event_type", F.round("pooled", 6).alias("score")), "event_type"), "base", "uplift", "pooled")


def _records(spark, sf) -> DataFrame:
    return pooled(spark, sf).select("user_id", F.round("pooled", 6).alias("score"), F.round("base", 6).alias("top"))


def tiers(spark, sf):
    """What a user's pooled score says by itself, and with the user's best part."""
    r = _records(spark, sf)
    flagged, confirmed = F.col("score") >= 0.62, F.col("top") >= 0.6
    precise = S.precision_tier(flagged, confirmed)
    return r.select("user_id", *[c.alias(n) for n, c in S.deployment(F.col("score") - 0.3).items()], S.agreement(flagged, F.col("top") >= 0.58).alias("agreement"), precise.alias("precision_tier"), S.user_facing(precise).alias("user_facing"))


def tier_breakdown(spark, sf):
    """Every tier with its count and share, missing ones included."""
    t = tiers(spark, sf).groupBy(F.col("deployment_tier").alias("tier")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("vuln",), ("needs_review",), ("safe",)], "tier string")
    full = names.join(F.broadcast(t), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))
    return full.join(F.broadcast(full.agg(F.sum("n").alias("all")))).select("tier", "n", F.round(100.0 * F.col("n") / F.greatest("all", F.lit(1)), 4).alias("percent"))


def boosts(spark, sf):
    r = _records(spark, sf)
    x = F.col("score")
    return r.select("user_id", S.smooth_boost(F.round(x, 3)).alias("smooth"), F.round(S.plateau_boost(x, F.col("top")), 6).alias("plateau"), S.graduated_boost(F.round(x - 0.3, 3), F.round(F.col("top") - 0.35, 3), F.round("top", 2)).alias("graduated"), S.corroborated(F.col("top") - 0.4).alias("corroborated"), F.round(S.clip(x * 2 - 0.5), 6).alias("clipped"))


def peak_parts(spark, sf):
    """The parts whose score is within 1e-6 of their group's highest."""
    p = parts(spark, sf)
    best = p.groupBy("user_id").agg(F.max("score").alias("best"))
    return p.join(best, "user_id").filter("abs(score - best) <= 1e-6").select("user_id", "event_id")


def near_prototypes(rows: DataFrame, protos: DataFrame, floor: float, block: int = 4096) -> DataFrame:
    """(vec_id, proto, similarity) from a floor on; prototypes (proto, v) are broadcast in blocks of a fixed size, however many there are."""
    n = protos.count()
    blocks = protos.withColumn("__block", F.pmod(F.xxhash64("proto"), F.lit(max(1, 2 * n // block))))
    out = None
    for k in range(max(1, 2 * n // block)):
        c = rows.join(F.broadcast(blocks.filter(F.col("__block") == k).drop("__block"))).select("vec_id", "proto", F.round(S.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity")).filter(F.col("similarity") >= floor)
        out = c if out is None else out.unionByName(c)
    return out


def cosine_prototypes(spark, sf):
    """The prototypes (first vector of each label) that a vector is near to, and how sure that is."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    protos = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("p")).select(F.col("label").alias("proto"), F.col("p.embedding").alias("v"))
    near = near_prototypes(e.select("vec_id", "embedding"), protos, 0.3)
    return near.withColumn("confidence", F.round(near_confidence(F.col("similarity")), 6))


def agreement_summary(spark, sf):
    s = scored(spark, sf)
    hit, y = F.col("score") >= 0.5, F.col("label") == 1
    return s.agg(F.round(F.avg((hit == y).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.when(y, hit.cast("double"))), 6).alias("recall"), F.round(F.avg(F.when(~y, (~hit).cast("double"))), 6).alias("specificity"), F.round(F.avg(F.abs(F.col("score") - F.col("label"))), 6).alias("mean_delta"), F.round(F.stddev_pop("score"), 6).alias("spread"), F.min("score").alias("least"), F.max("score").alias("most"))


BASE = "WITH s AS (SELECT doc_id, quality AS label, " + ", ".join(f"((n_chars * {a}) % 1001)::DOUBLE / 1000 AS {m}" for a, m in ((1, "score"), (1, "m1"), (3, "m2"), (7, "m3"), (11, "m4"))) + " FROM documents JOIN labels USING (doc_id)) "
RATES = "round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS rec, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
CURVE = BASE + f", c AS (SELECT k::INT AS k, count(*) FILTER (label = 1 AND score >= k::DOUBLE / 100) AS tp, count(*) FILTER (label = 0 AND score >= k::DOUBLE / 100) AS fp, count(*) FILTER (label = 1 AND score < k::DOUBLE / 100) AS fn FROM s, range(101) r(k) GROUP BY k), w AS (SELECT *, {RATES} FROM c) "
EDGE = "list_count(list_filter(range(1, {1}), lambda i: i::DOUBLE * (1::DOUBLE / {1}) <= {0}))::INT"
POOL = """WITH p AS (SELECT event_id, user_id, event_type, value / (value + 400) AS score FROM events), b AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS base FROM p),
u AS (SELECT user_id, max(base) AS base, 0.25::DOUBLE * coalesce(avg(greatest(0, score - 0.32::DOUBLE)) FILTER (score < base - 1e-9), 0) AS uplift, count(*) AS n, count(*) FILTER (score >= base - 1e-9) AS n_top FROM b GROUP BY user_id),
r AS (SELECT user_id, round(least(1, base + uplift), 6) AS score, round(base, 6) AS top FROM u) """
TRUST = BASE + ", l AS (UNPIVOT s ON m1, m2, m3, m4 INTO NAME model VALUE x), g AS (SELECT avg(label) AS g FROM s), b AS (SELECT model, " + EDGE.format("x", 20) + " AS bin, count(*) AS n, sum(label) AS y FROM l GROUP BY ALL), t AS (SELECT m AS model, k::INT AS bin, coalesce(n, 0)::BIGINT AS n, (coalesce(y, 0) + g * 2) / (coalesce(n, 0) + 2) AS trust FROM (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS m) CROSS JOIN range(20) r(k) CROSS JOIN g LEFT JOIN b ON b.model = m AND b.bin = k) "
TIER = "CASE WHEN score - 0.3::DOUBLE >= 0.32::DOUBLE THEN 'vuln' WHEN score - 0.3::DOUBLE >= 0.26::DOUBLE THEN 'needs_review' ELSE 'safe' END"

QUERIES = {
    "confusion_at_threshold": (confusion_at_threshold, BASE + f", c AS (SELECT count(*) FILTER (label = 1 AND f) AS tp, count(*) FILTER (label = 0 AND f) AS fp, count(*) FILTER (label = 1 AND NOT f) AS fn, count(*) FILTER (label = 0 AND NOT f) AS tn FROM (SELECT label, score >= 0.32::DOUBLE AS f FROM s)) SELECT *, {RATES} FROM c"),
    "threshold_sweep": (threshold_sweep, CURVE + "SELECT k, tp, fp, fn, prec, rec, f1 FROM w"),
    "best_f1": (best_f1, CURVE + "SELECT k, f1 FROM w WHERE k BETWEEN 20 AND 80 AND k % 2 = 0 ORDER BY f1 DESC, k LIMIT 1"),
    "precision_at_recall": (precision_at_recall, CURVE + "SELECT k, prec, rec FROM w WHERE rec >= 0.6 ORDER BY prec DESC, rec DESC, k LIMIT 1"),
    "policy_select": (
        policy_select,
        CURVE + ", q AS (SELECT *, prec > 0.4 AND rec > 0.6 AND rec <= 0.7 AND f1 > 0.5 AS meets FROM w) SELECT k, meets, round(CASE WHEN meets THEN 0 ELSE 2 * greatest(0, 0.5::DOUBLE - f1) + greatest(0, 0.4::DOUBLE - prec) + greatest(0, 0.6::DOUBLE - rec) + greatest(0, rec - 0.7::DOUBLE) END, 6) AS deficit, f1, prec, rec FROM q ORDER BY meets DESC, deficit, f1 DESC, prec DESC, CASE WHEN meets THEN -rec ELSE round(abs(rec - 0.65::DOUBLE), 6) END, k LIMIT 1",
    ),
    "balanced_select": (
        balanced_select,
        CURVE + ", q AS (SELECT *, prec > 0.4 AND rec > 0.6 AND f1 > 0.5 AS meets FROM w) SELECT k, meets, round(CASE WHEN meets THEN 0 ELSE 2 * greatest(0, 0.5::DOUBLE - f1) + greatest(0, 0.4::DOUBLE - prec) + greatest(0, 0.6::DOUBLE - rec) END, 6) AS deficit, f1, prec, rec FROM q ORDER BY meets DESC, deficit, f1 DESC, prec DESC, CASE WHEN meets THEN -rec ELSE 0 END, k LIMIT 1",
    ),
    "curve_lookup": (curve_lookup, CURVE + "SELECT k, tp, fp, fn, prec, rec, f1 FROM w WHERE k = (SELECT k FROM w WHERE rec >= 0.6 ORDER BY prec DESC, rec DESC, k LIMIT 1)"),
    "ranking": (
        ranking,
        BASE + """, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY score), d AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))
        SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6)::DOUBLE AS ap FROM d""",
    ),
    "reliability_bins": (reliability_bins, BASE + f", b AS (SELECT {EDGE.format('score', 10)} AS bin, count(*) AS n, avg(score) AS a, avg(label) AS y FROM s GROUP BY 1) SELECT k::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(round(a, 6), 0) AS mean_score, coalesce(round(y, 6), 0) AS positive FROM range(10) r(k) LEFT JOIN b ON bin = k"),
    "brier_ece": (brier_ece, BASE + f", b AS (SELECT count(*) AS n, sum(score) AS a, sum(label) AS y, sum((score - label) ** 2) AS q FROM s GROUP BY {EDGE.format('score', 10)}) SELECT round(sum(q) / sum(n), 6) AS brier, round(sum(abs(a - y)) / sum(n), 6) AS ece FROM b"),
    "trust_profile": (trust_profile, TRUST + "SELECT model, bin, n, round(trust, 6) AS trust FROM t"),
    "meta_reductions": (
        meta_reductions,
        BASE + """SELECT doc_id, round((m1 + m2 + m3 + m4) / 4, 6) AS mean, round((list_sort([m1, m2, m3, m4])[2] + list_sort([m1, m2, m3, m4])[3]) / 2, 6) AS median, greatest(m1, m2, m3, m4) AS top,
        round(list_min([{'d': abs(m1 - m2), 'k': 0, 'm': (m1 + m2) / 2}, {'d': abs(m1 - m3), 'k': 1, 'm': (m1 + m3) / 2}, {'d': abs(m1 - m4), 'k': 2, 'm': (m1 + m4) / 2}, {'d': abs(m2 - m3), 'k': 3, 'm': (m2 + m3) / 2}, {'d': abs(m2 - m4), 'k': 4, 'm': (m2 + m4) / 2}, {'d': abs(m3 - m4), 'k': 5, 'm': (m3 + m4) / 2}]).m, 6) AS closest FROM s""",
    ),
    "range_trust_pool": (
        range_trust_pool,
        TRUST + f""", j AS (SELECT doc_id, l.model, x, trust, row_number() OVER (PARTITION BY doc_id ORDER BY round(trust, 9) DESC, l.model) AS r FROM l JOIN t ON t.model = l.model AND t.bin = {EDGE.format('x', 20)})
        SELECT doc_id, round(sum(x * trust) / sum(trust), 6) AS pooled, round(sum(x * (10::DOUBLE ** (1 - r))) / 1.111, 6) AS decayed FROM j GROUP BY doc_id""",
    ),
    "scale_pos_weight": (scale_pos_weight, BASE + "SELECT round(greatest(count(*) FILTER (label = 0), 1)::DOUBLE / greatest(count(*) FILTER (label = 1), 1), 6) AS weight FROM s"),
    "composite_pool": (composite_pool, POOL + "SELECT user_id, round(base, 6) AS base, round(uplift, 6) AS uplift, round(least(1, base + uplift), 6) AS pooled, n, n_top FROM u"),
    "file_risk": (
        file_risk,
        POOL + """, f AS (SELECT event_type, score, max(score) OVER (PARTITION BY event_type) AS base FROM r JOIN (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM p GROUP BY 1) USING (user_id)),
        h AS (SELECT event_type, max(base) AS base, 0.25::DOUBLE * coalesce(avg(greatest(0, score - 0.32::DOUBLE)) FILTER (score < base - 1e-9), 0) AS uplift, count(*) AS n, count(*) FILTER (score >= base - 1e-9) AS n_top FROM f GROUP BY event_type)
        SELECT event_type, round(base, 6) AS base, round(uplift, 6) AS uplift, round(least(1, base + uplift), 6) AS pooled, n, n_top FROM h""",
    ),
    "tiers": (
        tiers,
        POOL + f"""SELECT user_id, {TIER} AS deployment_tier, CASE {TIER} WHEN 'vuln' THEN 'agree_positive' WHEN 'needs_review' THEN 'review_suggested' ELSE 'agree_negative' END AS agreement_status,
        {TIER} = 'vuln' AS function_flagged, {TIER} <> 'safe' AS function_needs_review, {TIER} <> 'safe' AS user_facing_vuln, {TIER} = 'vuln' AS whole_function_vuln,
        CASE WHEN score >= 0.62 AND top >= 0.58 THEN 'agree_positive' WHEN score >= 0.62 THEN 'diffuse_risk' WHEN top >= 0.58 THEN 'review_suggested' ELSE 'agree_negative' END AS agreement,
        CASE WHEN score >= 0.62 AND top >= 0.6 THEN 'confirmed' WHEN top >= 0.6 THEN 'investigate' WHEN score >= 0.62 THEN 'soft_review' ELSE 'safe' END AS precision_tier, top >= 0.6 AS user_facing FROM r""",
    ),
    "tier_breakdown": (tier_breakdown, POOL + f", t AS (SELECT {TIER} AS tier FROM r) SELECT x AS tier, count(tier) AS n, round(100::DOUBLE * count(tier) / (SELECT greatest(count(*), 1) FROM t), 4) AS percent FROM (SELECT unnest(['vuln', 'needs_review', 'safe']) AS x) LEFT JOIN t ON tier = x GROUP BY x"),
    "boosts": (
        boosts,
        POOL + "SELECT user_id, format('{:.6f}', round(score, 3) + 0.4::DOUBLE * (1 - round(score, 3)))::DOUBLE AS smooth, format('{:.6f}', least(1, greatest(score, 0.58::DOUBLE, 0.92::DOUBLE * top)))::DOUBLE AS plateau, format('{:.6f}', least(pl, greatest(x, sup + 0.05::DOUBLE, x + (pl - x) * least(1, least(1, sup / 0.32::DOUBLE) * least(1, conf / 0.88::DOUBLE)))))::DOUBLE AS graduated, top - 0.4::DOUBLE >= 0.32::DOUBLE - 0.15::DOUBLE AS corroborated, round(greatest(0, least(1, score * 2 - 0.5::DOUBLE)), 6) AS clipped FROM (SELECT *, round(score - 0.3::DOUBLE, 3) AS x, round(top - 0.35::DOUBLE, 3) AS sup, round(top, 2) AS conf, format('{:.6f}', least(1, greatest(round(score - 0.3::DOUBLE, 3), 0.58::DOUBLE, 0.92::DOUBLE * round(top, 2))))::DOUBLE AS pl FROM r)",
    ),
    "peak_parts": (peak_parts, POOL + "SELECT user_id, event_id FROM b WHERE abs(score - base) <= 1e-6"),
    "cosine_prototypes": (
        cosine_prototypes,
        """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label AS proto, arg_min(e, vec_id) AS q FROM v GROUP BY label),
        c AS (SELECT vec_id, proto, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM v, p) SELECT *, round(CASE WHEN similarity >= 0.72 THEN least(0.9::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * similarity) END, 6) AS confidence FROM c WHERE similarity >= 0.3""",
    ),
    "agreement_summary": (
        agreement_summary,
        BASE + "SELECT round(avg(((score >= 0.5) = (label = 1))::INT), 6) AS accuracy, round(avg((score >= 0.5)::INT) FILTER (label = 1), 6) AS recall, round(avg((score < 0.5)::INT) FILTER (label = 0), 6) AS specificity, round(avg(abs(score - label)), 6) AS mean_delta, round(stddev_pop(score), 6) AS spread, min(score) AS least, max(score) AS most FROM s",
    ),
}
