"""Queries on code: signatures, attribution and boosts, comment hints, functions, cleaning by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.operators import code, signatures, tokens
from quarry.plans import snippets


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as code files, each with a detector's score."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", snippets.code(F.col("doc_id"), F.col("text")).alias("code"), ((F.col("n_chars") * 7) % 1001 / 1000.0).alias("score"), ((F.col("n_chars") * 3) % 1001 / 1000.0).alias("top_window"), (F.col("doc_id") % 2).cast("int").alias("label"))


def signature_hits(spark, sf):
    h = signatures.each_hit(signatures.with_hits(files(spark, sf), "code"), "doc_id")
    return h.select("doc_id", "h.rule_id", "h.cwe", F.round("h.confidence", 6).alias("confidence"), "h.layer")


def _attributed(spark, sf):
    """Each file has two segments: its first lines and the whole."""
    f = files(spark, sf)
    parts = f.select("doc_id", F.explode(F.array(F.substring_index("code", "\n", 3), F.col("code"))).alias("segment"))
    return signatures.attributed(parts, "doc_id", "segment", f.select("doc_id", "score", "top_window", "label", (F.col("score") >= S.FLAG).alias("flagged")))


def attribution(spark, sf):
    return _attributed(spark, sf).select("doc_id", "flagged", "category", "novelty", "signature_confidence", "primary_rule", "n_rules")


def novelty(spark, sf):
    """How many files have a known pattern, and how novel what they hold is on average."""
    return _attributed(spark, sf).groupBy((F.col("signature_confidence") >= signatures.KNOWN).alias("known")).agg(F.count("*").alias("n"), F.round(F.avg("novelty"), 6).alias("mean_novelty"))


def signature_boost(spark, sf):
    """Both boosts; records name 0.42, 0 or nothing as their threshold of confirmed windows."""
    c = F.col("signature_confidence")
    confirmed = F.when(F.col("doc_id") % 3 == 0, 0.42).when(F.col("doc_id") % 3 == 1, 0.0)
    smooth = S.boosted(F.col("score"), F.col("top_window"), c, F.col("flagged"), window_confirmed=confirmed)
    hard = S.boosted(F.col("score"), F.col("top_window"), c, F.col("flagged"), smooth=False, graduated=True)
    return _attributed(spark, sf).select("doc_id", *[x.alias(n) for n, x in smooth.items()], hard["boosted_score"].alias("graduated_score"))


def boost_replay(spark, sf):
    """Precision, recall and F1 of both boost policies over the same files, against no boost."""
    a = _attributed(spark, sf).withColumn("c", F.col("signature_confidence"))
    policy = lambda g: S.boosted(F.col("score"), F.col("top_window"), F.col("c"), F.col("flagged"), smooth=False, graduated=g)["boosted_score"]
    by = F.explode(F.map_from_arrays(F.array(F.lit("none"), F.lit("plateau"), F.lit("graduated")), F.array("score", policy(False), policy(True)))).alias("policy", "s")
    hit, y = F.col("s") >= S.FLAG, F.col("label") == 1
    g = a.select("label", by).groupBy("policy").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return g.select("policy", "tp", "fp", "fn", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("rec"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _prototypes(spark: SparkSession, sf: str) -> dict[str, list[float]]:
    """A prototype for as many rules as there are labels: the first vector of each; no more than the catalogue has rules."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").filter(F.col("label").between(0, len(signatures.CATALOGUE) - 1))
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    return {signatures.CATALOGUE[r["label"]].rule_id: [float(x) for x in r["v"]] for r in first}


def layered_hits(spark, sf):
    """Hits of all four layers: files with the vector of their number, which need not be there."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = signatures.with_hits(files(spark, sf).join(e, "doc_id", "left"), "code", embedding="embedding", prototypes=_prototypes(spark, sf))
    return signatures.each_hit(rows, "doc_id").select("doc_id", "place", "h.rule_id", F.round("h.confidence", 6).alias("confidence"), "h.layer", "h.matched_on")


def window_hits(spark, sf):
    """Matches of each file and hits of its windows: lines 1 to 3, lines 4 to 6, and the whole file, in this order."""
    line = lambda a: F.array_join(F.slice(F.split("code", "\n"), a, 3), "\n")
    f = files(spark, sf).select("doc_id", F.explode(F.array(*[F.struct(F.lit(no).alias("no"), F.lit(w).cast("int").alias("w"), c.alias("c")) for no, w, c in ((0, 0, line(1)), (1, 1, line(4)), (2, None, F.col("code")))])).alias("x")).select("doc_id", "x.*")
    named = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["rule_id"], h["layer"])), ",")
    r = signatures.by_window(f, "doc_id", "no", "w", "c")
    return r.select("doc_id", named(F.col("matches")).alias("matches"), F.array_join(F.transform("windows", lambda w: F.concat(w["window_index"].cast("string"), F.lit("="), named(w["hits"]))), ";").alias("windows"))


def suspicious_tokens(spark, sf):
    """The five most suspicious tokens of each file, by its hits, the catalogue and dangerous calls."""
    return tokens.with_top_tokens(signatures.with_hits(files(spark, sf), "code"), "code").select("doc_id", F.array_join("tokens", " | ").alias("tokens"))


def identifiers(spark, sf):
    """How many different identifiers and operators each file has, and which."""
    found = tokens.identifiers(F.col("code"))
    return files(spark, sf).select("doc_id", F.size(found).alias("n"), F.sha1(F.array_join(F.array_sort(found), " ").cast("binary")).alias("digest"))


def subword_ranking(spark, sf):
    """Words put together from pieces of whole texts with made-up values, and the five that weigh most."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    piece = F.transform("words", lambda w, i: F.when(i % 11 == 7, "[SEP]").when(i % 3 == 1, F.concat(F.lit("##"), w)).when(i % 3 == 2, F.concat(F.lit("Ġ"), w)).otherwise(F.concat(F.lit(" "), w)))
    value = F.transform("words", lambda w, i: ((F.length(w) * 37 + i * 11) % 101 - 50) / 8.0)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", words.alias("words")).select("doc_id", piece.alias("pieces"), value.alias("values"))
    return tokens.merged_pieces(d, "doc_id", "pieces", "values")


def comment_hints(spark, sf):
    cwes, cves = T.comment_hints(F.col("code"))
    return files(spark, sf).select("doc_id", F.array_join(cwes, ",").alias("cwes"), F.array_join(cves, ",").alias("cves")).filter("cwes <> '' OR cves <> ''")


def function_names(spark, sf):
    return files(spark, sf).select("doc_id", T.function_name(F.col("code"), F.when(F.col("doc_id") % 9 == 0, " named ").when(F.col("doc_id") % 9 == 1, " ")).alias("name"))


def function_extraction(spark, sf):
    out = code.extracted(files(spark, sf), "doc_id", "code")
    return out.select("doc_id", "function_id", "name", F.sha1("code").alias("digest"), "start_line", "end_line")


def clean_online(spark, sf):
    out = code.without_comments_by_line(files(spark, sf), "doc_id", "code")
    return out.select("doc_id", F.sha1("code").alias("digest"), F.size("line_map").alias("n_lines"), F.array_join(F.transform("line_map", lambda x: x.cast("string")), ",").alias("line_map"))


def file_line_map(spark, sf):
    """Lines 2 to 9 of the cleaned code as lines of the file."""
    kept = code.without_comments_by_line(files(spark, sf), "doc_id", "code").withColumns({"start": F.lit(2), "end": F.lit(9)})
    return code.file_lines(kept).select("doc_id", "file_start", "file_end")


def _hits_sql(source: str) -> str:
    """(doc_id, i, rule_id, cwe, c1, c2, c3, share) of the rows (doc_id, t) of a source: the three layers' confidences."""
    some = lambda tests: "(" + " OR ".join(tests) + ")" if tests else "TRUE"
    text = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(signatures.CATALOGUE):
        s = " AND ".join([some([f"contains(lower(t), {text(p)})" for p in r.patterns]), some([f"regexp_matches(t, {text('(?ims)' + x)})" for x in r.regexes]), some([f"contains(lower(t), {text(p)})" for p in r.require_any])])
        m = "(" + " + ".join(f"contains(lower(t), {text(k)})::INT" for k in r.keywords) + f")::DOUBLE / {len(r.keywords)}"
        parts.append(f"SELECT doc_id, {i} AS i, '{r.rule_id}' AS rule_id, '{r.cwe}' AS cwe, CASE WHEN list_contains(cwes, '{r.cwe}') THEN 0.88::DOUBLE END AS c1, CASE WHEN {s} THEN 0.92::DOUBLE END AS c2, CASE WHEN {m} >= 0.38 THEN least(0.85::DOUBLE, 0.45::DOUBLE + 0.5::DOUBLE * {m}) END AS c3, {m} AS share FROM {source}")
    return " UNION ALL ".join(parts)


ORDERED = "list_transform(list_filter(list_zip({0}, range(len({0}))), lambda x: list_position({0}, x[1]) = x[2] + 1), lambda x: x[1])"
F0 = f"f0 AS (SELECT doc_id, {snippets.CODE_SQL} AS t, (n_chars * 7) % 1001 / 1000::DOUBLE AS score, (n_chars * 3) % 1001 / 1000::DOUBLE AS top_window, (doc_id % 2)::INT AS label FROM documents)"


def _with_hints(source: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN len(list_filter(vs, lambda v: v[5:8]::INT > 2019)) > 0 THEN [] ELSE {ORDERED.format('ws')} END AS cwes, list_filter({ORDERED.format('vs')}, lambda v: v[5:8]::INT <= 2019) AS cves
    FROM (SELECT *, list_transform(regexp_extract_all(t, '(?i)CWE[-\\s]?(\\d{{1,4}})', 1), lambda x: 'CWE-' || x::INT) AS ws, list_transform(regexp_extract_all(t, '(?i)CVE[-\\s]?(\\d{{4}}-\\d{{4,7}})', 1), lambda x: 'CVE-' || x) AS vs FROM {source}))"""


FILES = f"WITH {F0}, {_with_hints('f0', 'f')}"
BEST = "greatest(coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0))"
ATTRIBUTED = f"""WITH {F0}, p0 AS (SELECT doc_id, unnest([array_to_string(list_slice(string_split(t, E'\\n'), 1, 3), E'\\n'), t]) AS t FROM f0), {_with_hints('p0', 'p')}, h AS (SELECT doc_id, i, rule_id, max({BEST}) AS c FROM ({_hits_sql('p')}) WHERE {BEST} > 0 GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_rules, max(c) AS c, arg_max(rule_id, c * 1000 - i) AS primary_rule FROM h GROUP BY doc_id),
a AS (SELECT f0.*, score >= 0.32 AS flagged, coalesce(n_rules, 0) AS n_rules, coalesce(c, 0) AS c0, format('{{:.4f}}', coalesce(c, 0))::DOUBLE AS c, primary_rule, CASE WHEN score >= 0.32 THEN CASE WHEN coalesce(c, 0) >= 0.45 THEN 'known_signature' ELSE 'novel_pattern' END WHEN coalesce(c, 0) >= 0.45 THEN 'signature_only' ELSE 'no_signal' END AS category FROM f0 LEFT JOIN b USING (doc_id))"""
BOOSTED = (
    ATTRIBUTED
    + """, s AS (SELECT *, greatest(score, top_window) AS support, format('{:.6f}', least(1, greatest(score, 0.58::DOUBLE, 0.32::DOUBLE + 0.26::DOUBLE, 0.92::DOUBLE * c)))::DOUBLE AS plateau, category IN ('known_signature', 'signature_only') AND c >= 0.45 AS applies FROM a),
g AS (SELECT *, CASE WHEN NOT applies THEN NULL WHEN support < 0.32::DOUBLE - 0.15::DOUBLE THEN 'blocked' WHEN category = 'known_signature' THEN 'smooth_agreement' ELSE 'smooth_signature_only' END AS mode,
format('{:.6f}', least(plateau, greatest(score, support + 0.05::DOUBLE, score + (plateau - score) * least(1, least(1, support / 0.32::DOUBLE) * least(1, c / 0.88::DOUBLE)))))::DOUBLE AS graduated FROM s),
r AS (SELECT *, CASE mode WHEN 'smooth_agreement' THEN format('{:.6f}', score + 0.4::DOUBLE * (1 - score))::DOUBLE WHEN 'smooth_signature_only' THEN format('{:.6f}', score + 0.3::DOUBLE * (1 - score))::DOUBLE END AS raised, mode LIKE 'smooth%' AS open FROM g),
w AS (SELECT *, coalesce(raised > score + 1e-9, false) AS better, CASE WHEN coalesce(raised > score + 1e-9, false) THEN raised ELSE score END AS boosted_score,
CASE WHEN coalesce(open, false) AND graduated > score + 1e-9 THEN graduated ELSE score END AS graduated_score, CASE WHEN coalesce(open, false) AND plateau > score + 1e-9 THEN plateau ELSE score END AS plateau_score FROM r) """
)
TIER = "CASE WHEN boosted_score >= 0.32 THEN 'vuln' WHEN boosted_score >= 0.26 THEN 'needs_review' ELSE 'safe' END"
STRIPPED = f"list_filter(list_transform(string_split(t, E'\\n'), lambda x: trim(x, {snippets.BLANKS_SQL})), lambda x: x <> '' AND NOT starts_with(x, '//'))"

def _token_sql() -> str:
    """Tokens of hits, of the catalogue's entries and of calls with their weights, summed up and ranked."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    entries = [x.strip() for r in signatures.CATALOGUE for x in (*r.keywords, *(p.strip().rstrip("(") for p in r.patterns))]
    names = ", ".join(f"({text(k)}, {text(v)})" for k, v in signatures.NAMES.items())
    calls = ", ".join(map(text, tokens.CALLS))
    parts = _hits_sql("f").replace("CASE WHEN list_contains", "t, CASE WHEN list_contains")
    return FILES + f""", h AS (SELECT doc_id, t, rule_id, cwe, CASE WHEN c1 = {BEST} THEN 'comment_cwe' WHEN c2 = {BEST} THEN rule_id ELSE 'keywords:' || printf('%.2f', share) END AS matched FROM ({parts}) WHERE {BEST} > 0),
    n(rule_id, name) AS (VALUES {names}), k(token) AS (VALUES {", ".join(f"({text(e)})" for e in entries)}),
    said AS (SELECT doc_id, t, unnest([matched, name, rule_id]) AS token FROM h JOIN n USING (rule_id)),
    w AS (SELECT doc_id, token, 3.0 AS w FROM said WHERE contains(lower(t), lower(token)) UNION ALL SELECT doc_id, cwe, 3.0 FROM h UNION ALL SELECT doc_id, token, 2.0 FROM f, k WHERE contains(lower(t), lower(token))
      UNION ALL SELECT doc_id, x, 1.0 FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS x FROM f) WHERE x IN ({calls})),
    s AS (SELECT doc_id, token, sum(w) AS w FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS place FROM s),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, lower(token) ORDER BY place) = 1), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank FROM u)
    SELECT doc_id, coalesce(string_agg(token, ' | ' ORDER BY rank) FILTER (rank <= 5), '') AS tokens FROM f LEFT JOIN v USING (doc_id) GROUP BY doc_id"""


SUBWORDS = """WITH e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS w FROM documents)),
g AS (SELECT *, i % 11 = 7 AS special, ((length(w) * 37 + i * 11) % 101 - 50) / 8.0::DOUBLE AS v, sum((i % 11 = 7 OR i % 3 <> 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, k, min(i) AS i, string_agg(w, '' ORDER BY i) FILTER (NOT special) AS word, sum(v) FILTER (NOT special) AS v FROM g GROUP BY doc_id, k),
s AS (SELECT doc_id, lower(word) AS low, arg_min(word, i) AS token, sum(v) AS v FROM m WHERE word <> '' GROUP BY doc_id, low)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v) DESC, low)::INT AS rank, token, format('{:.6f}', v)::DOUBLE AS value FROM s QUALIFY rank <= 5"""

LAYER = "CASE WHEN c1 = {0} THEN 'contextual' WHEN c2 = {0} THEN 'structural' WHEN c3 = {0} THEN 'semantic' ELSE 'embedding' END"
FIRST = "CASE WHEN c1 IS NOT NULL THEN 0 WHEN c2 IS NOT NULL THEN 1 WHEN c3 IS NOT NULL THEN 2 ELSE 3 END"
B4 = "greatest(coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0), coalesce(c4, 0))"
LAYERED = FILES + f""", v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT label AS i, arg_min(embedding::DOUBLE[], vec_id) AS q FROM embeddings WHERE label BETWEEN 0 AND {len(signatures.CATALOGUE) - 1} GROUP BY label),
s AS (SELECT doc_id, i, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS sim FROM v, q),
h AS (SELECT x.*, sim, CASE WHEN sim >= 0.72 THEN least(0.9::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * sim) END AS c4 FROM ({_hits_sql('f')}) x LEFT JOIN s USING (doc_id, i)), b AS (SELECT *, {B4} AS best FROM h WHERE {B4} > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY best DESC, {FIRST}, i) - 1)::INT AS place, rule_id, round(best, 6) AS confidence, {LAYER.format('best')} AS layer,
CASE WHEN c1 = best THEN 'comment_cwe' WHEN c2 = best THEN rule_id WHEN c3 = best THEN 'keywords:' || format('{{:.2f}}', share) ELSE 'cosine:' || format('{{:.3f}}', sim) END AS matched_on FROM b"""
WINDOWED = f"""WITH {F0}, p0 AS (SELECT doc_id * 3 + no AS doc_id, no, t FROM (SELECT doc_id, unnest([0, 1, 2]) AS no, unnest([array_to_string(list_slice(string_split(t, E'\\n'), 1, 3), E'\\n'), array_to_string(list_slice(string_split(t, E'\\n'), 4, 6), E'\\n'), t]) AS t FROM f0)), {_with_hints('p0', 'p')},
h AS (SELECT doc_id // 3 AS doc_id, doc_id % 3 AS no, i, rule_id, best, {LAYER.format('best')} AS layer, row_number() OVER (PARTITION BY doc_id ORDER BY best DESC, {FIRST.replace('c3 IS NOT NULL THEN 2 ELSE 3', 'TRUE THEN 2')}, i) AS place FROM (SELECT *, {BEST} AS best FROM ({_hits_sql('p')})) WHERE best > 0),
m AS (SELECT doc_id, rule_id, max(best) AS c, arg_min(layer, -best * 1000000 + no * 1000 + place) AS layer, min(no * 1000 + place) AS first FROM h GROUP BY ALL),
a AS (SELECT doc_id, string_agg(rule_id || ':' || layer, ',' ORDER BY c DESC, first) AS matches FROM m GROUP BY doc_id),
w AS (SELECT doc_id, no, string_agg(rule_id || ':' || layer, ',' ORDER BY place) AS x FROM h WHERE no < 2 GROUP BY doc_id, no), ww AS (SELECT doc_id, string_agg(no || '=' || x, ';' ORDER BY no) AS windows FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(matches, '') AS matches, coalesce(windows, '') AS windows FROM f0 LEFT JOIN a USING (doc_id) LEFT JOIN ww USING (doc_id)"""

QUERIES = {
    "layered_hits": (layered_hits, LAYERED),
    "window_hits": (window_hits, WINDOWED),
    "suspicious_tokens": (suspicious_tokens, _token_sql()),
    "identifiers": (identifiers, f"""WITH {F0}, i AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(t, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}|\\.\\./|->|==|!=|<=|>='), lambda x: lower(x))) AS x FROM f0) SELECT doc_id, len(x)::INT AS n, sha1(array_to_string(list_sort(x), ' ')) AS digest FROM i"""),
    "subword_ranking": (subword_ranking, SUBWORDS),
    "signature_hits": (signature_hits, FILES + f" SELECT doc_id, rule_id, cwe, round({BEST}, 6) AS confidence, CASE WHEN c1 = {BEST} THEN 'contextual' WHEN c2 = {BEST} THEN 'structural' ELSE 'semantic' END AS layer FROM ({_hits_sql('f')}) WHERE {BEST} > 0"),
    "attribution": (attribution, ATTRIBUTED + " SELECT doc_id, flagged, category, format('{:.4f}', 1 - c0)::DOUBLE AS novelty, c AS signature_confidence, primary_rule, n_rules FROM a"),
    "novelty": (novelty, ATTRIBUTED + " SELECT c0 >= 0.45 AS known, count(*) AS n, round(avg(format('{:.4f}', 1 - c0)::DOUBLE), 6) AS mean_novelty FROM a GROUP BY 1"),
    "signature_boost": (
        signature_boost,
        BOOSTED + f"SELECT doc_id, CASE WHEN better OR mode = 'blocked' THEN mode END AS boost_mode, boosted_score, CASE WHEN better AND boosted_score >= 0.85 AND (c >= 0.88 OR (doc_id % 3 = 0 AND top_window >= 0.42)) THEN 'confirmed' ELSE {TIER} END AS boosted_tier, boosted_score >= 0.32 AS whole_function_vuln, graduated_score FROM w",
    ),
    "boost_replay": (
        boost_replay,
        BOOSTED
        + """, l AS (UNPIVOT (SELECT label, score AS "none", plateau_score AS plateau, graduated_score AS graduated FROM w) ON "none", plateau, graduated INTO NAME policy VALUE s),
        c AS (SELECT policy, count(*) FILTER (s >= 0.32 AND label = 1) AS tp, count(*) FILTER (s >= 0.32 AND label = 0) AS fp, count(*) FILTER (s < 0.32 AND label = 1) AS fn FROM l GROUP BY policy)
        SELECT *, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS rec, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
    ),
    "comment_hints": (comment_hints, FILES + " SELECT doc_id, array_to_string(cwes, ',') AS cwes, array_to_string(cves, ',') AS cves FROM f WHERE len(cwes) + len(cves) > 0"),
    "function_names": (
        function_names,
        f"""WITH {F0}, n AS (SELECT doc_id, list_filter(list_transform({STRIPPED}, lambda x: regexp_extract(x, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)), lambda x: x <> '' AND x NOT IN ('if', 'for', 'while', 'return', 'switch', 'sizeof'))[1] AS g FROM f0)
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'named' ELSE g END AS name FROM n""",
    ),
    "function_extraction": (function_extraction, None),
    "clean_online": (clean_online, None),
    "file_line_map": (file_line_map, None),
}
