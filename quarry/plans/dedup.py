"""Queries on duplicates within and across splits, the gate before training, and ingest as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import duplicates, gates
from quarry.plans.snippets import BLANKS_SQL
from quarry.sources.places import shared
from quarry.streaming import ingest, near_index

SPLIT_SQL = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN ' Valid' WHEN 2 THEN NULL WHEN 3 THEN 'other' ELSE 'train' END"
COMMIT_SQL = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' none ' ELSE ' c' || (doc_id % 301) END"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows with splits and commits."""
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text AS code", f"{SPLIT_SQL} AS split", f"{COMMIT_SQL} AS commit_hash", "n_chars")
    return d.withColumn("place", duplicates.priority(F.col("split")).cast("long") * (1 << 40) + F.col("doc_id"))


def split_order(spark, sf):
    """The first of equal texts by split, then by id; blank ones all stay."""
    kept = duplicates.first_of_equal(rows(spark, sf), "code", [F.col("place")])
    return kept.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("doc_id"))), F.lit(0)).alias("ids"))


def scoped_dedup(spark, sf):
    """The same with an index for each split."""
    kept = duplicates.first_of_equal(rows(spark, sf), "code", [F.col("doc_id")], "split")
    return kept.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count_if("keep").alias("kept"))


def shingle_counts(spark, sf):
    return duplicates.with_shingles(rows(spark, sf), "code").select("doc_id", F.size("shingles").alias("n"))


def near_first_wins(spark, sf):
    """What the first-wins rule drops, as exact or near; what equals a dropped row is near to the same kept one."""
    marked = duplicates.first_of_equal(rows(spark, sf), "code", [F.col("place")])
    near = duplicates.near_dropped(marked.filter("keep"), "code", "place", True).withColumn("near", F.lit(True))
    return marked.join(near, marked["first"] == near["at"], "left").select("doc_id", F.when(F.col("near"), "near").when(F.col("keep"), "kept").otherwise("exact").alias("reason"))


def near_leaks(spark, sf):
    """How many rows have an earlier near or equal row, splits in order."""
    r = rows(spark, sf).filter("split IN ('train', 'test') OR split = ' Valid'")
    marked = duplicates.first_of_equal(r, "code", [F.col("place")])
    near = duplicates.near_matched(marked.filter("keep"), "code", "place", True).withColumn("near", F.lit(True))
    return marked.join(near, marked["place"] == near["at"], "left").agg(F.count_if(F.coalesce("near", F.lit(False)) | ~F.col("keep")).alias("n"))


def _whole(r: DataFrame) -> DataFrame:
    """rows with the columns that a data set must have."""
    return r.select("*", F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("label"), F.lit("docs").alias("source_dataset"), F.lit(None).cast("string").alias("commit_date"))


def _found(g: DataFrame) -> DataFrame:
    return g.withColumn("issues", F.array_join("issues", "; "))


def gate(spark, sf):
    """A data set that fails: texts and commits in several splits, and more near rows than the ten that may be."""
    return _found(gates.gate(_whole(rows(spark, sf)), max_near=10))


def gate_passed(spark, sf):
    """What the first-wins rule keeps of whole commits passes, if blank texts go."""
    r = rows(spark, sf)
    kept = near_first_wins(spark, sf).filter("reason = 'kept'").select("doc_id")
    own = r.join(kept, "doc_id", "left_semi").filter(T.strip(F.col("code")) != "").withColumn("commit_hash", F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    path = shared(spark, "kept")  # the gate reads its rows several times
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    return _found(gates.gate(_whole(own)))


def gate_incomplete(spark, sf):
    """Columns are missing and a split is empty, so nothing else is looked at."""
    return _found(gates.gate(rows(spark, sf).filter("split <> 'test'")))


def split_profile(spark, sf):
    """Size, labels, empty codes and token counts of each split."""
    r = rows(spark, sf).withColumn("split", T.split_name(F.col("split"))).withColumn("t", T.n_tokens(F.coalesce("code", F.lit(""))))
    p = lambda q: F.round(F.percentile("t", F.lit(q)), 3)
    return r.filter("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("positive"), F.count_if(F.coalesce(T.strip(F.col("code")), F.lit("")) == "").alias("n_empty"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.count_if(F.col("t") > 512).alias("n_long"))


def stream_dedup(spark, sf):
    """Texts of a stream of chunks, each once."""
    place = shared(spark, "stream")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = max(5, docs.rdd.getNumPartitions())  # files of about a split each, two fifths of them at a time
    docs.repartition(n, "doc_id").write.parquet(f"{place}/in")
    ingest.run_to_end(ingest.new_texts(ingest.chunks(spark, f"{place}/in", docs.schema, -(-2 * n // 5)), "text").select("digest"), f"{place}/out", f"{place}/checkpoint")
    return spark.read.schema("digest string").parquet(f"{place}/out")


def stream_near_dedup(spark, sf):
    """A corpus that comes in five chunks, splits in order: each row kept, exact or near by an index that goes on from chunk to chunk."""
    place = shared(spark, "near")
    r = rows(spark, sf).select("doc_id", "code", "place")
    bounds = r.agg(F.percentile_approx("place", F.array(*[F.lit(q / 5) for q in range(1, 5)]))).first()[0]
    chunk = sum(((F.col("place") > b).cast("int") for b in bounds), F.lit(0))
    for k in range(5):  # files of later chunks are newer, so the stream takes them later
        r.filter(chunk == k).coalesce(1).write.mode("append").parquet(f"{place}/in")
    near_index.run_near_to_end(ingest.chunks(spark, f"{place}/in", r.schema, 1), f"{place}/index", f"{place}/out", f"{place}/checkpoint", "code", "place", 16)
    return spark.read.parquet(f"{place}/out").select("doc_id", "reason")


def stream_windows(spark, sf):
    """Events by hour and kind, each hour once it can't change any more."""
    place = shared(spark, "hours")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(f"{place}/in")
    hours = ingest.counts(ingest.chunks(spark, f"{place}/in", events.schema, 100), "ts", "event_type", "1 hour", "10 minutes")
    ingest.run_to_end(hours.select(F.col("window.start").alias("hour"), "event_type", "n"), f"{place}/out", f"{place}/checkpoint")
    return spark.read.schema("hour timestamp, event_type string, n long").parquet(f"{place}/out")


PLACE = "CASE WHEN split IS NULL THEN 99 ELSE coalesce(map {'train': 0, 'valid': 1, 'test': 2}[lower(trim(split))], 50) END"
R = f"WITH r AS (SELECT *, lower(trim(split)) AS name FROM (SELECT doc_id, text AS code, {SPLIT_SQL} AS split, {COMMIT_SQL} AS commit_hash FROM documents)), "
BLANK = f"coalesce(trim(code, {BLANKS_SQL}), '') = ''"
WORD = r"[^\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: First of each text, its shingle set, pairs of firsts that are near, and what the first-wins rule drops, row by row.
NEAR = f"""p AS (SELECT doc_id, coalesce(code, '') AS code, {PLACE}::BIGINT * (1::BIGINT << 40) + doc_id AS place, {BLANK} AS blank FROM r {{where}}),
firsts AS (SELECT min(place) AS o, code FROM p WHERE NOT blank GROUP BY code),
w AS (SELECT o, regexp_extract_all(code, '{WORD}') AS w FROM firsts),
g AS (SELECT o, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT o, count(*) AS n FROM g GROUP BY o),
pairs AS (SELECT a, b FROM (SELECT x.o AS a, y.o AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.o < y.o GROUP BY ALL) JOIN n m ON m.o = a JOIN n u ON u.o = b WHERE c::DOUBLE / (m.n + u.n - c) >= 0.85),
q AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM pairs GROUP BY b),
steps AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT q.k, CASE WHEN len(list_filter(q.earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, q.b) ELSE gone END FROM steps JOIN q ON q.k = steps.k + 1),
gone AS (SELECT unnest(gone) AS o FROM steps QUALIFY row_number() OVER (ORDER BY k DESC) = 1)"""
FIRST_WINS = R.replace("WITH r", "WITH RECURSIVE r") + NEAR.replace("{where}", "") + " SELECT doc_id, CASE WHEN blank THEN 'kept' WHEN gone.o IS NOT NULL THEN 'near' WHEN place = firsts.o THEN 'kept' ELSE 'exact' END AS reason FROM p LEFT JOIN firsts ON NOT blank AND p.code = firsts.code LEFT JOIN gone ON gone.o = firsts.o"
NEAR_LEAKS = R.replace("WITH r", "WITH RECURSIVE r") + NEAR.replace("{where}", "WHERE split IN ('train', 'test') OR split = ' Valid'") + " SELECT count(*) AS n FROM p LEFT JOIN firsts ON NOT blank AND p.code = firsts.code WHERE NOT blank AND (place > firsts.o OR firsts.o IN (SELECT b FROM pairs))"
GATE = R + f"""q AS (SELECT * FROM __ROWS__ WHERE name IN ('train', 'valid', 'test')), z AS (SELECT name, count(*) AS size FROM q GROUP BY name), x AS (SELECT coalesce(code, '') AS code, count(*) AS k, sum(size) AS s FROM (SELECT DISTINCT coalesce(code, '') AS code, name FROM q) JOIN z USING (name) GROUP BY 1 HAVING k > 1),
        cm AS (SELECT count(*) AS commits FROM (SELECT trim(commit_hash) AS h FROM q WHERE trim(commit_hash) <> '' AND lower(trim(commit_hash)) NOT IN ('none', 'null', 'nan') GROUP BY 1 HAVING count(DISTINCT name) > 1)),
        {NEAR.replace('FROM r {where}', 'FROM q').replace('steps AS', 'steps0 AS').split(',\nq AS')[0]},
        nr AS (SELECT count(*) AS near_rows FROM p LEFT JOIN firsts ON NOT blank AND p.code = firsts.code WHERE NOT blank AND (place > firsts.o OR firsts.o IN (SELECT b FROM pairs))),
        y AS (SELECT 0 AS missing_columns, (3 - (SELECT count(*) FROM z))::INT AS empty_splits, (SELECT count(*) FROM x) AS exact_hashes, coalesce((SELECT sum(s - 1) FROM x), 0)::BIGINT AS exact_rows, near_rows, commits FROM cm, nr)
        SELECT *, concat_ws('; ', CASE WHEN exact_hashes > 0 THEN exact_hashes || ' texts in several splits, 0 may be' END, CASE WHEN near_rows > __MOST__ THEN near_rows || ' rows near an earlier one, __MOST__ may be' END, CASE WHEN commits > 0 THEN commits || ' commits in several splits' END) AS issues, exact_hashes = 0 AND near_rows <= __MOST__ AND commits = 0 AND empty_splits = 0 AS passed FROM y"""

QUERIES = {
    "split_order": (split_order, R + f"k AS (SELECT *, {BLANK} OR row_number() OVER (PARTITION BY code ORDER BY {PLACE}, doc_id) = 1 AS keep FROM r) SELECT coalesce(split, 'none') AS split, count(*) AS n, count(*) FILTER (keep) AS kept, coalesce(sum(doc_id) FILTER (keep), 0)::BIGINT AS ids FROM k GROUP BY 1"),
    "scoped_dedup": (scoped_dedup, R + f"k AS (SELECT *, {BLANK} OR row_number() OVER (PARTITION BY split, code ORDER BY doc_id) = 1 AS keep FROM r) SELECT coalesce(split, 'none') AS split, count(*) FILTER (keep) AS kept FROM k GROUP BY 1"),
    "shingle_counts": (shingle_counts, f"SELECT doc_id, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) ELSE least(1, len(w)) END::INT AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"),
    "near_first_wins": (near_first_wins, FIRST_WINS),
    "near_leaks": (near_leaks, NEAR_LEAKS),
    "stream_near_dedup": (stream_near_dedup, FIRST_WINS),
    "gate": (gate, GATE.replace("__ROWS__", "r").replace("__MOST__", "10")),
    "gate_passed": (gate_passed, "WITH kept AS (" + FIRST_WINS + "), " + GATE.replace("WITH r", "r", 1).replace("__ROWS__", f"(SELECT * REPLACE ('c' || doc_id AS commit_hash) FROM r JOIN kept USING (doc_id) WHERE reason = 'kept' AND NOT {BLANK})").replace("__MOST__", "0")),
    "gate_incomplete": (gate_incomplete, "SELECT 4 AS missing_columns, 1 AS empty_splits, 0::BIGINT AS exact_hashes, 0::BIGINT AS exact_rows, 0::BIGINT AS near_rows, 0::BIGINT AS commits, 'missing columns: id, label, source_dataset, commit_date; test is empty' AS issues, count(*) < 0 AS passed FROM documents"),
    "split_profile": (
        split_profile,
        R + f"t AS (SELECT *, len(regexp_extract_all(coalesce(code, ''), '{WORD}')) AS t FROM r WHERE name IN ('train', 'valid', 'test')) SELECT name AS split, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS positive, count(*) FILTER ({BLANK}) AS n_empty, {', '.join(f'round(quantile_cont(t::DOUBLE, {q / 100}), 3) AS p{q}' for q in (50, 90, 99))}, count(*) FILTER (t > 512) AS n_long FROM t GROUP BY 1",
    ),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT sha1(text) AS digest FROM documents"),
    "stream_windows": (stream_windows, "WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type, ts FROM events) SELECT hour::TIMESTAMP AS hour, event_type, count(*) AS n FROM e WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL"),
}
