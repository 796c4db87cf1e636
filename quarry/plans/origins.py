"""Queries on whole sources: files as a source has them, written from the test tables, read by the source's own way and brought to core rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import ingest
from quarry.plans.snippets import BLANKS_SQL
from quarry.sources import corpora, datasource, writers
from quarry.sources.places import shared


def _json(spark: SparkSession, rows: DataFrame, target: str, name: str) -> None:
    """rows as JSON lines in files of these names."""
    place = shared(spark, "parts")
    rows.write.option("ignoreNullFields", "false").json(place)
    writers.renamed(spark, place, target, name)


def _json_folder(rows: DataFrame, path: str) -> None:
    """rows as JSON lines in a folder of this name, a file a task."""
    rows.write.option("ignoreNullFields", "false").json(path)


def source_primevul(spark, sf):
    """Two folders of JSON lines; rows without a split have that of their file's name. Partitions of 64 kB show that lines are cut right."""
    root = shared(spark, "root")
    raw = ingest._expressions(spark, sf, ingest.RAW_PRIMEVUL | {"k": "doc_id % 4"})
    for k, (folder, name) in enumerate([("jsonl", "primevul_valid_{}.jsonl"), ("paired", "Test_paired_{}.jsonl")]):
        _json(spark, raw.filter(F.col("k") % 2 == k).drop("k"), f"{root}/{folder}", name)
    return ingest._shown(corpora.normalise.primevul(corpora.json_lines(spark, root, corpora.PRIMEVUL, "jsonl,paired", part_bytes=1 << 16)))


def source_diversevul(spark, sf):
    root = shared(spark, "root")
    _json_folder(ingest._expressions(spark, sf, ingest.RAW_DIVERSEVUL), f"{root}/diversevul/diversevul.jsonl")
    _json_folder(ingest._expressions(spark, sf, ingest.RAW_META), f"{root}/diversevul/metadata.jsonl")
    return ingest._shown(corpora.core_rows(spark, root))


def source_bigvul(spark, sf):
    root = shared(spark, "root")
    ingest._expressions(spark, sf, ingest.RAW_BIGVUL).write.csv(f"{root}/bigvul/cleaned.csv", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return ingest._shown(corpora.core_rows(spark, root, "bigvul"))


def source_cvefixes(spark, sf):
    """JSON lines are there, so a dump beside them isn't read."""
    root = shared(spark, "root")
    _json_folder(ingest._expressions(spark, sf, ingest.RAW_RELATIONAL), f"{root}/cvefixes/cvefixes.jsonl")
    spark.createDataFrame([("COPY public.commits (hash) FROM stdin;",), ("\\.",)], "value string").coalesce(1).write.text(f"{root}/cvefixes/dump.sql")
    return ingest._shown(corpora.core_rows(spark, root))


HASH = "substring(sha1('h' || (doc_id % 97)), 1, 12)"
#: The tables of a dump, as expressions over documents: their columns, and which documents have a row.
DUMP = {
    "method_change": ({"method_change_id": "doc_id", "code": "text", "before_change": "CASE doc_id % 3 WHEN 0 THEN 'True' ELSE 'False' END", "file_change_id": "'f' || doc_id"}, "TRUE"),
    "file_change": ({"file_change_id": "'f' || doc_id", "hash": HASH, "filename": "CASE WHEN doc_id % 2 = 0 THEN 'a.c' END", "old_path": "'old.c'", "new_path": "CASE WHEN doc_id % 3 = 0 THEN 'new.c' END", "programming_language": "CASE doc_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'C++' WHEN 2 THEN 'Java' WHEN 3 THEN 'None' END"}, "doc_id % 13 > 0"),
    "commits": ({"hash": HASH, "committer_date": "CASE WHEN doc_id % 97 % 4 > 0 THEN '2014-02-03 04:05:06' END", "author_date": "'2012-01-0' || (doc_id % 97 % 9 + 1)"}, "doc_id % 97 % 7 > 0"),
    "fixes": ({"hash": HASH, "cve_id": "'CVE-2015-' || (1000 + doc_id % 97)"}, "doc_id % 97 % 3 = 0"),
    "cve": ({"cve_id": "'CVE-2015-' || (1000 + doc_id % 97)", "published_date": "'2015-06-07 00:00:00'", "description": "' about ' || (doc_id % 97)"}, "doc_id % 97 % 6 = 0"),
    "cwe_classification": ({"cve_id": "'CVE-2015-' || (1000 + doc_id % 97)", "cwe_id": "'CWE-' || (doc_id % 97 % 5 + 20)"}, "doc_id % 97 % 9 = 0"),
}
PATCH = "doc_id % 10 = 0"
PATCHED = "CASE WHEN doc_id % 20 = 0 THEN substring(sha1('h' || (doc_id % 97)), 1, 12) ELSE substring(sha1('p' || doc_id), 1, 20) END"


def _dump(spark: SparkSession, sf: str, path: str) -> None:
    """The tables of DUMP, as numbered files of a COPY dump."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    special = {"\\\\": "\\\\\\\\", "\t": "\\\\t", "\n": "\\\\n", "\r": "\\\\r"}

    def escaped(c):
        out = F.col(c).cast("string")
        for a, b in special.items():
            out = F.regexp_replace(out, a, b)
        return F.coalesce(out, F.lit("\\N"))

    said = lambda *lines: spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    pieces = []
    for table, (columns, where) in DUMP.items():
        rows = d.filter(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
        rows = rows if table in ("method_change", "file_change") else rows.distinct()
        pieces += [said(f"COPY public.{table} ({', '.join(columns)}) FROM stdin;"), rows.select(F.concat_ws("\t", *[escaped(c) for c in columns]).alias("line")), said("\\.", "")]
    writers.in_order(spark, pieces, path)


def _patched(d: DataFrame) -> DataFrame:
    """(name, text): patches that remove all lines of every tenth text."""
    lines = F.split(F.regexp_replace("text", "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", " "), "\n")
    text = F.concat(F.lit("diff --git a/src/a.c b/src/a.c\n--- a/src/a.c\n+++ b/src/a.c\n@@ -1 +1 @@\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("-"), x)), "\n"), F.lit("\n+new\ndiff --git a/x.py b/x.py\n-a\n-b\n-c and more\n"))
    return d.filter(PATCH).select(F.concat(F.lit("github.com_o_r_"), F.expr(PATCHED), F.lit(".patch")).alias("name"), text.alias("text"), F.expr(PATCHED).alias("commit"))


def source_secvuleval(spark, sf):
    """A dump of six tables, joined, and patches with what the dump knows of their commits."""
    root = shared(spark, "root")
    _dump(spark, sf, f"{root}/secvuleval/dump.sql")
    one = _patched(spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")).groupBy("name").agg(F.min("text").alias("text"))
    writers.named_files(one, f"{root}/secvuleval/patches")
    return ingest._shown(corpora.core_rows(spark, root, "secvuleval"))


def read_patches(spark, sf):
    """The removed runs of patches, as the data source gives them."""
    place = shared(spark, "patches")
    one = _patched(spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")).groupBy("name").agg(F.min("text").alias("text"))
    writers.named_files(one, place)
    datasource.register(spark)
    return spark.read.format("quarry_patches").option("part_bytes", 1 << 16).load(place).select("method_id", "commit_hash", "file_path", F.sha1(F.col("method_before").cast("binary")).alias("digest"))


def _cte(table: str) -> str:
    columns, where = DUMP[table]
    return f"{table} AS (SELECT {'' if table in ('method_change', 'file_change') else 'DISTINCT '}{', '.join(f'({e})::VARCHAR AS {c}' for c, e in columns.items())} FROM documents WHERE {where})"


REMOVED = f"""(SELECT 'patch_' || substring(commit_hash, 1, 12) || '_src_a_c_0' AS method_id, commit_hash, 'src/a.c' AS file_path, code FROM
(SELECT commit_hash, trim(array_to_string(l, E'\\n'), {BLANKS_SQL}) AS code, len(l) AS n FROM (SELECT commit_hash, list_filter(string_split(regexp_replace(min(text), '[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]', ' ', 'g'), E'\\n'), lambda x: NOT starts_with(x, '--')) AS l
 FROM (SELECT {PATCHED} AS commit_hash, text FROM documents WHERE {PATCH} AND text IS NOT NULL) GROUP BY commit_hash)) WHERE n >= 3 AND length(code) >= 10)"""
RAW_DUMP = f"""(WITH {", ".join(_cte(t) for t in DUMP)},
fix AS (SELECT hash, min(cve_id) AS cve_id FROM fixes GROUP BY hash), cwes AS (SELECT cve_id, string_agg(cwe_id, ';' ORDER BY cwe_id) AS cwe FROM cwe_classification GROUP BY cve_id)
SELECT method_change_id AS method_id, m.code AS method_before, before_change AS vul, f.hash AS commit_hash, committer_date, author_date, published_date, x.cve_id AS cve, cwe, description AS cve_desc, coalesce(filename, new_path, old_path) AS file_path
FROM method_change m JOIN file_change f USING (file_change_id) LEFT JOIN commits c ON c.hash = f.hash LEFT JOIN fix x ON x.hash = f.hash LEFT JOIN cve v ON v.cve_id = x.cve_id LEFT JOIN cwes w ON w.cve_id = x.cve_id
WHERE lower(coalesce(programming_language, '')) IN ('c', 'c++', 'cpp', '', 'none') AND length(trim(m.code, {BLANKS_SQL})) >= 10
UNION ALL SELECT method_id, p.code, '1', p.commit_hash, committer_date, author_date, published_date, x.cve_id, cwe, description, file_path
FROM {REMOVED} p LEFT JOIN commits c ON c.hash = p.commit_hash LEFT JOIN fix x ON x.hash = c.hash LEFT JOIN cve v ON v.cve_id = x.cve_id LEFT JOIN cwes w ON w.cve_id = x.cve_id)"""
FILED = ingest.PRIMEVUL.replace(ingest._sql(ingest.RAW_PRIMEVUL), ingest._sql(ingest.RAW_PRIMEVUL | {"split": "CASE WHEN doc_id % 3 = 0 THEN ' Train' WHEN doc_id % 2 = 0 THEN 'valid' ELSE 'test' END"}))

QUERIES = {
    "source_primevul": (source_primevul, FILED),
    "source_diversevul": (source_diversevul, ingest.DIVERSEVUL),
    "source_bigvul": (source_bigvul, ingest.BIGVUL),
    "source_cvefixes": (source_cvefixes, ingest.RELATIONAL),
    "source_secvuleval": (source_secvuleval, ingest.RELATIONAL.replace(ingest._sql(ingest.RAW_RELATIONAL), RAW_DUMP).replace("'cvefixes", "'secvuleval")),
    "read_patches": (read_patches, f"SELECT method_id, commit_hash, file_path, sha1(code) AS digest FROM {REMOVED}"),
}
