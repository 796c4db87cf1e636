"""Queries on sources: files that a query writes and reads again, and the core rows of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import normalise
from quarry.plans.snippets import BLANKS_SQL
from quarry.sources import readers, writers
from quarry.sources.places import shared


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _expressions(spark: SparkSession, sf: str, expressions: dict[str, str], table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in expressions.items()])


def _sql(expressions: dict[str, str], table: str = "documents") -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in expressions.items())} FROM {table})"


DIGEST = "sha1(coalesce(text, ''))"
ROWS = f"SELECT doc_id, {DIGEST} AS digest, lang, n_chars FROM documents"


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "lang", "n_chars")


def read_json_lines(spark, sf):
    path = shared(spark, "jsonl")
    writers.json_lines(_docs(spark, sf), path)
    return _digests(readers.json_lines(spark, path, "doc_id long, text string, lang string, source string, n_chars long"))


def read_csv(spark, sf):
    path = shared(spark, "csv")
    _docs(spark, sf).write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    return _digests(readers.csv_rows(spark, path, "doc_id long, text string, lang string, source string, n_chars long"))


def read_parquet_columns(spark, sf):
    path = shared(spark, "nan")
    x = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 8)
    _docs(spark, sf).withColumn("x", x).write.parquet(path)
    return readers.parquet_columns(spark, path, "doc_id", "x")


def read_packed_text(spark, sf):
    """Lines of packed text files, counted by their first letter."""
    path = shared(spark, "text")
    _docs(spark, sf).filter("text IS NOT NULL").select(F.regexp_replace("text", "[\n\r]", " ")).write.option("compression", "gzip").text(path)
    return readers.text_lines(spark, path).groupBy(F.substring("line", 1, 1).alias("letter")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def read_dump(spark, sf):
    """One table of a COPY dump with two others, written with its escapes in numbered files."""
    d = _docs(spark, sf)
    escaped = F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), "\r", r"\\r"), F.lit("\\N"))
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), escaped, F.coalesce("lang", F.lit("\\N")), F.col("n_chars").cast("string"))
    said = lambda *lines: spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    part = lambda name, rows: [said(f"COPY public.{name} (doc_id, text, \"lang\", n_chars) FROM stdin;"), rows.select(line.alias("line")), said("\\.", "")]
    path = shared(spark, "dump")
    writers.in_order(spark, [*part("other", d.limit(3)), *part("documents", d), *part("more", d.limit(2))], path)
    got = readers.dump_rows(spark, path, "documents")
    return _digests(got.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("n_chars").cast("long").alias("n_chars")))


def read_table_report(spark, sf):
    """A table with bars, written line by line and read as rows."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    head = spark.createDataFrame([(0, "# Report"), (1, "| name | key |"), (2, "| --- | :-: |")], "at int, line string")
    body = n.select((F.col("n_nationkey") + 10).alias("at"), F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |")).alias("line"))
    path = shared(spark, "report")
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    return readers.table_rows(readers.text_lines(spark, path), "name", "key").select("name", F.col("key").cast("int").alias("key"))


def chunk_round_trip(spark, sf):
    """Rows in seven chunks, read one by one in the order of their numbers and together: each row once."""
    path = shared(spark, "chunks")
    writers.chunks(_docs(spark, sf), path, "normalized", 7, "doc_id", 1_000)
    return _digests(readers.chunks(spark, path, "normalized").filter("chunk BETWEEN 1 AND 7"))


def split_round_trip(spark, sf):
    """Splits written as folders, and a split's rows by the folder's name."""
    path = shared(spark, "splits")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "valid").when(F.col("lang") == "en", "test")
    writers.splits(_docs(spark, sf).withColumn("split", split), path)
    back = spark.read.parquet(path).select("doc_id", readers.split_of_path(F.regexp_extract("_metadata.file_path", "split=([^/]+)", 1)).alias("split"))
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def json_sink(spark, sf):
    """NaN and infinities come back as nulls."""
    path = shared(spark, "sane")
    x = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("n_chars") / 8)
    writers.json_lines(_docs(spark, sf).select("doc_id", x.alias("x")), path)
    return readers.json_lines(spark, path, "doc_id long, x double")


def evaluation_scan(spark, sf):
    rows = _docs(spark, sf).select(F.when(F.col("doc_id") % 7 == 0, " \n").otherwise(F.col("text")).alias("code"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 2).alias("y"), "lang")
    return readers.evaluation_rows(rows, "code", "y").groupBy("label").agg(F.count("*").alias("n"))


def window_scan(spark, sf):
    """Embedding columns only, with the number of each row in its group."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    return e.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), (F.row_number().over(w) - 1).alias("window_index"))


RAW_PRIMEVUL = {
    "idx": "doc_id", "func": "CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN NULL ELSE text END", "target": "CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'false' WHEN 2 THEN ' Vul ' ELSE '2' END",
    "split": "CASE doc_id % 3 WHEN 0 THEN ' Train' WHEN 1 THEN '' ELSE NULL END", "commit_id": "CASE doc_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN ' h1 ' ELSE 'h' || doc_id END",
    "cve": "CASE doc_id % 4 WHEN 0 THEN 'cve-2014-' || doc_id WHEN 1 THEN 'None' ELSE NULL END", "cwe": "split(CASE doc_id % 3 WHEN 0 THEN 'CWE-79;None; CWE-2 ' WHEN 1 THEN 'None' ELSE 'x CVE-2011-1' END, ';')",
    "cve_desc": "CASE doc_id % 6 WHEN 1 THEN 'seen in 12019 and 2017 or 1995' WHEN 3 THEN 'of 2055' ELSE ' null ' END", "func_hash": "' f' || doc_id", "file_hash": "'None'", "nvd_url": "CASE WHEN doc_id % 2 = 0 THEN 'u' END",
}
RAW_DIVERSEVUL = {
    "hash": "CASE WHEN doc_id % 9 > 0 THEN 'x' || doc_id END", "func": "text", "target": "'1'", "commit_id": "CASE doc_id % 8 WHEN 0 THEN NULL ELSE ' c' || (doc_id % 40) || ' ' END",
    "message": "CASE doc_id % 3 WHEN 0 THEN 'fix Cve-2012-12 and CVE-2013-1' ELSE 'fix' END", "cwe": "split(CASE doc_id % 2 WHEN 0 THEN 'CWE-1;CWE-2' ELSE 'None' END, ';')",
}
RAW_META = {"n": "doc_id", "commit_id": "'c' || (doc_id % 60)", "CVE": "CASE WHEN doc_id % 3 = 0 THEN 'CVE-2016-' || doc_id END", "CWE": "CASE WHEN doc_id % 4 = 0 THEN 'CWE-' || (doc_id % 7) ELSE 'None' END", "bug_info": "CASE WHEN doc_id % 5 > 0 THEN ' info ' || doc_id END"}
RAW_BIGVUL = {
    "row": "doc_id", "func_before": "text", "vul": "CASE doc_id % 3 WHEN 0 THEN '1' ELSE '0' END", "cve": "CASE doc_id % 4 WHEN 0 THEN 'CVE-1988-1' WHEN 1 THEN 'CVE-2018-7' WHEN 2 THEN 'None' END", "cwe": "CASE doc_id % 3 WHEN 0 THEN 'CWE-119' ELSE '' END",
    "publish_date": "CASE doc_id % 5 WHEN 0 THEN '2015-03-0' || (doc_id % 9 + 1) WHEN 1 THEN '1970-01-01' WHEN 2 THEN 'soon' WHEN 3 THEN ' 2009-12-31 23:30:00 ' END", "commit_id": "'h' || doc_id",
}
RAW_RELATIONAL = {
    "method_id": "doc_id", "method_before": "text", "vul": "CASE doc_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 't' WHEN 2 THEN 'vul' ELSE '0' END", "commit_hash": "'h' || doc_id", "committer_date": "CASE WHEN doc_id % 3 = 0 THEN '2011-05-06' END",
    "author_date": "CASE doc_id % 4 WHEN 0 THEN '2012-01-02 00:00:00' WHEN 1 THEN 'nan' END", "published_date": "CASE WHEN doc_id % 5 = 0 THEN '2013-02-03' END", "cve": "CASE WHEN doc_id % 2 = 0 THEN 'CVE-2010-1' END", "cwe": "'CWE-1'", "cve_desc": "text", "file_path": "CASE WHEN doc_id % 2 = 0 THEN ' a.c ' ELSE 'null' END",
}
SHOWN = ["id", "label", "split", "source_dataset", "commit_hash", "commit_date", "year", "cve", "cwe", "cve_desc", "func_hash", "file_hash", "nvd_url", "file_path"]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*SHOWN, F.sha1(F.col("code").cast("binary")).alias("digest"))


def core_primevul(spark, sf):
    return _shown(normalise.primevul(_expressions(spark, sf, RAW_PRIMEVUL)))


def core_diversevul(spark, sf):
    return _shown(normalise.diversevul(_expressions(spark, sf, RAW_DIVERSEVUL), normalise.first_metadata(_expressions(spark, sf, RAW_META), "n")))


def core_bigvul(spark, sf):
    return _shown(normalise.bigvul(_expressions(spark, sf, RAW_BIGVUL)))


def core_relational(spark, sf):
    return _shown(normalise.relational(_expressions(spark, sf, RAW_RELATIONAL), "cvefixes"))


def core_of_any(spark, sf):
    """All sources as one table, counted."""
    raw = _expressions(spark, sf, RAW_PRIMEVUL | {"lang_": "CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN ' cpp ' WHEN 2 THEN 'Java' END"})
    by_mapping = normalise.mapped(raw, "other", {"id": "idx", "code": "func", "label": "target", "split": "split", "commit_hash": "commit_id", "lang": "lang_", "date_from_cve": "cve"}, ("c", "cpp"))
    every = [normalise.primevul(_expressions(spark, sf, RAW_PRIMEVUL)), normalise.bigvul(_expressions(spark, sf, RAW_BIGVUL)), by_mapping]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    return rows.groupBy("source_dataset", "split", "label").agg(F.count("*").alias("n"), F.count("commit_date").alias("dated"))


def date_parse(spark, sf):
    raw = _expressions(spark, sf, {"k": "o_orderkey", "raw": "CASE o_orderkey % 7 WHEN 0 THEN ' 1500000000' WHEN 1 THEN '1500000000123' WHEN 2 THEN '2010-02-03' WHEN 3 THEN 'never' WHEN 4 THEN '2010-02-30' WHEN 5 THEN '1969-12-31 23:59:59' END"}, "orders")
    at = T.tolerant_timestamp(F.col("raw"))
    return raw.groupBy(F.year(at).alias("year"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at")).agg(F.count("*").alias("n"))


def commit_keys(spark, sf):
    raw = _expressions(spark, sf, {"k": "o_orderkey", "raw": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' None ' WHEN 2 THEN 'NULL' WHEN 3 THEN '' ELSE ' h' || (o_orderkey % 50) || ' ' END"}, "orders")
    return raw.groupBy(T.commit_key(F.col("raw"), F.col("k")).alias("key")).agg(F.count("*").alias("n"))


def _trim(c: str) -> str:
    return f"trim({c}, {BLANKS_SQL})"


def _scalar(c: str) -> str:
    return f"CASE WHEN {_trim(c)} NOT IN ('None', 'null', '') THEN {_trim(c)} END"


def _list(c: str) -> str:
    return f"nullif(array_to_string(list_filter(list_transform({c}, lambda x: {_trim('x')}), lambda x: x NOT IN ('None', 'null', '')), ';'), '')"


def _label(c: str) -> str:
    return f"(lower({_trim(c)}) IN ('1', 'true', 't', 'yes', 'vul', 'vulnerable'))::INT"


def _year(c: str) -> str:
    return f"nullif(regexp_extract({c}, '(?i)CVE-(\\d{{4}})-', 1), '')::INT"


def _core_sql(source: str, raw: str, **columns: str) -> str:
    return f"SELECT {', '.join(f'({columns.get(c, 'NULL')})::' + ('INT' if c in ('label', 'year') else 'VARCHAR') + f' AS {c}' if c != 'source_dataset' else f"'{source}' AS source_dataset" for c in SHOWN)}, sha1({columns['code']}) AS digest FROM {raw} WHERE {_trim(columns['code'])} <> ''"


SPLIT = f"nullif(lower({_trim('split')}), '')"
PRIMEVUL_YEAR = f"coalesce({_year('cve')}, list_filter(list_transform(cwe, lambda x: {_year('x')}), lambda y: y IS NOT NULL)[1], {_year('cve_desc')}, nullif(regexp_extract(cve_desc, '\\b(199[0-9]|20[0-2][0-9])\\b', 1), '')::INT)"
PRIMEVUL = _core_sql("primevul", _sql(RAW_PRIMEVUL), id=f"concat_ws('_', 'primevul', {SPLIT}, idx)", code="func", label=_label("target"), split=SPLIT, commit_hash=_scalar("commit_id"), year=PRIMEVUL_YEAR, commit_date=f"{PRIMEVUL_YEAR} || '-01-01'", cve=_scalar("cve"), cwe=_list("cwe"), cve_desc=_scalar("cve_desc"), func_hash=_scalar("func_hash"), file_hash=_scalar("file_hash"), nvd_url=_scalar("nvd_url"))
META = f"(SELECT {_trim('commit_id')} AS commit, arg_min({{'v': CVE, 'w': CWE, 'i': bug_info}}, (coalesce(CVE, '') = '')::INT * 1000000000 + n) AS m FROM {_sql(RAW_META)} GROUP BY 1)"
DIVERSE_CVE = "coalesce(nullif(upper(regexp_extract(m.v, '(?i)CVE-\\d{4}-\\d+')), ''), nullif(upper(regexp_extract(message, '(?i)CVE-\\d{4}-\\d+')), ''))"
DIVERSEVUL = _core_sql("diversevul", f"{_sql(RAW_DIVERSEVUL)} LEFT JOIN {META} ON {_trim('commit_id')} = commit", id="concat_ws('_', 'diversevul', coalesce(hash, commit_id))", code="func", label=_label("target"), commit_hash=_scalar("commit_id"), year=_year(DIVERSE_CVE), commit_date=f"{_year(DIVERSE_CVE)} || '-01-01'", cve=DIVERSE_CVE, cwe=f"coalesce({_scalar('m.w')}, {_list('cwe')})", cve_desc=_scalar("m.i"), nvd_url=f"'https://nvd.nist.gov/vuln/detail/' || {DIVERSE_CVE}")


def _read_date(c: str) -> str:
    return f"(CASE WHEN year(try_cast({_trim(c)} AS TIMESTAMP)) BETWEEN 1990 AND 2030 THEN try_cast({_trim(c)} AS TIMESTAMP) END)"


BIG_YEAR = f"(CASE WHEN {_year('cve')} BETWEEN 1990 AND 2030 THEN {_year('cve')} END)"
BIGVUL = _core_sql("bigvul", _sql(RAW_BIGVUL), id="'bigvul_' || row", code="func_before", label=_label("vul"), commit_hash="commit_id", year=f"coalesce(year({_read_date('publish_date')}), {BIG_YEAR})", commit_date=f"coalesce(strftime({_read_date('publish_date')}, '%Y-%m-%d'), {BIG_YEAR} || '-01-01')", cve=_scalar("cve"), cwe=_scalar("cwe"))
FIRST_DATE = f"coalesce({', '.join(_read_date(c) for c in ('committer_date', 'author_date', 'published_date'))})"
RELATIONAL = _core_sql("cvefixes", _sql(RAW_RELATIONAL), id="'cvefixes_' || method_id", code="method_before", label=f"(lower({_trim('vul')}) IN ('1', 'true', 't', 'yes'))::INT", commit_hash="commit_hash", year=f"coalesce(year({FIRST_DATE}), {BIG_YEAR})", commit_date=f"coalesce(strftime({FIRST_DATE}, '%Y-%m-%d'), {BIG_YEAR} || '-01-01')", cve=_scalar("cve"), cwe="cwe", cve_desc=f"nullif(substring({_trim('cve_desc')}, 1, 4000), '')", file_path=_scalar("file_path"))
ANY_RAW = _sql(RAW_PRIMEVUL | {"lang_": "CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN ' cpp ' WHEN 2 THEN 'Java' END"})
ANY = _core_sql("other", f"{ANY_RAW} WHERE (lang_ IS NULL OR lower({_trim('lang_')}) IN ('c', 'cpp')) AND TRUE", id="idx", code="func", label=_label("target"), split=SPLIT, commit_date=f"{_year('cve')} || '-01-01'").replace("AND TRUE WHERE", "AND")

QUERIES = {
    "read_json_lines": (read_json_lines, ROWS),
    "read_csv": (read_csv, ROWS),
    "read_parquet_columns": (read_parquet_columns, "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN n_chars / 8::DOUBLE END AS x FROM documents"),
    "read_packed_text": (read_packed_text, "SELECT substring(l, 1, 1) AS letter, count(*) AS n, sum(length(l))::BIGINT AS chars FROM (SELECT regexp_replace(text, '[\\n\\r]', ' ', 'g') AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1"),
    "read_dump": (read_dump, ROWS),
    "read_table_report": (read_table_report, "SELECT n_name AS name, n_regionkey AS key FROM nation"),
    "chunk_round_trip": (chunk_round_trip, ROWS),
    "split_round_trip": (split_round_trip, "SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'valid' WHEN lang = 'en' THEN 'test' END AS split FROM documents) WHERE split IS NOT NULL GROUP BY split"),
    "json_sink": (json_sink, "SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN n_chars / 8::DOUBLE END AS x FROM documents"),
    "evaluation_scan": (evaluation_scan, f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS code, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 END AS label FROM documents) WHERE label IS NOT NULL AND {_trim('code')} <> '' GROUP BY label"),
    "window_scan": (window_scan, "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 3) AS total, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS window_index FROM embeddings"),
    "core_primevul": (core_primevul, PRIMEVUL),
    "core_diversevul": (core_diversevul, DIVERSEVUL),
    "core_bigvul": (core_bigvul, BIGVUL),
    "core_relational": (core_relational, RELATIONAL),
    "core_of_any": (core_of_any, f"SELECT source_dataset, split, label, count(*) AS n, count(commit_date) AS dated FROM ({PRIMEVUL} UNION ALL {BIGVUL} UNION ALL {ANY}) GROUP BY ALL"),
    "date_parse": (date_parse, f"SELECT year(t) AS year, strftime(t, '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match({_trim('raw')}, '\\d{{10,13}}') THEN make_timestamp(substring({_trim('raw')}, 1, 10)::BIGINT * 1000000) ELSE try_cast({_trim('raw')} AS TIMESTAMP) END AS t FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN ' 1500000000' WHEN 1 THEN '1500000000123' WHEN 2 THEN '2010-02-03' WHEN 3 THEN 'never' WHEN 4 THEN '2010-02-30' WHEN 5 THEN '1969-12-31 23:59:59' END AS raw FROM orders)) GROUP BY ALL"),
    "commit_keys": (commit_keys, "SELECT CASE WHEN o_orderkey % 6 < 4 THEN '_row_' || o_orderkey ELSE 'h' || (o_orderkey % 50) END AS key, count(*) AS n FROM orders GROUP BY 1"),
}
