"""The corpora that a root folder holds, as raw rows of their own columns and as core rows: which files a source has decides how it is read.

A source has a folder of its name. primevul: *.jsonl in jsonl/ and paired/, else train.jsonl, valid.jsonl and test.jsonl;
diversevul: diversevul.parquet, else diversevul.jsonl, and metadata.jsonl; bigvul: cleaned.parquet, else cleaned.csv;
cvefixes: cvefixes.jsonl, else dump.sql; secvuleval: dump.sql, and patches/*.patch besides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import normalise
from quarry.sources import csv_splits, datasource, readers

#: Raw columns of the sources.
PRIMEVUL = "idx string, func string, target string, split string, commit_id string, cve string, cwe array<string>, cve_desc string, func_hash string, file_hash string, nvd_url string"
DIVERSEVUL = "hash string, func string, target string, commit_id string, message string, cwe array<string>"
METADATA = "n long, commit_id string, CVE string, CWE string, bug_info string"
BIGVUL = "row string, func_before string, vul string, cve string, cwe string, publish_date string, commit_id string"
RELATIONAL = "method_id string, method_before string, vul string, commit_hash string, committer_date string, author_date string, published_date string, cve string, cwe string, cve_desc string, file_path string"
#: Languages of changed files that count, and the fewest characters of a method in a dump.
LANGUAGES, LEAST = ["c", "c++", "cpp", "", "none"], 10


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def json_lines(spark: SparkSession, root: str, schema: str, folders: str = "", fallback: str = "", part_bytes: int = datasource.PART) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("quarry_json_lines").schema(schema).option("folders", folders).option("fallback", fallback).option("part_bytes", part_bytes).load(root)


def joined_cwes(classified: DataFrame) -> DataFrame:
    """(cve_id, cwe): the CWE ids of each CVE, sorted."""
    return classified.groupBy("cve_id").agg(F.array_join(F.array_sort(F.collect_list("cwe_id")), ";").alias("cwe"))


def dates(commits: DataFrame, fixes: DataFrame, cves: DataFrame, classified: DataFrame) -> DataFrame:
    """(commit_hash, committer_date, author_date, cve, published_date, cve_desc, cwe, committed): a row for each commit and for each fixed one, with the smallest of its CVEs; committed says whether it is among the commits."""
    one = fixes.groupBy("hash").agg(F.min("cve_id").alias("cve_id"))
    c = commits.groupBy("hash").agg(F.min_by(F.struct("committer_date", "author_date"), F.struct("committer_date", "author_date")).alias("d"))
    j = c.join(one, "hash", "full").join(cves.select("cve_id", "published_date", "description"), "cve_id", "left").join(joined_cwes(classified), "cve_id", "left")
    return j.select(F.col("hash").alias("commit_hash"), "d.committer_date", "d.author_date", F.col("cve_id").alias("cve"), "published_date", F.col("description").alias("cve_desc"), "cwe", F.col("d").isNotNull().alias("committed"))


def dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows of a dump's methods, and its commits' metadata, each table read in splits."""
    table = lambda name: readers.dump_rows(spark, path, name)
    meta = dates(table("commits"), table("fixes"), table("cve"), table("cwe_classification"))
    language = F.lower(F.coalesce("programming_language", F.lit("")))
    changed = table("file_change").filter(language.isin(LANGUAGES)).select("file_change_id", F.col("hash").alias("commit_hash"), F.coalesce("filename", "new_path", "old_path").alias("file_path"))
    methods = table("method_change").select(F.col("method_change_id").alias("method_id"), F.col("code").alias("method_before"), F.col("before_change").alias("vul"), "file_change_id")
    j = methods.filter(F.length(strip(F.col("method_before"))) >= LEAST).join(changed, "file_change_id").join(meta, "commit_hash", "left")
    return j.select(*[c.split()[0] for c in RELATIONAL.split(", ")]), meta


def patches(spark: SparkSession, path: str, meta: DataFrame | None) -> DataFrame:
    """Raw rows of removed runs, all vulnerable, with their commits' metadata where a dump has it."""
    datasource.register(spark)
    rows = spark.read.format("quarry_patches").load(path).withColumn("vul", F.lit("1"))
    columns: dict[str, Column] = {c.split()[0]: F.col(c.split()[0]) for c in RELATIONAL.split(", ")}
    if meta is None:
        return rows.select(*[c.alias(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n, c in columns.items()])
    return rows.join(meta.filter("committed"), "commit_hash", "left").select(*columns.values())


def raw_primevul(spark: SparkSession, root: str) -> DataFrame:
    return json_lines(spark, root, PRIMEVUL, "jsonl,paired", "train.jsonl,valid.jsonl,test.jsonl")


def raw_bigvul(spark: SparkSession, root: str) -> DataFrame:
    if there(spark, f"{root}/cleaned.parquet"):
        return readers.parquet_columns(spark, f"{root}/cleaned.parquet", *[c.split()[0] for c in BIGVUL.split(", ")])
    return csv_splits.csv_rows(spark, f"{root}/cleaned.csv", BIGVUL)


def raw_cvefixes(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines where they are there, else the dump."""
    if there(spark, f"{root}/cvefixes.jsonl"):
        return json_lines(spark, root, RELATIONAL, fallback="cvefixes.jsonl")
    return dump(spark, f"{root}/dump.sql")[0]


def raw_secvuleval(spark: SparkSession, root: str) -> DataFrame:
    """The dump's methods and then the patches' runs, whichever of the two is there."""
    rows, meta = dump(spark, f"{root}/dump.sql") if there(spark, f"{root}/dump.sql") else (None, None)
    if there(spark, f"{root}/patches"):
        more = patches(spark, f"{root}/patches", meta)
        rows = more if rows is None else rows.unionByName(more)
    return spark.createDataFrame([], RELATIONAL) if rows is None else rows


def _diversevul(spark: SparkSession, root: str) -> DataFrame:
    packed = f"{root}/diversevul.parquet"
    raw = spark.read.schema(DIVERSEVUL).parquet(packed) if there(spark, packed) else json_lines(spark, root, DIVERSEVUL, fallback="diversevul.jsonl")
    return normalise.diversevul(raw, normalise.first_metadata(json_lines(spark, root, METADATA, fallback="metadata.jsonl"), "n"))


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "primevul": lambda spark, root: normalise.primevul(raw_primevul(spark, root)),
    "diversevul": _diversevul,
    "bigvul": lambda spark, root: normalise.bigvul(raw_bigvul(spark, root)),
    "cvefixes": lambda spark, root: normalise.relational(raw_cvefixes(spark, root), "cvefixes"),
    "secvuleval": lambda spark, root: normalise.relational(raw_secvuleval(spark, root), "secvuleval"),
}


def core_rows(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """Core rows of the named sources, of all whose folder is there if none is named."""
    chosen = names or [n for n in SOURCES if there(spark, f"{root}/{n}")]
    out = None
    for name in chosen:
        rows = SOURCES[name](spark, f"{root}/{name}")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in normalise.CORE.items())) if out is None else out
