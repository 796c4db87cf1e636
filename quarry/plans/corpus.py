"""Queries on texts: cleaning, filtering, exact duplicates, windows, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import windows
from quarry.plans import snippets

#: What code in other languages has in its first lines, and what C and C++ have anywhere.
REJECT = [
    r"^\s*def\s+\w+",
    r"^\s*async\s+def\s+",
    r"^\s*import\s+(java|javax|org\.|com\.)",
    r"^\s*package\s+(java|javax|com\.|org\.)",
    r"^\s*public\s+(class|interface|enum)\s+",
    r"^\s*<?php\b",
    r"^\s*fn\s+\w+\s*\(",
    r"^\s*func\s+\w+\s*\([^)]*\)\s*\{",
]
POSITIVE = [r"\{", r"\}", r";", r"\b(int|void|char|float|double|long|short|unsigned|bool|size_t)\b", r"#\s*include\b", r"->", r"::", r"\breturn\b", r"\bif\s*\("]
EXTENSIONS = [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inl", ".ipp"]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def clean_dedup_by_lang(spark, sf):
    """Documents per language, and distinct cleaned texts among them."""
    d = _docs(spark, sf).select("lang", F.sha1(T.tidy(T.without_comments(F.col("text"))).cast("binary")).alias("h"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("h").alias("n_texts"))


TIDY = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?m)[ \t\r\f\v]+$', '', 'g'), '\n{{3,}}', E'\n\n', 'g'), '\A\s+|\s+\z', '', 'g')"
STRIP = r"regexp_replace(regexp_replace({0}, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*?$', '', 'g')"
CLEAN = TIDY.format(STRIP.format("text"))
#: Runs of characters that aren't white space, by the table of Unicode white space.
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{BLANK.replace('[', '[^')}+'))"


def clean_offline(spark, sf):
    d = _docs(spark, sf)
    c = T.tidy(T.without_comments(F.col("text")))
    return d.select("doc_id", F.length(c).cast("long").alias("n"), F.sha1(c.cast("binary")).alias("digest"))


def drop_reasons(spark, sf):
    c = T.tidy(T.without_comments(F.col("text")))
    return _docs(spark, sf).select("source", F.coalesce(T.drop_reason(c), F.lit("kept")).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


def token_profile(spark, sf):
    d = _docs(spark, sf).select("lang", F.length("text").alias("c"), T.n_tokens(F.col("text")).alias("t"))
    p = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    g = d.groupBy("lang").agg(F.count("*").alias("n"), p("c").alias("pc"), p("t").alias("pt"), F.count_if(F.col("t") > 500).alias("n_long"), F.count_if(F.coalesce("c", F.lit(0)) == 0).alias("n_empty"))
    return g.select("lang", "n", "n_long", "n_empty", *[F.round(F.col(v)[i], 3).alias(f"{k}{q}") for k, v in (("chars_p", "pc"), ("tokens_p", "pt")) for i, q in enumerate((50, 90, 99))])


def content_predicate(spark, sf):
    """Why a text isn't taken for C or C++, by what it holds and by its file's extension."""
    code, path = snippets.code(F.col("doc_id"), F.col("text")), snippets.path(F.col("doc_id"))
    t = T.strip(code)
    head = F.array_join(F.slice(F.split(t, "\n"), 1, 30), "\n")
    rejected = F.rlike(head, F.lit("(?m)" + "|".join(f"(?:{p})" for p in REJECT)))
    reason = F.when(F.coalesce(t, F.lit("")) == "", "skip_empty").when(~T.extension_allowed(path, EXTENSIONS), "skip_extension").when(rejected | (T.first_match_count(t, POSITIVE) < 2), "skip_content").otherwise("pass")
    return _docs(spark, sf).select("source", reason.alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


def exact_dedup_first_wins(spark, sf):
    """Of equal texts the first by doc_id; an aggregate with partial minima, no sort of a group."""
    return _docs(spark, sf).groupBy(F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def exact_dedup_in_source(spark, sf):
    """The same with one index for each source."""
    return _docs(spark, sf).groupBy("source", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id")).groupBy("source").agg(F.count("*").alias("kept"), F.sum("doc_id").alias("ids"))


def duplicate_leaks(spark, sf):
    """Texts that more than one source holds, and how many rows have them."""
    g = _docs(spark, sf).groupBy(F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).agg(F.countDistinct(F.coalesce("source", F.lit(""))).alias("k"), F.count("*").alias("n")).filter("k > 1")
    return g.agg(F.count("*").alias("n_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def token_windows(spark, sf):
    return windows.expanded(_docs(spark, sf), "doc_id", "text").select("function_group_id", "window_id", "window_index", "window_count", "is_windowed", "token_count", F.sha1(F.col("code").cast("binary")).alias("digest"))


def window_counts(spark, sf):
    """Windows partition a text's tokens: their counts add up to the whole text's."""
    w = windows.expanded(_docs(spark, sf), "doc_id", "text")
    return w.groupBy(F.col("function_group_id").alias("doc_id")).agg(F.sum("token_count").alias("tokens"), F.max((F.col("token_count") > windows.MOST).cast("int")).alias("too_long"))


def _vocabulary(spark: SparkSession):
    """The ranks of the public byte-pair vocabulary that this installation has."""
    import public_tokenizers

    return windows.ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def tokenizer_counts(spark, sf):
    """Byte-pair tokens of whole texts."""
    return windows.token_counts(_docs(spark, sf), "doc_id", "text", _vocabulary(spark))


def tokenizer_windows(spark, sf):
    """Windows of byte-pair tokens; every seventh text without its white space, so that characters are all there is to cut at."""
    d = _docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"(?U)\s", "")).otherwise(F.col("text")))
    return windows.expanded(d, "doc_id", "text", _vocabulary(spark)).select("function_group_id", "window_id", "window_index", "window_count", "is_windowed", "token_count", F.sha1(F.col("code").cast("binary")).alias("digest"))


def metadata_hints(spark, sf):
    p = _docs(spark, sf)
    h = T.hints(F.col("text"), r"(?i)\b(?:http|www|mail)\w*")
    return p.select("doc_id", F.array_join(h, ",").alias("hints")).filter("hints <> ''")


def scalar_normalisation(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    raw = F.when(F.col("o_orderkey") % 5 == 0, " None ").when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return o.groupBy(T.normal_scalar(raw).alias("value")).agg(F.count("*").alias("n"))


def label_coercion(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    raw = F.element_at(F.array(*map(F.lit, ["1", "true", "0.5", "2", "no", " YES ", "-1", "vulnerable", "", "T\u00a0"])), (F.col("o_orderkey") % 10 + 1).cast("int"))
    number = (F.col("o_orderkey") % 7 - 3) / 2.0
    return o.groupBy(raw.alias("raw"), number.alias("number"), T.label(raw).alias("label"), T.label_of_number(number).alias("number_label"), T.label_of_sql(raw).alias("sql_label")).agg(F.count("*").alias("n"))


def row_ids(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    split = T.split_name(F.when(F.col("o_orderstatus") == "F", "dev").when(F.col("o_orderstatus") == "O", "Testing").otherwise("other"))
    return o.select("o_orderkey", T.row_id(F.lit("src"), split, F.col("o_orderkey").cast("string")).alias("id"))


def truncation(spark, sf):
    c = T.truncated(F.col("text"), 200)
    return _docs(spark, sf).select("doc_id", F.sha1(F.coalesce(c, F.lit("")).cast("binary")).alias("digest"))


def _sha(x: str) -> str:
    return f"sha1({x})"


QUERIES = {
    "clean_dedup_by_lang": (clean_dedup_by_lang, f"SELECT lang, count(*) AS n_docs, count(DISTINCT {CLEAN}) AS n_texts FROM documents GROUP BY lang"),
    "clean_offline": (clean_offline, f"SELECT doc_id, length(c)::BIGINT AS n, sha1(c) AS digest FROM (SELECT doc_id, {CLEAN} AS c FROM documents)"),
    "drop_reasons": (
        drop_reasons,
        f"""SELECT source, CASE WHEN coalesce(trim(c), '') = '' THEN 'empty' WHEN len(regexp_extract_all(c, '(?m)^.*\\S.*$')) < 3 THEN 'min_lines'
        WHEN {tokens_sql('c')} < 50 THEN 'min_tokens' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT source, {CLEAN} AS c FROM documents) GROUP BY ALL""",
    ),
    "token_profile": (
        token_profile,
        "SELECT lang, count(*) AS n, count(*) FILTER (t > 500) AS n_long, count(*) FILTER (coalesce(c, 0) = 0) AS n_empty, "
        + ", ".join(f"round(quantile_cont({v}, {q / 100}), 3)::DOUBLE AS {k}{q}" for k, v in (("chars_p", "c"), ("tokens_p", "t")) for q in (50, 90, 99))
        + f" FROM (SELECT lang, length(text)::DOUBLE AS c, {tokens_sql('text')}::DOUBLE AS t FROM documents) GROUP BY lang",
    ),
    "content_predicate": (
        content_predicate,
        f"""SELECT source, CASE WHEN coalesce(t, '') = '' THEN 'skip_empty' WHEN NOT (p IS NULL OR regexp_extract(p, '(\\.[^./]+)$', 1) IN ({', '.join(f"'{e}'" for e in EXTENSIONS)})) THEN 'skip_extension'
        WHEN {' OR '.join(f"regexp_matches(h, '(?m){p}')" for p in REJECT)} OR {' + '.join(f"regexp_matches(t, '{p}')::INT" for p in POSITIVE)} < 2 THEN 'skip_content' ELSE 'pass' END AS reason, count(*) AS n
        FROM (SELECT *, array_to_string(list_slice(string_split(t, E'\\n'), 1, 30), E'\\n') AS h FROM (SELECT source, {snippets.PATH_SQL} AS p, trim({snippets.CODE_SQL}, {snippets.BLANKS_SQL}) AS t FROM documents)) GROUP BY ALL""",
    ),
    "exact_dedup_first_wins": (exact_dedup_first_wins, "SELECT sha1(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "exact_dedup_in_source": (exact_dedup_in_source, "SELECT source, count(*) AS kept, sum(doc_id)::BIGINT AS ids FROM (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL) GROUP BY source"),
    "duplicate_leaks": (duplicate_leaks, "SELECT count(*) AS n_texts, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS n, count(DISTINCT coalesce(source, '')) AS k FROM documents GROUP BY coalesce(text, '') HAVING k > 1)"),
    "token_windows": (token_windows, None),
    "tokenizer_counts": (tokenizer_counts, None),
    "tokenizer_windows": (tokenizer_windows, None),
    "window_counts": (window_counts, f"SELECT doc_id, {tokens_sql("coalesce(text, '')")}::BIGINT AS tokens, 0 AS too_long FROM documents"),
    "metadata_hints": (
        metadata_hints,
        r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(h, range(len(h))), lambda x: list_position(h, x[1]) = x[2] + 1), lambda x: x[1]), ',') AS hints
        FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)\b(?:http|www|mail)\w*'), lambda x: upper(x)) AS h FROM documents) WHERE len(h) > 0""",
    ),
    "scalar_normalisation": (
        scalar_normalisation,
        "SELECT CASE WHEN v NOT IN ('None', 'null', '') THEN v END AS value, count(*) AS n FROM (SELECT trim(CASE WHEN o_orderkey % 5 = 0 THEN ' None ' WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority END) AS v FROM orders) GROUP BY 1",
    ),
    "label_coercion": (
        label_coercion,
        f"""SELECT raw, number, (lower(trim(raw, {snippets.BLANKS_SQL})) IN ('1', 'true', 't', 'yes', 'vul', 'vulnerable'))::INT AS label, (trunc(number) <> 0)::INT AS number_label, (lower(trim(raw, {snippets.BLANKS_SQL})) IN ('1', 'true', 't', 'yes'))::INT AS sql_label, count(*) AS n
        FROM (SELECT ['1', 'true', '0.5', '2', 'no', ' YES ', '-1', 'vulnerable', '', 'T' || chr(160)][o_orderkey % 10 + 1] AS raw, (o_orderkey % 7 - 3) / 2.0::DOUBLE AS number FROM orders) GROUP BY ALL""",
    ),
    "row_ids": (row_ids, "SELECT o_orderkey, concat_ws('_', 'src', CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'test' END, o_orderkey) AS id FROM orders"),
    "truncation": (truncation, "SELECT doc_id, sha1(coalesce(CASE WHEN length(text) > 200 THEN rtrim(substring(text, 1, 200)) || ' ...' ELSE text END, '')) AS digest FROM documents"),
}
