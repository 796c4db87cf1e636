"""Allow and block rules on hosts and paths, with DataFrame functions only.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's. Each
URL is expanded into host suffixes joined to path prefixes. Only the shapes that rules have (number of labels, length of
the path) are made, so a long host or path costs no more than a short one. An expression meets the rules whose SHA-256
begins with the same five hexadecimal digits in an equi-join; the full digest then confirms. Of the rules that fit, the
longest (host and path together, in code points) wins, of these the one with the longest host; block wins over allow
where both stand for the same host and path.

What rules can see of a URL is its address: the last labels of its host and the first characters of its path. URLs are
counted by address first, and rules are looked up once for each address. The join back to the rows broadcasts the
addresses that have a rule where they are few (counted); else the hot ones, of which there can be no more than HOT_PART,
and the others are joined by a shuffle in which no key has more than one row in HOT_PART.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that are joined on: 16 ** 5 different ones at most.
PREFIX = 5
#: Rules, and addresses with rules, of which no more than so many rows of fixed size are broadcast.
BROADCAST_ROWS = 100_000
#: An address is hot that one row in so many has.
HOT_PART = 10_000
#: The rules of the query (fixed values): host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty for nulls and where there is no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _prepared(rules: DataFrame) -> DataFrame:
    """(rule, verdict, labels, plen, rank, digest, prefix), one row for each host and path; rules without a host don't count."""
    full = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").filter("h <> '' and verdict in ('allow', 'block')")
    one = full.groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    text = F.concat("h", "p")
    return one.select(
        text.alias("rule"), "verdict", F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("plen"),
        F.struct(F.length(text).alias("whole"), F.length("h").alias("host")).alias("rank"), F.sha2(text, 256).alias("digest"), F.substring(F.sha2(text, 256), 1, PREFIX).alias("prefix"),
    )


def _looked_up(addresses: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(key, n, rule, verdict) of the addresses (tail, head, key, n) that a rule fits."""
    made = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(plen).alias("plen")) for labels, plen in shapes])
    fits = lambda s: (s["labels"] <= F.size(F.split("tail", r"\."))) & (s["plen"] <= F.length("head"))
    text = lambda s: F.concat(F.call_function("substring_index", F.col("tail"), F.lit("."), -s["labels"]), F.substring(F.col("head"), F.lit(1), s["plen"]))
    asked = addresses.select("key", "n", F.explode(F.transform(F.filter(made, fits), lambda s: F.sha2(text(s), 256))).alias("full")).withColumn("prefix", F.substring("full", 1, PREFIX))
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    else:  # at most 16 ** PREFIX rows, whatever the number of rules
        asked = asked.join(F.broadcast(rules.select("prefix").distinct()), "prefix", "left_semi")
    hits = asked.join(rules, "prefix").filter("full = digest")
    return hits.groupBy("key", "n").agg(F.max(F.struct("rank", "rule", "verdict")).alias("x")).select("key", "n", "x.rule", "x.verdict")


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with columns __host and __path) with __rule and __verdict of the rule that wins, null where none fits."""
    rules = written(_prepared(rules), "url-rules")
    shapes = sorted((r["labels"], r["plen"]) for r in rules.select("labels", "plen").distinct().collect())
    if not shapes:
        return urls.withColumns({"__rule": F.lit(None).cast("string"), "__verdict": F.lit(None).cast("string")})
    # Rules see no more of a URL than this.
    tail = F.substring_index("__host", ".", -max(labels for labels, _ in shapes))
    head = F.substring("__path", 1, max(plen for _, plen in shapes))
    key = F.sha2(F.concat(tail, head), 256)
    addresses = urls.filter("__host <> ''").groupBy(tail.alias("tail"), head.alias("head")).agg(F.count("*").alias("n"))
    hits = written(_looked_up(addresses.withColumn("key", F.sha2(F.concat("tail", "head"), 256)), rules, shapes), "url-hits")
    keyed = urls.withColumn("__key", F.when(F.col("__host") != "", key))
    found = hits.select(F.col("key").alias("__key"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"))
    count, total = hits.agg(F.count("*"), F.sum("n")).first()
    if count <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(found), "__key", "left").drop("__key")
    hot = F.broadcast(found.join(hits.filter(F.col("n") * HOT_PART >= total).select(F.col("key").alias("__key")), "__key", "left_semi"))
    some = keyed.join(hot, "__key")
    rest = keyed.filter("__key is not null").join(hot, "__key", "left_anti").join(found, "__key", "left")
    none = keyed.filter("__key is null").withColumns({"__rule": F.lit(None).cast("string"), "__verdict": F.lit(None).cast("string")})
    return some.unionByName(rest).unionByName(none).drop("__key")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule and verdict for each row of pages; rules has columns host, path and verdict (allow or block).

    rule is the winning rule's host and path, null where none fits; verdict then is `default`. Null urls and those without
    `://` have an empty host and path, which no rule fits. Ids don't matter: nulls and repeated rows each give a row. An
    empty table gives no rows, no rules give `default` everywhere. Rules without a host, or with another verdict, don't
    count; columns besides the two are not read.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("__id"), host.alias("__host"), path.alias("__path"))
    out = _ruled(urls, rules)
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages that judged() allows, with all their columns and no other."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    out = _ruled(pages.withColumns({"__host": host, "__path": path}), rules)
    return out.filter(F.coalesce("__verdict", F.lit(default)) == "allow").select(*[F.col(f"`{c}`") for c in pages.columns])


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), d AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
