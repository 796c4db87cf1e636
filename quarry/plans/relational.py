"""Queries by time and relation: splits, leak audits, balance, lookups, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import temporal
from quarry.operators.ranking import first_by_hash



def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def year_histogram(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


def year_by_source(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


def _by_year(spark, sf, choose):
    o = _t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    names = choose(temporal.year_counts(o, F.col("year")))
    return o.withColumn("split", temporal.mapped(F.col("year"), names)).groupBy("year", "split").agg(F.count("*").alias("n"))


def optimized_split(spark, sf):
    return _by_year(spark, sf, temporal.optimized)


def chronological_split(spark, sf):
    return _by_year(spark, sf, temporal.chronological)


def _fixed(spark, sf):
    return _t(spark, sf, "orders").withColumn("split", temporal.fixed(F.year("o_orderdate"), 1998, 1999, 2001))


def fixed_split(spark, sf):
    return _fixed(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


def commit_split(spark, sf):
    """Rows of customers all of whose orders lie in one split."""
    o = _fixed(spark, sf)
    return o.drop("split").join(temporal.whole_groups(o, "o_custkey"), "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"))


def undated_commits(spark, sf):
    """Rows by split where each seventh order has no date: it goes with its customer's other orders."""
    o = _t(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate"))).withColumn("key", T.commit_key(F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit(" c"), F.col("o_orderkey") % 4000)), F.col("o_orderkey")))
    o = o.withColumn("split", temporal.fixed(F.year("o_orderdate"), 1998, 1999, 2001))
    kept = o.drop("split").join(temporal.whole_groups(o, "key", dated=F.col("o_orderdate").isNotNull()), "key")
    return kept.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate").isNull()).alias("undated"))


def commit_leaks(spark, sf):
    g = _fixed(spark, sf).groupBy("o_custkey").agg(F.countDistinct("split").alias("k"), F.count("*").alias("n")).filter("k > 1")
    return g.groupBy("k").agg(F.count("*").alias("groups"), F.sum("n").alias("n_rows"))


def split_pivot(spark, sf):
    return _fixed(spark, sf).groupBy(F.col("o_orderpriority").alias("source")).pivot("split", ["train", "valid", "test"]).agg(F.count(F.lit(1))).na.fill(0)


def temporal_order(spark, sf):
    """Whether each split ends before the next begins."""
    m = lambda f, s: f(F.when(F.col("split") == s, F.col("o_orderdate")))
    return _fixed(spark, sf).agg((m(F.max, "train") < m(F.min, "valid")).alias("train_before_valid"), (m(F.max, "valid") < m(F.min, "test")).alias("valid_before_test"))


def class_balance(spark, sf, target: float = 0.5):
    """As many rows of each label as the target share allows, chosen by a seeded hash of the id."""
    rows = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    n = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    keep = n.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), F.least("p", F.floor(F.col("q") * target / (1 - target))).alias("keep")), F.struct(F.lit(0).alias("label"), F.least("q", F.floor(F.col("p") * (1 - target) / target)).alias("keep")))).alias("x")).select("x.*")
    return first_by_hash(rows, "label", "doc_id", keep, "42")


def seeded_sample(spark, sf):
    """500 rows of each status by a seeded hash."""
    o = _t(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), "o_orderkey")
    return first_by_hash(o, "label", "o_orderkey", o.select("label").distinct().withColumn("keep", F.lit(500)), "7")


def multi_join(spark, sf):
    """A row with its lookups: left joins, one of them with an aggregate that makes it one row a key."""
    li, o, c = _t(spark, sf, "lineitem"), _t(spark, sf, "orders"), _t(spark, sf, "customer")
    lines = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"), F.count("*").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("flags"))
    j = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.filter(F.lower(F.coalesce("c_mktsegment", F.lit(""))).isin("building", "machinery", "")).select("o_orderkey", "part", "n_lines", "flags", "c_name")


def scalar_subquery(spark, sf):
    """For each customer the earliest order and the list of its priorities."""
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("x"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    return _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("x.o_orderkey").alias("first_order"), "priorities")


def metadata_lookup(spark, sf):
    """Of several metadata rows of a key the first with a value, else the first."""
    li = _t(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    best = li.groupBy("l_orderkey").agg(F.min(F.struct(F.col("v").isNull().alias("none"), "l_linenumber", "l_suppkey", "v")).alias("x"))
    return best.select("l_orderkey", F.col("x.l_linenumber").alias("line"), F.col("x.v").alias("value"))


def id_list_lookup(spark, sf):
    """Lists of ids looked up and collected again in order; unknown ids count 0."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"), F.posexplode(F.array("o_custkey", F.col("o_custkey") + 1, F.lit(-1).cast("long"))).alias("pos", "id"))
    j = o.join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id", "left")
    return j.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("c_nationkey", F.lit(0)).alias("v")))).alias("l")).select("o_orderkey", F.array_join(F.transform("l", lambda x: x["v"].cast("string")), ",").alias("found"))


def range_markers(spark, sf):
    """Band join of lines with the size ranges that hold them; ranges are a small fixed table."""
    bands = spark.createDataFrame([("small", 1, 10), ("medium", 8, 25), ("large", 20, 50)], "band string, lo int, hi int")
    p = _t(spark, sf, "part")
    return p.join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def union_sources(spark, sf):
    a = _t(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


def disjunctive_membership(spark, sf):
    """Suppliers and customers of a nation or of a segment: a union of two equi-joins instead of an OR."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    a = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_regionkey = 1").select("c_custkey")
    return a.unionByName(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()


def top_per_status(spark, sf):
    """The first five orders of each status by key; a bounded list for each, merged from partial lists."""
    o = _t(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    w = W.partitionBy("o_orderstatus").orderBy("o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def row_numbers(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("window_index"))


def sorted_page(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(30)


NAMED = "CASE WHEN year(o_orderdate) < 1998 THEN 'train' WHEN year(o_orderdate) < 1999 THEN 'valid' WHEN year(o_orderdate) < 2001 THEN 'test' END"
FIXED = f"WITH f AS (SELECT *, {NAMED} AS split FROM orders) "
COUNTS = "WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY year) AS i, sum(n) OVER (ORDER BY year) AS upto, sum(n) OVER () AS total, count(*) OVER () AS years FROM c) "
HASHED = "SELECT {0}, row_number() OVER (PARTITION BY {1} ORDER BY sha1('{2}' || {3}), {3}) AS r FROM {4}"

QUERIES = {
    "year_histogram": (year_histogram, "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1"),
    "year_by_source": (year_by_source, "SELECT o_orderpriority AS source, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2"),
    "optimized_split": (
        optimized_split,
        COUNTS
        + """, cuts AS (SELECT a.i AS i, b.i AS j, a.upto AS s1, b.upto - a.upto AS s2, a.total - b.upto AS s3, a.total AS total FROM k a JOIN k b ON b.i >= a.i),
        best AS (SELECT i, j FROM cuts ORDER BY (s1 - 0.7 * total) ** 2 + (s2 - 0.2 * total) ** 2 + (s3 - 0.1 * total) ** 2 + (0.05 * total) ** 2 * ((s2 = 0)::INT + (s3 = 0)::INT), i, j LIMIT 1)
        SELECT year::INT AS year, CASE WHEN k.i <= best.i THEN 'train' WHEN k.i <= best.j THEN 'valid' ELSE 'test' END AS split, n FROM k, best""",
    ),
    "chronological_split": (
        chronological_split,
        COUNTS
        + """, a AS (SELECT greatest(1, count(*) FILTER (upto <= 0.7 * total)) AS i FROM k), b AS (SELECT greatest(a.i + 1, max(CASE WHEN upto - (SELECT upto FROM k, a WHERE k.i = a.i) <= 0.2 * total THEN k.i ELSE 0 END)) AS j FROM k, a GROUP BY a.i)
        SELECT year::INT AS year, CASE WHEN k.i <= a.i THEN 'train' WHEN k.i <= b.j THEN 'valid' ELSE 'test' END AS split, n FROM k, a, b""",
    ),
    "fixed_split": (fixed_split, FIXED + "SELECT split, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM f GROUP BY split"),
    "commit_split": (commit_split, FIXED + "SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM f WHERE o_custkey IN (SELECT o_custkey FROM f GROUP BY 1 HAVING count(DISTINCT split) = 1 AND count(split) = count(*)) GROUP BY split"),
    "undated_commits": (
        undated_commits,
        """WITH o AS (SELECT CASE WHEN o_custkey % 5 > 0 THEN 'c' || (o_orderkey % 4000) ELSE '_row_' || o_orderkey END AS key, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS y FROM orders), s AS (SELECT *, CASE WHEN y < 1998 THEN 'train' WHEN y < 1999 THEN 'valid' WHEN y < 2001 THEN 'test' END AS split FROM o),
        g AS (SELECT key, min(split) AS split FROM s GROUP BY key HAVING min(split) = max(split) AND count(y) = count(split)) SELECT g.split, count(*) AS n, count(*) FILTER (y IS NULL) AS undated FROM o JOIN g USING (key) GROUP BY g.split""",
    ),
    "commit_leaks": (commit_leaks, FIXED + "SELECT k, count(*) AS groups, sum(n)::BIGINT AS n_rows FROM (SELECT count(DISTINCT split) AS k, count(*) AS n FROM f GROUP BY o_custkey HAVING k > 1) GROUP BY k"),
    "split_pivot": (split_pivot, FIXED + "SELECT o_orderpriority AS source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM f GROUP BY 1"),
    "temporal_order": (temporal_order, FIXED + "SELECT max(o_orderdate) FILTER (split = 'train') < min(o_orderdate) FILTER (split = 'valid') AS train_before_valid, max(o_orderdate) FILTER (split = 'valid') < min(o_orderdate) FILTER (split = 'test') AS valid_before_test FROM f"),
    "class_balance": (class_balance, f"SELECT label, doc_id FROM ({HASHED.format('doc_id, quality AS label', 'quality', '42', 'doc_id', 'labels')}) WHERE r <= (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) FROM labels)"),
    "seeded_sample": (seeded_sample, f"SELECT label, o_orderkey FROM ({HASHED.format('o_orderkey, o_orderstatus AS label', 'o_orderstatus', '7', 'o_orderkey', 'orders')}) WHERE r <= 500"),
    "multi_join": (
        multi_join,
        """WITH a AS (SELECT l_orderkey, min(l_partkey) AS part, count(*) AS n_lines, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
        SELECT o_orderkey, part, n_lines, flags, c_name FROM orders LEFT JOIN a ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE lower(coalesce(c_mktsegment, '')) IN ('building', 'machinery', '')""",
    ),
    "scalar_subquery": (scalar_subquery, "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_order, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS priorities FROM customer"),
    "metadata_lookup": (metadata_lookup, "SELECT l_orderkey, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag IS DISTINCT FROM 'R', l_linenumber, l_suppkey, l_partkey) = 1"),
    "id_list_lookup": (
        id_list_lookup,
        "SELECT o_orderkey, string_agg(coalesce(c_nationkey, 0)::VARCHAR, ',' ORDER BY pos) AS found FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest([o_custkey, o_custkey + 1, -1]) AS id FROM orders) LEFT JOIN customer ON id = c_custkey GROUP BY 1",
    ),
    "range_markers": (range_markers, "SELECT band, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part JOIN (VALUES ('small', 1, 10), ('medium', 8, 25), ('large', 20, 50)) b(band, lo, hi) ON p_size BETWEEN lo AND hi GROUP BY band"),
    "union_sources": (union_sources, "SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier"),
    "disjunctive_membership": (disjunctive_membership, "SELECT c_custkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR c_mktsegment = 'BUILDING'"),
    "top_per_status": (top_per_status, "SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 5"),
    "row_numbers": (row_numbers, "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS window_index FROM lineitem"),
    "sorted_page": (sorted_page, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 20"),
}
