"""K-d tree partitioning of a table into shards of near equal bytes.

A node is split at the weighted median of its widest metadata dimension until each leaf reaches the target bytes. All
nodes of a level are split at once. A median is found by refining histograms: each pass sums the bytes of each node's
buckets over the whole table, and only the bucket that the median falls into is divided further, so what reaches the
driver is a bounded number of sums, and no node is gathered or sorted. Rows with equal values are told apart by a hash
of their row, so a value that a third of all rows share is split like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import written

#: Histogram sums that a pass brings to the driver at most; a median is exact to this share of its node's bytes.
MAX_SUMS, TOLERANCE = 65_536, 2**-13
TIE_RANGE = 2**31


def leading(text: Column) -> Column:
    """A string as a number that keeps the order of its first six bytes; null as 0."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long"), F.lit(0))


def _medians(rows: DataFrame, nodes: dict[int, dict], dims: list[str]) -> None:
    """Gives each node with leaves > 1 the keys `value` and `tie`: rows under (value, tie) go left."""
    for n in nodes.values():
        n |= {"phase": 0, "value": 0, "at": n["lo"], "step": 0, "end": n["hi"], "below": 0, "tie": 0}
    spark, todo = rows.sparkSession, dict(nodes)
    while todo:
        buckets = max(16, MAX_SUMS // len(todo))
        for n in todo.values():
            n["step"] = max(1, -(-(n["end"] - n["at"] + 1) // buckets))
        ask = spark.createDataFrame([(k, n["dim"], n["phase"], n["value"], n["at"], n["end"], n["step"]) for k, n in todo.items()], "node long, dim int, phase int, value long, at long, end long, step long")
        own = F.element_at(F.array(*dims), F.col("dim") + 1)
        x = F.when(F.col("phase") == 0, own).otherwise(F.col("tie"))
        sums = (
            rows.join(ask, "node")
            .withColumn("x", x)
            .filter((F.col("x") >= F.col("at")) & (F.col("x") <= F.col("end")) & ((F.col("phase") == 0) | (own == F.col("value"))))
            .groupBy("node", F.floor((F.col("x") - F.col("at")) / F.col("step")).alias("bucket"))
            .agg(F.sum("size").alias("bytes"))
            .collect()
        )
        by: dict[int, list[tuple[int, int]]] = {}
        for r in sums:
            by.setdefault(r["node"], []).append((r["bucket"], r["bytes"]))
        for k, n in list(todo.items()):
            for bucket, got in sorted(by[k]):
                if n["below"] + got >= n["want"]:
                    break
                n["below"] += got
            begin = n["at"] + bucket * n["step"]
            if got > n["bytes"] * TOLERANCE and n["step"] > 1:
                n["at"], n["end"] = begin, min(begin + n["step"] - 1, n["end"])
            elif got > n["bytes"] * TOLERANCE and n["phase"] == 0:
                n["phase"], n["value"], n["at"], n["end"] = 1, begin, 0, TIE_RANGE - 1
            else:  # the nearer edge of the bucket
                edge = begin if n["want"] - n["below"] < n["below"] + got - n["want"] else begin + n["step"]
                if n["phase"] == 0:
                    n["value"], n["tie"] = edge, 0
                else:
                    n["tie"] = edge
                del todo[k]


def partitioned(rows: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """`rows` with a column shard, 0 to shards - 1, by a k-d tree.

    `rows`, which is written and then read many times, is narrow: size (bytes, long), tie (a hash of the row from 0 to
    TIE_RANGE - 1) and the dimensions, all long and not null. Either the number of leaves is given, or the bytes that a
    leaf may have, which gives the number. A node of k leaves is split at the point that halves k, so any number works.
    A dimension's width in a node is its range there as a share of its range in the whole table; where no dimension has
    a range, rows are split by tie. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    # A stored column: joins by it stay joins, where a constant would become a product with the table of nodes.
    rows = written(rows.withColumn("node", F.lit(1).cast("long")), "kd-root")
    ranges = [f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
    leaves: dict[int, int] = {}
    wide: list[int] = []
    while True:
        level = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
        if not level:
            return rows.withColumn("shard", F.lit(0)).drop("node")
        if not wide:
            leaves[1] = shards or max(1, math.ceil(level[1]["bytes"] / target_bytes))
            wide = [max(1, level[1][f"hi{i}"] - level[1][f"lo{i}"]) for i in range(len(dims))]
        nodes = {}
        for k, r in level.items():
            if leaves.get(k, 1) > 1:
                widths = [(r[f"hi{i}"] - r[f"lo{i}"]) / wide[i] for i in range(len(dims))]
                i = max(range(len(dims)), key=lambda i: widths[i])
                nodes[k] = {"dim": i, "lo": r[f"lo{i}"], "hi": r[f"hi{i}"], "bytes": r["bytes"], "want": r["bytes"] * (leaves[k] // 2) / leaves[k]}
        if not nodes:
            break
        _medians(rows, nodes, dims)
        for k in nodes:
            leaves[2 * k], leaves[2 * k + 1] = leaves[k] // 2, leaves[k] - leaves[k] // 2
            del leaves[k]
        cuts = spark.createDataFrame([(k, n["dim"], n["value"], n["tie"]) for k, n in nodes.items()], "node long, cut_dim int, cut_value long, cut_tie long")
        own = F.element_at(F.array(*dims), F.col("cut_dim") + 1)
        left = (own < F.col("cut_value")) | ((own == F.col("cut_value")) & (F.col("tie") < F.col("cut_tie")))
        rows = rows.join(cuts, "node", "left").withColumn("node", F.when(F.col("cut_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))).drop("cut_dim", "cut_value", "cut_tie")
    path = lambda k: bin(k)[3:]  # noqa: E731  leaves in the order of the tree, left to right
    order = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(leaves, key=path))], "node long, shard int")
    return rows.join(order, "node").drop("node")


def slotted(rows: DataFrame, shards: int, order: list[str], row_hash: str = "tie", rows_a_group: int = 20_000) -> DataFrame:
    """`rows` with a column slot: gapless numbers from 0 in each shard, without gathering a shard in one task.

    Each shard's rows are dealt by row_hash into groups; groups are numbered inside and moved on by the rows of the
    groups before them. `rows` is read three times: a written table.
    """
    groups = max(64, rows.count() // (shards * rows_a_group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(row_hash), F.lit(groups)))
    ends = rows.groupBy("shard", "group").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, -1))
    starts = ends.select("shard", "group", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "group").orderBy(*order))
    return rows.withColumn("slot", inside).join(starts, ["shard", "group"]).withColumn("slot", (F.col("slot") - 1 + F.col("start")).cast("long")).drop("group", "start")


def sharded(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """All documents with shard and slot by a k-d tree over size, language, source and doc_id.

    Size is the UTF-8 bytes of the text plus 1; a null text has none. Texts are read once; the tree is grown on a written
    table of numbers. Null languages and sources count as the lowest value, null doc_ids as -1 (they stay null in the
    result). Repeated rows get slots of their own. law is bytes, so grown_shard is null.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        leading(F.col("lang")).alias("lang"),
        leading(F.col("source")).alias("source"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("tie", F.pmod(F.xxhash64("id", "text_crc32", "row"), F.lit(TIE_RANGE)))
    done = written(partitioned(narrow, ["size", "lang", "source", "id"], shards, target_bytes), "kd-shards")
    out = slotted(done, shards or 16, ["id", "text_crc32", "row"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
