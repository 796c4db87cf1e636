"""First-wins duplicates against the rule applied row by row; the same over batches."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from quarry.operators import duplicates
from quarry.streaming import ingest, near_index


def shingles(text: str) -> set:
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(x: str, y: str) -> bool:
    a, b = shingles(x), shingles(y)
    return bool(a and b) and len(a & b) >= 0.85 * len(a | b)


def first_wins(rows):
    kept, out = [], {}
    for i, t in sorted(rows):
        if not (t or "").strip():
            out[i] = "kept"
        elif any(t == u for _, u in kept):
            out[i] = "exact"
        elif any(near(t, u) for _, u in kept):
            out[i] = "near"
        else:
            out[i] = "kept"
            kept.append((i, t))
    return out


def texts(seed: int):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 30, 80, 120]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.6 else base
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " \n", None]))


def marked(df):
    first = duplicates.first_of_equal(df, "code", [df["at_"]])
    gone = {r["at"] for r in duplicates.near_dropped(first.filter("keep"), "code", "at_").collect()}
    return {r["at_"]: "near" if r["first"] in gone else "kept" if r["keep"] else "exact" for r in first.collect()}


def test_first_wins_is_row_by_row(spark):
    rows = texts(1)
    expected = first_wins(rows)
    assert set(expected.values()) == {"kept", "exact", "near"}
    assert marked(spark.createDataFrame(rows, "at_ long, code string")) == expected
    assert duplicates.near_dropped(spark.createDataFrame([], "at_ long, code string"), "code", "at_").count() == 0


def test_pairs_settle_what_rounds_leave(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "ROUNDS", 1)
    rows = texts(2)
    assert marked(spark.createDataFrame(rows, "at_ long, code string")) == first_wins(rows)


def test_chain_keeps_its_ends(spark):
    base = [f"w{i}" for i in range(100)]
    b, c = list(base), list(base)
    b[10] = c[10] = "x"
    c[50] = "y"
    rows = [(1, " ".join(base)), (2, " ".join(b)), (3, " ".join(c))]
    assert near(rows[0][1], rows[1][1]) and near(rows[1][1], rows[2][1]) and not near(rows[0][1], rows[2][1])
    assert marked(spark.createDataFrame(rows, "at_ long, code string")) == {1: "kept", 2: "near", 3: "kept"}


def test_earlier_near_rows_are_counted(spark):
    rows = [(i, t) for i, t in texts(3) if t and t.strip()]
    firsts = {}
    for i, t in rows:
        firsts.setdefault(t, i)
    expected = {i for t, i in firsts.items() if any(near(t, u) for u, j in firsts.items() if j < i)}
    got = {r["at"] for r in duplicates.near_matched(spark.createDataFrame(rows, "at_ long, code string"), "code", "at_").collect()}
    assert got == expected


def test_batches_go_on_from_what_was_kept(spark):
    rows = texts(4)
    kept = spark.createDataFrame([], "at_ long, code string")
    for part in (rows[:40], rows[40:]):
        new = ingest.near_new(spark.createDataFrame(part, "at_ long, code string"), kept, "code", "at_").collect()
        kept = kept.unionByName(spark.createDataFrame([tuple(r) for r in new], "at_ long, code string"))
    assert {r["at_"] for r in kept.collect()} == {i for i, v in first_wins(rows).items() if v == "kept"}


def test_an_index_over_batches_is_row_by_row(spark, tmp_path):
    """Batches, some of them repeated and one broken off before its line in the log, give what one pass gives."""
    rows = texts(5)
    schema = "at_ long, code string"
    found, place = {}, str(tmp_path / "index")
    for k in range(5):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20] if k < 4 else rows[80:], schema)
        index = near_index.NearIndex(spark, place, 8)
        if k == 2:  # a batch that wrote its rows and was lost before it ended
            index._add("digests", spark.createDataFrame([(b"x" * 20,)], "digest binary"), "digest", k)
            index._add("bands", spark.createDataFrame([(i, 0) for i in range(50)], "band long, at long"), "band", k)
        once = {r["at_"]: r["reason"] for r in index.absorb(part, k, "code", "at_").collect()}
        if k == 3:
            assert {r["at_"]: r["reason"] for r in near_index.NearIndex(spark, place).absorb(part, k, "code", "at_").collect()} == once
        found |= once
    assert found == first_wins(rows)
    assert near_index.NearIndex(spark, place).buckets == 8
    assert near_index.NearIndex(spark, place).absorb(spark.createDataFrame([], schema), 5, "code", "at_").count() == 0


def test_a_batch_reads_the_buckets_that_it_meets(spark, tmp_path):
    index = near_index.NearIndex(spark, str(tmp_path / "index"), 16)
    index.absorb(spark.createDataFrame([(i, f"text number {i} of many others {i * 7}") for i in range(200)], "at_ long, code string"), 0, "code", "at_").count()
    plan = index.before("digests", 1, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < index.before("digests", 1, [3]).count() < 60 and index.before("digests", 1).count() == 200


def test_marks_never_rule_out_a_near_pair(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t) for i, t in texts(6) if (t or "").strip()], "at long, code string")
    sets = duplicates.with_shingles(rows, "code").select("at", "code", "shingles")
    full = sets.join(duplicates.banded(sets, "at", "shingles"), "at").collect()
    ruled = 0
    data = [(x["n"], x["mark"], y["n"], y["mark"], near(x["code"], y["code"])) for x in full for y in full if x["at"] < y["at"]]
    for r in spark.createDataFrame(data, "n int, x array<long>, m int, y array<long>, near boolean").withColumn("may", duplicates.may_be_near(F.col("n"), F.col("x"), F.col("m"), F.col("y"))).collect():
        assert r["may"] or not r["near"]
        ruled += not r["may"]
    assert ruled > len(data) / 2


def test_only_sets_that_pairs_ask_for_are_shuffled(spark):
    """Sets that no pair needs are left out before the joins, by a table of bounded size that goes to all tasks, even where joins may not broadcast."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)] + [(40, " ".join(f"w3x{k}" for k in range(30)) + " more")]
    made = duplicates.banded(duplicates.with_shingles(spark.createDataFrame(texts, "at long, code string"), "code"), "at", "shingles", "shingles")
    sets = duplicates._written(made.drop("bands"), "sets")
    pairs = spark.createDataFrame([(3, 40), (1, 2), (5, 40)], "a long, b long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = duplicates.near_pairs(pairs, sets, sets, sets, sets)
        assert [tuple(r) for r in near.collect()] == [(3, 40)]
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert plan.count("LeftSemi, BuildRight") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert duplicates._needed(sets, pairs.select(F.col("a").alias("at"))).count() == 3


def test_stream_dedup_deals_large_inputs_over_more_files(spark, sf, monkeypatch):
    """As many files as the input has splits, where that is more than five."""
    from quarry.plans import dedup

    dealt = []
    monkeypatch.setattr(ingest, "chunks", lambda spark, path, schema, files=2, own=ingest.chunks: (dealt.append((len(spark.read.parquet(path).inputFiles()), files)), own(spark, path, schema, files))[1])
    monkeypatch.setattr(ingest, "run_to_end", lambda rows, path, checkpoint: os.makedirs(path))
    for bytes_, least in (("128m", 5), ("16k", 6)):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        try:
            dedup.stream_dedup(spark, sf)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert dealt[-1][0] >= least and dealt[-1][1] * 2.5 >= dealt[-1][0]
    assert dealt[0][0] == 5
