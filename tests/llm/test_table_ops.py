"""Archives, shards, the classifier and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import byte_bpe, decontaminate, kd_shards, ngram_join, registry, rule_ensemble, warc
from quarry.llm.common import table_path
from tests.llm.conftest import frame


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("payload", "digest", "size", "owner", "record_id", "block")})


def archived(spark, df, **conf):
    path = table_path(spark, "test-warc")
    warc.write_archives(df, path, **conf)
    return warc.resolved(warc.read_archives(spark, path).cache())


def digest(html) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_hold_all_pages(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["é", "😀", "\r\n", "0\r\n\r\n", "WARC/1.1\r\n", "x"]) for _ in range(30_000))
    rows = [(5, "http://a/b c", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://é", None), (7, "u", ""), (1, "u", long), (2, "u", long + "!"), (4, "v", long), (6, "w", "a" * 4096), (8, "w", "a" * 16384)]
    out = archived(spark, pages(spark, rows), segment_bytes=5000, chunk_bytes=777)
    owner = {}
    for i, _, html in rows:
        owner[html or ""] = min(i, owner.get(html or "", i))
    expected = Counter((i, len((h or "").encode()), digest(h), "response" if owner[h or ""] == i else "revisit", None if owner[h or ""] == i else owner[h or ""], True) for i, _, h in rows)
    assert Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete").collect()) == expected


def test_archives_of_awkward_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, None, "same"), (None, "u", "same"), (None, None, None), (None, None, None)]
    out = archived(spark, pages(spark, rows)).collect()
    assert Counter(r["page_id"] for r in out) == Counter(r[0] for r in rows)
    assert all(r["complete"] for r in out)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None)}
    assert archived(spark, pages(spark, rows).limit(0)).count() == 0


def test_large_payloads_only_may_be_the_least_for_revisits(spark):
    out = archived(spark, pages(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_revisit_bytes=4)
    assert {(r["page_id"], r["record_type"]) for r in out.collect()} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def segment(n, block, total=None):
    whole = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 50, 60)
    return {"record_id": "r", "record_type": "response" if n == 1 else "continuation", "page_id": 1, "refers_to": None, "declared_digest": digest("payload" * 50), "segment": n, "total_length": total, "block": whole[block]}, len(whole)


def test_segments_are_ordered_and_verified():
    parts = [slice(0, 100), slice(100, 200), slice(200, None)]
    whole = segment(1, slice(None))[1]
    good = [segment(i, p, whole if i == 3 else None)[0] for i, p in enumerate(parts, 1)]
    assert [(r["complete"], r["payload_bytes"]) for r in warc.reassembled(good[::-1])] == [(True, 350)]
    assert [r["complete"] for r in warc.reassembled(good * 2)] == [True, True]
    for bad in (good[:2], good[1:], [good[0], good[2]], [*good[:2], good[2] | {"total_length": whole + 1}], [*good, good[1] | {"block": b"other"}]):
        assert [(r["complete"], r["payload_bytes"]) for r in warc.reassembled(bad)] == [(False, None)]
    assert [r["complete"] for r in warc.reassembled([r | {"declared_digest": "A" * 32} for r in good])] == [False]


def test_broken_framing():
    for body in (b"", b"5\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(body)
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_warc_sql(spark, sf):
    out = registry.queries()["op1_warc"](spark, sf)
    columns = out.columns
    expected = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({warc.SQL.replace('FROM pages', f"FROM '{sf}/pages.parquet'")})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(expected)


def test_shards_are_near_equal_and_slots_gapless(spark, awkward, nothing):
    rng = random.Random(4)
    rows = [(i, "z" * rng.choice([1, 50, 400]) if i % 3 else "hot text " * 9) for i in range(2000)]
    out = kd_shards.sharded(frame(spark, rows), 16).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
        text = dict(rows)[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    assert sorted(by) == list(range(16)) and len(out) == 2000
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    some = kd_shards.sharded(awkward[1], None, target_bytes=40_000).collect()
    assert Counter(r["doc_id"] for r in some) == Counter(r[0] for r in awkward[0])
    assert len({r["shard"] for r in some}) == -(-sum(len((t or "").encode()) + 1 for _, t in awkward[0]) // 40_000)
    assert kd_shards.sharded(nothing, 16).count() == 0


def kd_by_force(rows, dims, shards):
    """A plain k-d tree over rows (size, tie, *dims): shard of each row, split at the weighted median of the widest dimension."""
    whole = [max(1, max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) for d in range(dims)]
    out = {}

    def split(part, leaves, first):
        if leaves == 1 or not part:
            for r in part:
                out[r] = first
            return
        widths = [(max(r[2 + d] for r in part) - min(r[2 + d] for r in part)) / whole[d] for d in range(dims)]
        d = widths.index(max(widths))
        half = leaves // 2
        want, below, cut = sum(r[0] for r in part) * half / leaves, 0, None
        for key in sorted({(r[2 + d], r[1]) for r in part}):
            got = sum(r[0] for r in part if (r[2 + d], r[1]) == key)
            if below + got >= want:
                cut = (key[0], key[1] + (not want - below < below + got - want))
                break
            below += got
        split([r for r in part if (r[2 + d], r[1]) < cut], half, first)
        split([r for r in part if (r[2 + d], r[1]) >= cut], leaves - half, first + half)

    split(rows, shards, 0)
    return out


@pytest.mark.parametrize(("seed", "shards"), [(1, 16), (2, 7), (3, 2)])
def test_shards_are_those_of_a_plain_tree(spark, seed, shards):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 3, 20, 60]), rng.randrange(2**31), rng.choice([0, 0, 0, 7, rng.randrange(1000)]), rng.choice([5, 5, 10**12]), rng.randrange(50)) for _ in range(120)]
    rows += [(9, rng.randrange(2**31), 0, 5, 3) for _ in range(60)]  # a third of all rows have the same values
    df = spark.createDataFrame(rows, "size long, tie long, a long, b long, c long")
    got = {tuple(r)[:5]: r["shard"] for r in kd_shards.partitioned(df, ["a", "b", "c"], shards).collect()}
    assert got == kd_by_force(rows, 3, shards)


def plain_statistics(text):
    t = text or ""
    n, words = max(1, len(t)), [w for w in re.split("[ \t\r\n\x0b\x0c]", t) if w]
    share = lambda chars: sum(c in chars for c in t) / n
    return {
        "log_chars": math.log1p(len(t)), "word_length": len(t) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "marks": share(rule_ensemble._MARKS),
        "bars": share("|"), "calls": share("!?"), "stops": share(".,;:"), "digits": share("0123456789"), "lines": share("\n"),
    }


def test_compiled_score_is_the_formula(spark, awkward):
    rows = [*awkward[0], (77, "A! " * 60_000), (78, "x" * 500_000), (79, "| a | 12 |\n" * 40)]
    rules = [((("log_chars", True, 5.0),), 1.25), ((("upper", False, 0.01), ("marks", True, 0.2)), -2.5), ((("word_length", True, 6.0), ("word_length", False, 1.5)), 0.75), ((("digits", False, 0.0), ("stops", True, 0.4), ("distinct_words", False, 0.05)), 3.0), ((("lines", True, 0.0), ("bars", True, 0.0), ("calls", False, 0.1)), -1.0)]
    model = rule_ensemble.RuleEnsemble(-0.5, [(rule_ensemble.Rule(b), w) for b, w in rules])

    def expected(text):
        x = plain_statistics(text)
        return 1 / (1 + math.exp(0.5 - sum(w for b, w in rules if all(x[n] <= v if upper else x[n] > v for n, upper, v in b))))

    df = frame(spark, rows).withColumn("dotted.name", F.lit(1))
    got = Counter((r["doc_id"], round(r["score_"], 9)) for r in model.scored(df, score_col="score_").collect())
    assert got == Counter((i, round(expected(t), 9)) for i, t in rows)
    assert rule_ensemble.kept(df, spark.createDataFrame([], "doc_id long, quality int")).columns == df.columns


def test_rules_are_the_ways_through_a_tree():
    debug = "  If (feature 0 <= 1.5)\n   If (feature 3 > 2.0E-4)\n    Predict: 0.0\n   Else (feature 3 <= 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, b = (0, True, 1.5), (3, False, 2e-4)
    assert rule_ensemble.paths(debug) == [(a,), (a, b), (a, (3, True, 2e-4)), ((0, False, 1.5),)]
    assert rule_ensemble.simplified((a, b, (0, True, 1.0))).bounds == (("log_chars", True, 1.0), ("upper", False, 2e-4))


def test_classifier_learns_without_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.fit(docs, labels)
    assert model.rules
    turned = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(docs, turned) == model
    rows = model.scored(docs.select("doc_id", "text")).join(labels, "doc_id").filter(rule_ensemble.held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_classifier_on_awkward_rows(spark, awkward, nothing):
    rows, df = awkward
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 0, 0), (6, None, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = rule_ensemble.fit(df, labels).scored(df.select("doc_id", "text")).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    kept = rule_ensemble.kept(df, none)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert rule_ensemble.kept(nothing, odd).count() == 0


@pytest.mark.parametrize(("good", "bad"), [(60, 8), (20_000, 10)])
def test_classifier_rejects_with_few_bad_labels(spark, good, bad):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "old", "stones", "again."]) for _ in range(rng.randrange(20, 60)))
    junk = lambda: "".join(rng.choice("$#|<>{}=% X9") for _ in range(rng.randrange(100, 300)))
    ids = [i for i in range(2 * (good + bad)) if zlib.crc32(str(i).encode()) % 5]
    texts = [(i, junk() if k < bad else plain()) for k, i in enumerate(ids[: good + bad])]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(k >= bad)) for k, (i, _) in enumerate(texts)], "doc_id long, quality int")
    got = {r["doc_id"] for r in rule_ensemble.fit(docs, labels, max_labelled=2_000).scored(docs).filter(F.col("score") < rule_ensemble.THRESHOLD).select("doc_id").collect()}
    assert got == {i for i, _ in texts[:bad]}


def test_fit_uses_all_rows_of_the_rarer_label():
    assert rule_ensemble.fractions({0.0: 500, 1.0: 999_500}, 20_000) == {0.0: 1.0, 1.0: pytest.approx(19_500 / 999_500, abs=2e-6)}
    assert rule_ensemble.fractions({0.0: 40_000, 1.0: 40_000}, 20_000) == {0.0: pytest.approx(0.25, abs=2e-6), 1.0: pytest.approx(0.25, abs=2e-6)}
    assert rule_ensemble.fractions({0.0: 8, 1.0: 60}, 20_000) == {0.0: 1.0, 1.0: 1.0}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns
        after = after.cache()
        kept[name] = after
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = after
    n = {k: v.count() for k, v in kept.items()}
    assert docs.count() > n["quality"] > n["near_duplicates"] > n["decontamination"] == n["personal_data"] > 0
    comps = ngram_join.linked(kept["quality"]).select("component_id").distinct().count()
    assert comps == n["near_duplicates"] == kept["near_duplicates"].join(ngram_join.linked(kept["near_duplicates"]), "doc_id").filter("doc_id = component_id").count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contaminated(kept["decontamination"], bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == Counter(tuple(r) for r in last.collect()) == Counter(tuple(r) for r in byte_bpe.encoded(before).collect())


def test_every_query_is_registered():
    names = registry.queries()
    assert sorted(int(k.split("_")[0][2:]) for k in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
