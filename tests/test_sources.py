"""Readers on files whose content is known."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from quarry.sources import bundles, csv_splits, datasource, readers, writers


def test_dump_fields():
    assert readers.dump_fields("a\tb") == ["a", "b"]
    assert readers.dump_fields("") == [""]
    assert readers.dump_fields("a\t") == ["a", ""]
    assert readers.dump_fields("\\N\tx\\ty\\nz\\\\\t") == [None, "x\ty\nz\\", ""]
    assert readers.dump_fields("x\\\ty\t\\\\N") == ["x\ty", "\\N"]


def test_dump_rows(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("SET x;\nCOPY public.a (id, v) FROM stdin;\n1\tx\\ty\n2\t\\N\nbad\n\\.\n\nCOPY public.b (id) FROM stdin;\n7\n\\.\n")
    assert [tuple(r) for r in readers.dump_rows(spark, str(path), "a").collect()] == [("1", "x\ty"), ("2", None)]
    assert [tuple(r) for r in readers.dump_rows(spark, str(path), "b").collect()] == [("7",)]


def test_patch_files(spark, tmp_path):
    patch = "diff --git a/x.c b/src/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1,4 +1,1 @@\n-int a = 1;\n-int b = 2;\n-int c = 3;\n+int d;\n-only one\n same\n-a\n-b\n-c\ndiff --git a/y.py b/y.py\n-int a = 1;\n-int b = 2;\n-int c = 3;\n"
    (tmp_path / "abc.patch").write_text(patch)
    (tmp_path / "empty.patch").write_text("")
    got = [tuple(r) for r in readers.patch_snippets(spark, str(tmp_path)).collect()]
    assert got == [("abc", "src/x.c", 0, "int a = 1;\nint b = 2;\nint c = 3;")]


def test_json_lines_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n  \n{"x": 2, "split": "test"}\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x long, split string", "train").collect()
    assert sorted(tuple(r) for r in got) == [(1, "train"), (2, "test")]
    (tmp_path / "b.txt").write_bytes(b"ok\nb\xffd\n")
    assert [r["line"] for r in readers.text_lines(spark, str(tmp_path / "b.txt")).collect()] == ["ok", "b\ufffdd"]


def test_dump_in_numbered_files(spark, tmp_path):
    """A table that several tasks write, as one table over several files, beside others; no task writes all of it."""
    said = lambda *lines: spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    body = lambda n: spark.range(0, n, 1, 5).selectExpr(f"concat(id, '\\tv', id + {n}) AS line")
    path = str(tmp_path / "dump.sql")
    writers.in_order(spark, [p for n, t in ((40, "a"), (70, "b"), (20, "c")) for p in (said(f"COPY public.{t} (id, v) FROM stdin;"), body(n), said("\\.", ""))], path)
    assert len(list((tmp_path / "dump.sql").glob("*.txt"))) == 3 * 7
    for n, t in ((40, "a"), (70, "b"), (20, "c")):
        assert sorted((int(r["id"]), r["v"]) for r in readers.dump_rows(spark, path, t).collect()) == [(i, f"v{i + n}") for i in range(n)]


def test_small_ranges_share_tasks_and_read_little_more_than_themselves(spark, tmp_path, monkeypatch):
    """A folder of files that stands for one, in ranges of 5,000 bytes: each line once, in 512 tasks at most, and the files read a few times over at most (8 MB a range before)."""
    (tmp_path / "x.jsonl").mkdir()
    lines = [f'{{"n": {i}, "t": "{"y" * (i * 7 % 900 if i % 500 else 300_000)}"}}' for i in range(2000)]
    for k in range(2):
        (tmp_path / "x.jsonl" / f"part-{k}.json").write_text("\n".join(lines[k::2]) + "\n" * k)
    (tmp_path / "x.jsonl" / "_SUCCESS").write_text("")
    read = []

    class File:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            read.append(len(got := self.file.read(n)))
            return got

    class System:
        def __init__(self, system):
            self.get_file_info, self.open_input_file = system.get_file_info, lambda path: File(system.open_input_file(path))

    own = datasource.opened
    monkeypatch.setattr(datasource, "opened", lambda path: (System(own(path)[0]), own(path)[1]))
    schema = spark.createDataFrame([], "n long, t string").schema
    reader = datasource.JsonLinesReader(schema, {"path": str(tmp_path), "fallback": "x.jsonl", "part_bytes": "5000"})
    parts = reader.partitions()
    assert len(parts) <= datasource.TASKS
    got = sorted(r["n"] for p in parts for b in reader.read(p) for r in b.to_pylist())
    assert got == list(range(2000))
    n_ranges = sum(len(p.ranges) for p in parts)
    assert sum(read) < n_ranges * (5000 + 2 * datasource.BEYOND) + 4 * 4 * 300_000


def test_shards_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string")
    writers.chunks(rows, str(tmp_path), "part", 12, "id", 1_000)
    back = readers.chunks(spark, str(tmp_path), "part")
    assert sorted(r["id"] for r in back.collect()) == list(range(50))
    assert [r["chunk"] for r in back.select("chunk").distinct().orderBy("chunk").collect()] == sorted({r["chunk"] for r in back.collect()})
    rows.write.parquet(str(tmp_path / "train_windowed.parquet"))
    shard = readers.shard(spark, str(tmp_path), "train", ["id", "missing"])
    assert shard.columns == ["id", "missing"] and shard.filter("missing IS NULL").count() == 50


def awkward_csv(seed: int) -> str:
    """Records with breaks, doubled quotes, commas and blank lines in values, some longer than many splits."""
    rng = random.Random(seed)
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    value = lambda: "".join(rng.choice(['"', '""', "\n", "\r\n", ",", "a", "é", "😀", "word ", "\n\n", '"\n"']) for _ in range(rng.choice([0, 1, 3, 10, 60])))
    out = ['id,text,"na\nme"']
    for i in range(900):
        text = value() if i % 90 else "x\n" * 4000 + '"' * 3
        out.append(f"{i},{quoted(text)},{rng.choice([quoted(value()), 'plain', '', quoted('')])}")
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", ["700b", "5k", "64m"])
def test_quoted_csv_is_read_in_splits(spark, tmp_path, size):
    """Equal to the reader that takes a file as one task, however its splits fall; two files, each with its header."""
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(awkward_csv(k).encode())
    schema = "id int, text string, name string"
    expected = spark.read.schema(schema).csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        n = csv_splits._lines(spark, str(tmp_path)).rdd.getNumPartitions()
        got = Counter(map(tuple, csv_splits.csv_rows(spark, str(tmp_path), schema).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert n > 50 or size == "64m"
    assert got == Counter(map(tuple, expected.collect())) and sum(got.values()) == 1800


def test_csv_without_an_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny\n2,z\n')
    assert [r["value"] for r in csv_splits.records(spark, str(tmp_path)).filter("not head").collect()] == ['1,"x\ny\n2,z']
    (tmp_path / "a.csv").write_text("")
    assert csv_splits.csv_rows(spark, str(tmp_path), "a int").count() == 0


def test_a_bundle_is_read_when_it_is_complete(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i int, t string, v array<double>")
    b = bundles.Bundle(spark, str(tmp_path / "b"))
    b.add("x", rows, "json").add("y", rows.limit(0), by=("i",))
    with pytest.raises(ValueError, match="not complete"):
        b.read("x")
    b.add("x", rows, "json").close()
    again = bundles.Bundle(spark, str(tmp_path / "b"))
    assert {(r["name"], r["n_rows"]) for r in again.manifest().collect()} == {("x", 2), ("y", 0)}
    assert Counter(map(str, again.read("x").collect())) == Counter(map(str, rows.collect())) and again.read("y").count() == 0
    with pytest.raises(ValueError, match="is complete"):
        again.add("z", rows)
    with pytest.raises(KeyError):
        again.read("z")
