"""Function records on rows whose answer is known."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import records, tokens


def test_records_of_functions(spark):
    functions = spark.createDataFrame([("a", 0.4), ("b", 0.28), ("c", 0.1)], "g string, score double")
    windows = spark.createDataFrame([("a", 0, 10, 0.5, 0), ("a", 1, 11, 0.5, 1), ("a", 2, 12, 0.3, 0), ("b", 0, 20, 0.2, 0), ("x", 0, 30, 0.9, 1)], "g string, window_index int, window_id long, window_prob double, label int")
    got = {r["g"]: r for r in records.assembled(functions, windows, "g").collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["label"], a["window_count"], a["max_window_prob"], a["deployment_tier"], a["precision_tier"], a["agreement"]) == (1, 3, 0.5, "vuln", "confirmed", "agree_positive")
    assert [w["window_index"] for w in a["flagged"]] == [0, 1, 2] and [w["window_id"] for w in a["contributing"]] == [10, 11]
    assert (b["deployment_tier"], b["user_facing_vuln"], b["agreement"]) == ("needs_review", True, "agree_negative")
    assert (c["windows"], c["flagged"], c["max_window_prob"], c["label"]) == ([], [], None, 0)


def test_windows_are_found_in_their_code(spark):
    code = "int f() {\n  a();\n  b();\n}\n"
    rows = spark.createDataFrame([(1, " a();\n  b();"), (2, ""), (3, "  b(); // gone\n}"), (4, "b();\n  zz\n"), (5, "none")], "i int, w string")
    start, end = records.located(F.lit(code), F.col("w"))
    assert [tuple(r) for r in rows.select("i", start, end).orderBy("i").collect()] == [(1, 2, 3), (2, 1, 5), (3, 1, 5), (4, 3, 4), (5, 1, 5)]


def pieces_by_rule(pieces, values, n=5):
    """Words of pieces one after another, then their sums, as the rule says."""
    words, now = [], None
    for p, v in zip(pieces, values, strict=True):
        p = p.strip()
        if not p or p in ("<s>", "</s>", "<pad>", "<unk>", "<mask>") or re.fullmatch(r"\[.+\]", p):
            now = None
        elif p.startswith("##") and now is not None:
            now[0] += p[2:]
            now[1] += v
        else:
            now = [p[2:] if p.startswith("##") else p.removeprefix("Ġ"), v]
            words.append(now)
    sums, first = Counter(), {}
    for w, v in words:
        if w:
            sums[w.lower()] += v
            first.setdefault(w.lower(), w)
    return [(first[k], round(v, 6)) for k, v in sorted(sums.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:n]]


def test_pieces_are_merged_before_they_are_ranked(spark):
    rng = random.Random(4)
    piece = lambda: rng.choice(["a", "A", "##b", "##B", "Ġ", "Ġa", "Ġc", " d ", "", "[SEP]", "[]", "<s>", "<x>", "##", "Ġ##e"])
    rows = [(["[CLS]", "scan", "##f", "Ġx", "y", "[SEP]"], [9.0, 0.5, 0.25, -2.0, 0.1, 9.0]), (["Ab", "aB"], [1.0, 1.0]), ([], []), (["[CLS]"], [1.0])]
    rows += [([piece() for _ in range(n)], [rng.randrange(-40, 40) / 8 for _ in range(n)]) for n in [1, 2, 5, 30] * 20]
    df = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(rows)] + [(-1, None, None)], "id int, p array<string>, v array<double>")
    found: dict[int, list] = {}
    for r in tokens.merged_pieces(df, "id", "p", "v").orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["token"], r["value"]))
    assert found == {i: x for i, (p, v) in enumerate(rows) if (x := pieces_by_rule(p, v))}


def test_pieces_are_merged_without_a_shuffle(spark):
    nan = float("nan")
    rows = [(1, [None, "##a", None, "b"], [9.0, 1.0, 0.5, -0.25]), (2, ["x", "y", "z"], [None, nan, -3.0]), (3, ["x"], [1.0, 2.0]), (4, None, [1.0]), (5, ["x"], None), (6, ["a", "A ", "[b]", "##A"], [1.0, 1.0, 9.0, 1.0])]
    got = tokens.merged_pieces(spark.createDataFrame(rows, "id long, p array<string>, v array<double>"), "id", "p", "v")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["rank"], r["token"], str(r["value"])) for r in got.orderBy("id", "rank").collect()] == [
        (1, 1, "a", "1.5"), (1, 2, "b", "-0.25"), (2, 1, "y", "nan"), (2, 2, "z", "-3.0"), (2, 3, "x", "None"), (3, 1, "x", "3.0"), (6, 1, "a", "3.0"),
    ]
