"""Code operators on files whose answer is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import code, signatures

SOURCE = """#include <x.h>
/* CWE-125 */
int add(int a, int b) {
  if (a) { return b; }
#ifdef X
  return a;
#endif
  return a + b;
}

typedef struct {
  int a;
} pair;

extern "C" {
static void
real_fn(void)
{
  for (;;) { }
}
}
struct point { int x; };
if (x) { y(); }
int broken(void) {
"""


def test_functions_are_cut_out_by_braces():
    assert [(n, a, b) for n, _, a, b in code.functions(SOURCE)] == [("add", 3, 9), ("function_2", 16, 20)]
    body = code.functions(SOURCE)[0][1]
    assert "#ifdef" not in body and body.startswith("int add") and body.endswith("}")
    assert code.functions("#include <a.h>\n#include <b.h>\n") == []
    assert [n for n, *_ in code.functions("struct s { int a; };\nint add(int a) { return a; }\n")] == ["add"]
    assert code.functions("if (a) { b(); }\nwhile (c) { d(); }\nfor (;;) { e(); }\n") == []
    assert code.functions("") == []
    assert [n for n, *_ in code.functions("static void /* (x) */\nf(int a)\n{\n  a++;\n}\n")] == ["function_1"]
    assert [n for n, *_ in code.functions("int /* (x) */ g(int a)\n{\n  a++;\n}\n")] == ["g"]


def test_comments_go_line_by_line():
    text = "int a; /* open // still\nb */ int c; // gone\n\n/* one */ /* two */\nchar *u = \"http://x\";\nint d;   \n// /* not opened\nint e;"
    assert code.kept_lines(text) == [(1, "int a;"), (2, " int c;"), (5, 'char *u = "http:'), (6, "int d;"), (8, "int e;")]
    assert code.kept_lines("/* never closed\nint a;") == []


def test_functions_of_null_and_empty_tables(spark):
    df = spark.createDataFrame([("a", SOURCE), ("b", None), ("c", "")], "name string, code string")
    got = code.extracted(df, "name", "code").collect()
    assert [r["function_id"] for r in got] == ["a_fn1", "a_fn2"]
    assert code.extracted(df.limit(0), "name", "code").count() == 0
    kept = {r["name"]: r["line_map"] for r in code.without_comments_by_line(df, "name", "code").collect()}
    assert kept["b"] == kept["c"] == [] and kept["a"][0] == 1


def test_signatures_of_whole_files(spark):
    rows = [
        (1, "void f(void) {\n  gets(line);\n}", "buffer_overflow_unsafe_copy"),
        (2, "int g(char *c) {\n  return SYSTEM(c);\n}", "command_injection"),
        (3, "/* CVE-2014-0160 CWE-125 */ int f(void);", "out_of_bounds_read"),
        (4, "/* CVE-2021-1234 CWE-125 */ int f(void);", None),
        (5, "free(p);\n\n  x = *\n p;", "use_after_free"),
        (6, "", None),
        (7, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, code string, expected string")
    for r in signatures.with_hits(df, "code", hits="h").collect():
        assert (max(r["h"], key=lambda h: h["confidence"])["rule_id"] if r["h"] else None) == r["expected"], r
    cwes, cves = T.comment_hints(F.lit("cwe 79, CWE-0079 CVE 2018-12345 CWE_1"))
    assert tuple(spark.range(1).select(cwes, cves).first()) == (["CWE-79"], ["CVE-2018-12345"])


def test_texts_are_scanned_once_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.createDataFrame([(1, "gets(line);"), (2, "no hit"), (3, None)], "id long, code string")
    got = signatures.each_hit(signatures.with_hits(df, "code"), "id").select("id", "place", "h.rule_id")
    assert [tuple(r) for r in got.collect()] == [(1, 0, "buffer_overflow_unsafe_copy")]
    best = signatures.attributed(df, "id", "code", df.select("id", F.lit(True).alias("flagged")))
    for x in (got, best):
        assert x._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_lines_are_cleaned_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(1200, numPartitions=1).select("id", F.concat(F.lit("a; // b\n\nc"), F.col("id").cast("string")).alias("code"))
    kept = code.without_comments_by_line(df, "id", "code")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert {(r["id"], r["code"], tuple(r["line_map"])) for r in kept.collect()} == {(i, f"a;\nc{i}", (1, 3)) for i in range(1200)}
