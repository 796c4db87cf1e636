"""Pieces of code that queries put before the test tables' prose, so that code operators have something to find."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import BLANKS

SNIPPETS = [
    "int copy_name(char *to, const char *from) {\n  strcpy(to, from); /* CWE-120 */\n  return 0;\n}\n",
    "static void fill(struct rec *r) {\n  memcpy(r->buf, r->src, r->len);\n  if (r->len > 4) { r->len = 4; }\n}\n// CWE-125 heartbeat payload_len\n",
    "/* CVE-2021-44228 cwe 78 */\n#include <stdlib.h>\nint run(char *cmd) {\n  return system(cmd);\n}\n",
    "// CVE-2014-0160\nint grow(struct b *p) {\n  p->d = REALLOC(p->d, size + extra);\n  char *q = realloc(p->d, size + extra);\n  return q != 0;\n}\n",
    "void show(const char *msg) {\n  printf(msg);\n  fprintf(stderr, msg);\n}\n\nint twice(int x) { return 2 * x; }\n",
    "int q(sqlite3 *db, const char *id) {\n  char s[99];\n  sprintf(s, \"SELECT * FROM t WHERE id=%s\", id);\n  return sqlite3_exec(db, s, 0, 0, 0);\n}\n",
    "def main():\n    import os\n    return os.name\n",
    "import java.util.List;\npublic class A {\n  int f() { return 1; }\n}\n",
    "fn main() { println!(\"x\"); }\n",
    "int narrow(struct r *a) {\n  int remaining = (int)(a->end - a->at);\n  if (!a->writable)\n    return -1;\n  free(a);\n  *a = zero;\n  return remaining;\n}\n",
    "bool login(char *u) {\n  char *password = \"hunter2\";\n  const char *secret = \"x\";\n  if (strcmp(u, \"admin\") == 0) return true; // auth token bypass login privilege\n  return md5(u) == 0;\n}\n",
    "void open_(char *n) {\n  snprintf(p, sizeof p, \"/srv/%s\", n);\n  fopen(\"../../etc\", \"r\");\n}\ntypedef struct {\n  int a;\n} pair;\n",
    "namespace x {\nclass Y {\n public:\n  int z() const { return z_; }\n};\n}\n",
    "",
    "race condition toctou dirty cow writable without lock concurrent madvise\n",
    "integer overflow signed unsigned wrap; chunk_len > (size_t) 3;\n",
    "int a; /* open\nint b; // kept */ int c; // gone\n\n\n\nchar *u = \"http://x\"; /* x */ /* y */\nint d;   \n",
]
PATHS = ["a.c", "src/b.cpp", None, "C.H", "x.java", "noext", "d.hpp", "e.inl", "dir.c/f.py"]


def _literal(x: str | None) -> str:
    if x is None:
        return "NULL"
    return "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in BLANKS)
PATH_SQL = f"[{', '.join(map(_literal, PATHS))}][doc_id % {len(PATHS)} + 1]"
CODE_SQL = f"([{', '.join(map(_literal, SNIPPETS))}][doc_id % {len(SNIPPETS)} + 1] || coalesce(text, ''))"


def code(doc_id: Column, text: Column) -> Column:
    """A snippet before the whole text of every row."""
    own = F.element_at(F.array(*map(F.lit, SNIPPETS)), (doc_id % len(SNIPPETS) + 1).cast("int"))
    return F.concat(own, F.coalesce(text, F.lit("")))


def path(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PATHS)), (doc_id % len(PATHS) + 1).cast("int"))
