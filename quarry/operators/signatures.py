"""Weakness signatures: a catalogue of rules as data, matched against code in layers, merged over segments, crossed with a detector's flags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.functions.text import comment_hints
from quarry.session import small_batches

#: Confidences of the layers, and what counts.
CONTEXTUAL, STRUCTURAL, KNOWN = 0.88, 0.92, 0.45
SHARE, SHARE_BASE, SHARE_STEP, SHARE_MOST = 0.38, 0.45, 0.5, 0.85
NEAR, NEAR_BASE, NEAR_STEP, NEAR_MOST = 0.72, 0.55, 0.35, 0.9


@dataclass(frozen=True)
class Rule:
    """Literals (looked for in lower-cased code), regular patterns (any case, over lines), keywords, and literals of which one must occur besides."""

    rule_id: str
    cwe: str
    patterns: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()


#: The catalogue.
CATALOGUE = (
    Rule("buffer_overflow_unsafe_copy", "CWE-120", ("strcpy", "strcat", "gets(", "sprintf(", "vsprintf(", "wcscpy", "wcscat"), (), ("strcpy", "strcat", "gets", "buffer overflow", "bounds check", "unchecked copy")),
    Rule("buffer_overflow_memcpy", "CWE-787", ("memcpy(", "memmove("), (r"memcpy\s*\([^,]+,\s*[^,]+,\s*[^)]+\)", r"memmove\s*\([^,]+,\s*[^,]+,\s*[^)]+\)"), ("memcpy", "memmove", "payload_len", "unchecked length", "heap overflow", "out-of-bounds write")),
    Rule("out_of_bounds_read", "CWE-125", ("memcpy(",), (r"memcpy\s*\(\s*\w+\s*,\s*\w+->\w+\s*,\s*\w+->\w+\s*\)", r"memcpy\s*\([^,]+,\s*[^,]+,\s*\w+->\w+\s*\)"), ("out-of-bounds read", "heartbeat", "payload_len", "memcpy", "information disclosure", "heartbleed")),
    Rule("integer_overflow", "CWE-190", (), (r"\(int\)\s*\(\s*\w+->\w+\s*-\s*\w+->\w+\s*\)", r"\(int\)\s*\(\s*\w+\.\w+\s*-\s*\w+\.\w+\s*\)", r"chunk_len\s*>\s*\(size_t\)", r"remaining\s*=\s*\(int\)"), ("integer overflow", "signed", "unsigned", "size_t", "wrap", "chunk_len", "remaining")),
    Rule("heap_overflow", "CWE-122", ("realloc(", "malloc("), (r"realloc\s*\([^,]+,\s*\w+\s*\+\s*\w+\s*\)",), ("heap overflow", "realloc", "malloc", "chunk")),
    Rule("format_string", "CWE-134", ("printf(", "fprintf(", "sprintf(", "snprintf("), (r"printf\s*\(\s*\w+\s*\)", r"fprintf\s*\([^,]+,\s*\w+\s*\)"), ("format string", "printf", "user-controlled format")),
    Rule("sql_injection", "CWE-89", ("sqlite3_exec", "mysql_query", "pqexec", "select ", "insert ", "update ", "delete "), (), ("sql injection", "query", "concat", "sqlite", "mysql"), ("sqlite", "mysql", "pqexec", "query", "execute", "odbc")),
    Rule("command_injection", "CWE-78", ("system(", "popen(", "execl(", "execv(", "execve("), (r"system\s*\(\s*\w+\s*[\+\)]", r"system\s*\(\s*tail\s*\+\s*1\s*\)"), ("command injection", "system", "popen", "shell", "shellshock", "environment")),
    Rule("path_traversal", "CWE-22", ("snprintf(", "sprintf(", "strcat("), (r'snprintf\s*\([^,]+,\s*[^,]+,\s*"[^"]*%s[^"]*"\s*,\s*\w+\s*\)', r"\.\./", r"/\.\./"), ("path traversal", "directory traversal", "pipename", "../", "dlopen", "absolute path")),
    Rule("race_condition_toctou", "CWE-362", (), (r"if\s*\(\s*!\s*\w+->writable\s*\)", r"if\s*\(\s*!\s*\w+\.writable\s*\)"), ("race condition", "toctou", "dirty cow", "writable", "without lock", "concurrent", "madvise")),
    Rule("use_after_free", "CWE-416", ("free(",), (r"free\s*\(\s*\w+\s*\)\s*;[\s\S]{0,120}\*\s*\w+",), ("use after free", "double free", "freed pointer")),
    Rule("hardcoded_credentials", "CWE-798", ('password = "', 'passwd = "', 'api_key = "', 'apikey = "', 'secret = "'), (), ("hardcoded", "password", "api_key", "secret", "credential")),
    Rule("crypto_weak", "CWE-327", ("md5(", "sha1(", "des_", "rc4"), (), ("weak crypto", "md5", "sha1", "deprecated cipher")),
    Rule("auth_bypass", "CWE-287", ("strcmp(", "admin"), (), ("auth bypass", "authentication", "privilege", "admin", "bypass login"), ("password", "token", "auth")),
)
#: What the rules are called.
NAMES = {
    "buffer_overflow_unsafe_copy": "Buffer overflow (unsafe copy)", "buffer_overflow_memcpy": "Buffer overflow (memcpy / memmove)", "out_of_bounds_read": "Out-of-bounds read", "integer_overflow": "Integer overflow / signedness confusion",
    "heap_overflow": "Heap-based buffer overflow", "format_string": "Format string vulnerability", "sql_injection": "SQL injection", "command_injection": "OS command injection", "path_traversal": "Path traversal",
    "race_condition_toctou": "Race condition (TOCTOU)", "use_after_free": "Use after free", "hardcoded_credentials": "Hard-coded credentials", "crypto_weak": "Weak cryptography", "auth_bypass": "Authentication bypass",
}
#: What a hit by a comment or by keywords says that it matched.
COMMENT, KEYWORDS = "comment_cwe", "keywords:"
#: Without these there are no hints in comments.
HINTS = ("cwe", "cve")
HITS = "array<struct<confidence:double,layer:string,rule:int,rule_id:string,cwe:string,matched_on:string>>"


def rules_of(rows: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (rule_id, cwe, and arrays patterns, regexes, keywords, require_any, which may be null), in the order of rule_id; a catalogue is a few hundred rows at most."""
    lists = ("patterns", "regexes", "keywords", "require_any")
    got = rows.select("rule_id", "cwe", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists]).orderBy("rule_id").limit(10_001).collect()
    if len(got) > 10_000:
        raise ValueError("more than 10,000 rules: match them by a join")
    return tuple(Rule(r["rule_id"], r["cwe"], *(tuple(r[c]) for c in lists)) for r in got)


def entries(rule: Rule) -> list[str]:
    """A rule's keywords and literals as tokens: without white space around, literals without their bracket."""
    return [t for t in (*(k.strip() for k in rule.keywords), *(p.strip().rstrip("(") for p in rule.patterns)) if t]


@lru_cache
def terms(rules: tuple[Rule, ...] = CATALOGUE) -> tuple[str, ...]:
    """All strings that rules look for in lower-cased code, with their ids and names; a term's number is its place."""
    found = {COMMENT, KEYWORDS, *HINTS}
    for r in rules:
        found |= {r.rule_id.lower(), NAMES.get(r.rule_id, r.rule_id).lower(), *r.patterns, *r.require_any, *(k.lower() for k in r.keywords), *(t.lower() for t in entries(r))}
    return tuple(sorted(t for t in found if t))


def present(code: Column, rules: tuple[Rule, ...] = CATALOGUE) -> Column:
    """The numbers of the terms that occur in code, lower-cased, by one automaton of all of them in one pass over a text; null code has none."""
    words = terms(rules)
    made = []

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        if not made:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words):
                automaton.add_word(w, i)
            automaton.make_automaton()
            made.append(automaton)
        return pa.array([sorted({i for _, i in made[0].iter(t.as_py().lower())}) if t.is_valid else [] for t in texts], pa.list_(pa.int32()))

    return found(code)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out if tests else F.lit(True)


def structural(code: Column, rule: Rule, has: Callable[[str], Column]) -> Column:
    """Any literal and any regular pattern (an empty list asks for nothing), and one of require_any; has says whether a literal occurs."""
    some = F.lit(bool(rule.patterns or rule.regexes))
    return some & _any([has(p) for p in rule.patterns]) & _any([has(p) for p in rule.require_any]) & _any([F.rlike(code, F.lit(f"(?ims){r}")) for r in rule.regexes])


def semantic(rule: Rule, has: Callable[[str], Column]) -> Column:
    """Share of the rule's keywords that occur."""
    return sum((has(k.lower()).cast("int") for k in rule.keywords), F.lit(0)) / max(1, len(rule.keywords))


def near_confidence(similarity: Column) -> Column:
    """Confidence of a vector that is near to a rule's prototype; null for others."""
    return F.when(similarity >= NEAR, F.least(F.lit(NEAR_MOST), NEAR_BASE + NEAR_STEP * similarity))


def similarities(embedding: Column, prototypes: dict[str, list[float]], rules: tuple[Rule, ...] = CATALOGUE) -> Column:
    """The cosine of a vector and each rule's prototype, in the order of rules; null where a rule has none or one of both has no length.

    Prototypes are a catalogue's, so there are no more than its rules; all of them are one matrix product over a batch.
    """
    own = [r.rule_id for r in rules]
    missing = [r not in prototypes for r in own]
    size = max((len(v) for v in prototypes.values()), default=0)
    matrix = np.array([prototypes.get(r, [0.0] * size) for r in own], np.float64).reshape(len(own), size)

    @F.arrow_udf("array<double>")
    def cosines(vectors: pa.Array) -> pa.Array:
        good = [v.is_valid and len(v.as_py()) == size for v in vectors]
        x = np.array([v.as_py() if g else [0.0] * size for v, g in zip(vectors, good, strict=True)], np.float64).reshape(len(good), size)
        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
        none = (np.linalg.norm(x, axis=1) < 1e-9)[:, None] | (np.linalg.norm(matrix, axis=1) < 1e-9)[None, :] | np.array(missing)[None, :]
        found = np.where(none, 0.0, (x @ matrix.T) / np.where(none, 1.0, norms))
        flat = pa.array(found.ravel(), pa.float64(), mask=none.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(own)), pa.int32()), flat)

    return cosines(embedding)


def with_hits(rows: DataFrame, code: str, rules: tuple[Rule, ...] = CATALOGUE, hits: str = "hits", terms_in: str = "terms_in", embedding: str | None = None, prototypes: dict[str, list[float]] | None = None) -> DataFrame:
    """rows with terms_in, the numbers of the terms() that occur, and hits: the rules that code hits, the surest first.

    Layers are contextual, structural and semantic, and, where rows have an embedding and rules prototypes, embedding: a
    vector near a rule's prototype. Each rule counts with its surest layer (of equals the first of these). Of equally sure
    rules, those whose first layer comes earlier go first, then those that stand first in the catalogue. All rules are one
    projection over a text, in steps that are columns of their own so that none is computed twice; there is no join of
    texts with rules. Null code has no hits. Texts and vectors go to Python in small batches.
    """
    small_batches(rows.sparkSession)
    number = {t: i for i, t in enumerate(terms(rules))}
    has = lambda term: F.array_contains(terms_in, number[term]) if term else F.lit(True)
    none = F.array().cast("array<string>")
    hinted = F.when(has(HINTS[0]) | has(HINTS[1]), comment_hints(F.col(code))[0]).otherwise(none)
    layers = [
        F.struct(F.when(F.array_contains("__cwes", r.cwe), CONTEXTUAL).alias("c0"), F.when(structural(F.col(code), r, has), STRUCTURAL).alias("c1"), semantic(r, has).alias("share"))
        for r in rules
    ]
    ids, cwes = (F.array(*map(F.lit, x)) for x in ([r.rule_id for r in rules], [r.cwe for r in rules]))

    def rated(x: Column, i: Column) -> Column:
        c2 = F.when(x["share"] >= SHARE, F.least(F.lit(SHARE_MOST), SHARE_BASE + SHARE_STEP * x["share"]))
        near = F.get("__near", i)
        c3 = near_confidence(near)
        return F.struct(x["c0"].alias("c0"), x["c1"].alias("c1"), c2.alias("c2"), x["share"].alias("share"), near.alias("near"), i.alias("rule"), F.greatest(x["c0"], x["c1"], c2, c3).alias("best"))

    def hit(x: Column) -> Column:
        by = lambda *v: F.when(x["c0"] == x["best"], v[0]).when(x["c1"] == x["best"], v[1]).when(x["c2"] == x["best"], v[2]).otherwise(v[3])
        rule_id = F.element_at(ids, x["rule"] + 1)
        first = F.when(x["c0"].isNotNull(), 0).when(x["c1"].isNotNull(), 1).when(x["c2"].isNotNull(), 2).otherwise(3)
        found = F.struct(x["best"].alias("confidence"), by(F.lit("contextual"), F.lit("structural"), F.lit("semantic"), F.lit("embedding")).alias("layer"), x["rule"].alias("rule"), rule_id.alias("rule_id"), F.element_at(cwes, x["rule"] + 1).alias("cwe"), by(F.lit(COMMENT), rule_id, F.concat(F.lit(KEYWORDS), F.format_number(x["share"], 2)), F.concat(F.lit("cosine:"), F.format_number(x["near"], 3))).alias("matched_on"))
        return F.struct((-x["best"]).alias("c"), first.alias("l"), x["rule"].alias("r"), found.alias("h"))

    out = rows.withColumn(terms_in, present(F.col(code), rules)).withColumn("__cwes", hinted).withColumn("__layers", F.array(*layers))
    out = out.withColumn("__near", similarities(F.col(embedding), prototypes or {}, rules) if embedding else F.array().cast("array<double>"))
    out = out.withColumn("__rated", F.filter(F.transform("__layers", rated), lambda x: x["best"].isNotNull()))
    return out.withColumn(hits, F.transform(F.array_sort(F.transform("__rated", hit)), lambda x: x["h"])).drop("__cwes", "__layers", "__near", "__rated")


def each_hit(rows: DataFrame, *keep: str, hits: str = "hits") -> DataFrame:
    """keep, place (from 0) and h, a row for each hit of rows of with_hits().

    The hits are exploded in the outer form, and the rows without any go afterwards: for the plain form Spark would look
    for rows that have hits beneath the projection, which scans and rates each text twice, the first time to filter it.
    """
    return rows.select(*keep, F.posexplode_outer(hits).alias("place", "h")).filter(F.col("h").isNotNull())


def attributed(segments: DataFrame, key: str, code: str, flagged: DataFrame, rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """For each row of flagged (key, flagged): the best hits of its segments (key, code) and what they say with the flag.

    category, novelty (1 less the confidence) and signature_confidence, both of four digits, primary rule and the number of rules.
    """
    rows = with_hits(segments.select(key, F.col(code).alias("__code")), "__code", rules)
    rows = each_hit(rows, key).select(key, "h.*")
    best = rows.groupBy(key, "rule_id").agg(F.max("confidence").alias("confidence"), F.first("rule").alias("rule"))
    by = best.groupBy(key).agg(F.count("*").alias("n_rules"), F.max(F.struct("confidence", (-F.col("rule")).alias("r"), "rule_id")).alias("x"))
    out = flagged.join(by, key, "left")
    confidence = F.coalesce("x.confidence", F.lit(0.0))
    kind = S.category(F.col("flagged"), confidence >= KNOWN)
    return out.select(*flagged.columns, kind.alias("category"), S.rounded(1 - confidence, 4).alias("novelty"), S.rounded(confidence, 4).alias("signature_confidence"), F.col("x.rule_id").alias("primary_rule"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def by_window(segments: DataFrame, key: str, number: str, window: str, code: str, rules: tuple[Rule, ...] = CATALOGUE, embedding: str | None = None, prototypes: dict[str, list[float]] | None = None) -> DataFrame:
    """One row a function (key, matches, windows): the best hit of each rule over its segments, and the hits of each window, from one scan.

    A segment has a number, the order in which it is looked at, and a window's index or null (the whole function). matches
    are the surest first, of equals in the order in which their rules first came up; of a rule's equally sure hits the
    first counts. windows has (window_index, hits) for windows with hits, each hit once, by index. A row holds the segments
    of one function.
    """
    rows = segments.select(key, F.col(number).alias("no"), F.col(window).alias("window"), F.col(code).alias("code"), *([F.col(embedding).alias("__vector")] if embedding else []))
    found = with_hits(rows, "code", rules, embedding="__vector" if embedding else None, prototypes=prototypes).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "window", "hits"))).alias("s"))
    each = F.flatten(F.transform("s", lambda s: F.transform(s["hits"], lambda h, i: F.struct(s["no"].alias("no"), i.alias("i"), h.alias("h")))))
    found = found.withColumn("e", each).withColumn("ids", F.array_distinct(F.transform("e", lambda x: x["h"]["rule"])))

    def best(rule: Column) -> Column:
        own = F.filter("e", lambda x: x["h"]["rule"] == rule)
        top = F.array_sort(F.transform(own, lambda x: F.struct((-x["h"]["confidence"]).alias("c"), x["no"].alias("no"), x["i"].alias("i"), x["h"].alias("h"))))
        return F.struct(F.element_at(top, 1)["c"].alias("c"), F.element_at(own, 1)["no"].alias("no"), F.element_at(own, 1)["i"].alias("i"), F.element_at(top, 1)["h"].alias("h"))

    matches = F.transform(F.array_sort(F.transform("ids", best)), lambda x: x["h"])
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda s: s["window"].isNotNull() & (F.size(s["hits"]) > 0)), lambda s: s["window"])))
    windows = F.transform(numbers, lambda w: F.struct(w.alias("window_index"), F.array_distinct(F.flatten(F.transform(F.filter("s", lambda s: s["window"] == w), lambda s: s["hits"]))).alias("hits")))
    return found.select(key, matches.alias("matches"), windows.alias("windows"))
