"""Tokens that make code suspicious: terms of signatures, of the catalogue and names of dangerous functions, weighted and ranked; and pieces of words put together."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import nsmallest
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.functions.text import BLANKS
from quarry.operators import signatures
from quarry.operators.signatures import CATALOGUE, COMMENT, KEYWORDS, NAMES, Rule
from quarry.session import small_batches

#: Weights of what a hit says, of a term of the catalogue and of a function's name; the names; how many tokens are shown.
HIT, TERM, CALL, TOP = 3.0, 2.0, 1.0, 5
CALLS = [
    "strcpy", "strcat", "gets", "sprintf", "snprintf", "printf", "fprintf", "scanf", "sscanf", "fscanf", "memcpy", "memmove", "memset", "malloc", "calloc", "realloc", "free",
    "system", "popen", "execve", "execl", "read", "write", "recv", "send", "sizeof", "strlen", "strncpy", "strncat",
]
#: Tokens of tokenizers that stand for no text.
SPECIAL = frozenset(["<s>", "</s>", "<pad>", "<unk>", "<mask>"])
BRACKETS = re.compile(r"\[[^\n\r\x85\u2028\u2029]+\]\Z")
#: Fixed value: identifiers of three letters at least, and operators.
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]{2,}|\.\./|->|==|!=|<=|>="
#: A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"


def identifiers(code: Column) -> Column:
    """The distinct identifiers, numbers and operators of code, lower-cased, in the order of their first place; null code has none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower))


def with_top_tokens(rows: DataFrame, code: str, n: int = TOP, rules: tuple[Rule, ...] = CATALOGUE, out: str = "tokens") -> DataFrame:
    """rows of signatures.with_hits() with `tokens`: the n of the largest weight, ties in code-point order; of spellings that differ in case only, the first.

    A hit weighs HIT for each of what it matched on, its rule's name and id that occur in the code, and for its CWE; each
    entry of the catalogue that occurs weighs TERM, each call of a dangerous function CALL. Blank and null code has no
    tokens. Steps are columns of their own, so that none is computed for each token anew.
    """
    number = {t: i for i, t in enumerate(signatures.terms(rules))}
    has = lambda term: F.array_contains("terms_in", number[term.lower()])
    entry = lambda token, weight: F.struct(token.alias("token"), F.lit(weight).alias("weight"))
    # An entry that several rules have weighs once for each of them.
    weights: dict[str, float] = {}
    for r in rules:
        for token in signatures.entries(r):
            if len(token) >= 2:
                weights[token] = weights.get(token, 0.0) + TERM
    names = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, NAMES.get(r.rule_id, r.rule_id))])
    named = F.array(*[F.when(has(t), F.lit(t)) for r in rules for t in (r.rule_id, NAMES.get(r.rule_id, r.rule_id))], F.when(has(COMMENT), F.lit(COMMENT)))

    def said(h: Column) -> Column:
        on = h["matched_on"]
        there = lambda x: F.when(F.array_contains("__named", x), entry(x, HIT))
        share = F.when(has(KEYWORDS) & on.startswith(KEYWORDS) & F.contains(F.lower(F.col(code)), on), entry(on, HIT))
        return F.array(F.coalesce(there(on), share), there(names[h["rule_id"]]), there(h["rule_id"]), entry(h["cwe"], HIT))

    calls = F.transform(F.regexp_extract_all(F.col(code), F.lit(f"(?<!{WORD})(?:{'|'.join(CALLS)})(?!{WORD})"), F.lit(0)), lambda x: entry(x, CALL))
    some = F.array(*[F.when(has(t), entry(F.lit(t), w)) for t, w in weights.items()])
    told = F.concat(F.flatten(F.transform("hits", said)), some, F.coalesce(calls, F.array().cast("array<struct<token:string,weight:double>>")))
    wide = rows.withColumn("__named", named).withColumn("__told", F.filter(told, lambda x: x.isNotNull()))
    total = lambda t: F.aggregate(F.filter("__told", lambda x: x["token"] == t), F.lit(0.0), lambda a, x: a + x["weight"])
    wide = wide.withColumn("__names", F.array_distinct(F.transform("__told", lambda x: x["token"])))
    wide = wide.withColumn("__order", F.transform(F.array_sort(F.transform("__names", lambda t: F.struct((-total(t)).alias("w"), t.alias("t")))), lambda x: x["t"]))
    firsts = F.filter("__order", lambda t, i: F.array_position(F.transform("__order", F.lower), F.lower(t)) == i + 1)
    return wide.withColumn(out, F.when(F.rlike(F.col(code), F.lit(r"(?U)[^\s\x1c-\x1f]")), F.slice(firsts, 1, n)).otherwise(F.array().cast("array<string>"))).drop("__named", "__told", "__names", "__order")


def top_words(pieces: list[str | None], values: list[float | None], n: int) -> list[tuple[str, float | None]]:
    """The n words (first spelling, sum of values) that weigh most in one row's pieces; nulls count nothing, a word of nulls only has null."""
    sums: dict[str, list] = {}

    def close(word: str, total: float | None) -> None:
        if word:
            own = sums.setdefault(word.lower(), [word, None])
            own[1] = total if own[1] is None else own[1] if total is None else own[1] + total

    word, total, begun = "", None, False
    for p, v in zip_longest(pieces, values):
        if p is not None:
            p = p.strip(BLANKS)
            if not p.startswith("##"):
                close(word, total)
                if not p or p in SPECIAL or (p[0] == "[" and BRACKETS.match(p)):
                    word, total, v = "", 0.0, None
                else:
                    word, total = p[1:] if p[0] == "Ġ" else p, None
            else:
                word += p[2:]
            begun = True
        # Null pieces before all others belong to no word.
        if v is not None and begun:
            total = v if total is None else total + v
    close(word, total)
    # As a descending order has it: what is no number goes first, null last.
    weight = lambda x: (2, 0.0) if x is None else (0, 0.0) if x != x else (1, -abs(x))
    return [(token, v) for _, (token, v) in nsmallest(n, sums.items(), key=lambda x: (weight(x[1][1]), x[0]))]


def merged_pieces(rows: DataFrame, key: str, pieces: str, values: str, n: int = TOP) -> DataFrame:
    """(key, rank, token, value): the n words of the largest absolute values of each row, put together from a tokenizer's pieces.

    `##` goes on with a word, `Ġ` begins one, special tokens and what stands in brackets part words; any other piece is a
    word's beginning, too. Words that differ in case only are one, in their first spelling; ties go by lower-cased name.
    A row's pieces stand in the row already, so each row is merged where it is read: nothing is shuffled and no piece
    becomes a row of its own. Rows go to Python in small batches, and of a batch the pieces of one row at a time are held.
    """
    small_batches(rows.sparkSession)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rank, token, value = [], [], [], []
            for i, (p, v) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                if p.is_valid and v.is_valid:
                    for k, (t, x) in enumerate(top_words(p.values.to_pylist(), v.values.to_pylist(), n), 1):
                        for to, y in zip((at, rank, token, value), (i, k, t, x), strict=True):
                            to.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(token, pa.string()), pa.array(value, pa.float64())], ["i", "rank", "token", "value"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, F.col(pieces), F.col(values).cast("array<double>")).mapInArrow(merged, f"i {kind}, rank int, token string, value double")
    return out.select(F.col("i").alias(key), "rank", "token", S.rounded(F.col("value"), 6).alias("value"))
