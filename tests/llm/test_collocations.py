"""Collocations, held against brute force and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import collocations
from tests.llm.conftest import CLASHING, COLUMNS

BREAK, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def counts_by_force(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in BREAK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + d])) for d in range(1, 6) for i in range(len(w) - d + 1))
    return f, n


def collocations_by_force(rows, least, top):
    f, n = counts_by_force(rows)
    found = {p: c for p, c in f.items() if len(p[1]) >= 2 and c >= least}
    inside = set()
    for (lang, w), c in found.items():
        for d in range(2, len(w)):
            inside |= {(lang, w[i : i + d]) for i in range(len(w) - d + 1) if 100 * c >= 100 * found[lang, w[i : i + d]]}
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return Counter((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def corpus(seed: int, n: int = 150):
    rng = random.Random(seed)
    words = ["of", "the", "New", "new", "york", "city", "hall", "é", "😀", "x-1", "\x0b", "a\xa0b"] + [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 30)):
            out += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words[:14])]
            if rng.random() < 0.2:
                out.append(rng.choice([".", ", ", "!", "\n", "\t", "?the"]))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", "."]) for w in out)))
    return rows + [(None, None), ("fr", None), ("fr", ""), ("de", " \n\t"), ("en", "the the the the the the the the"), ("en", "alone")] + [("en", "of the new york city hall in of the new york city")] * 40


def frame(spark, rows):
    full = [(i, t, lang, "web", len(t or ""), *["x"] * len(CLASHING)) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(COLUMNS))


@pytest.mark.parametrize(("seed", "least", "shard", "bits"), [(1, 3, 2_000_000, 27), (2, 7, 400, 27), (3, 2, 100, 5), (4, 300, 1000, 27)])
def test_collocations_are_brute_force(spark, monkeypatch, seed, least, shard, bits):
    """In one shard and in many, with a bitmap that prunes and one that is full."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    monkeypatch.setattr(collocations, "RANKED", 50)
    rows = corpus(seed)
    out = collocations.collocations(frame(spark, rows).repartition(5), least=least, top=25)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, out.collect())) == collocations_by_force(rows, least, 25)


def test_counts_are_brute_force(spark):
    rows = corpus(5)
    f, n = counts_by_force(rows)
    phrases, totals = collocations.phrase_counts(frame(spark, rows), "lang", "text", 5, 4)
    assert Counter(map(tuple, phrases.collect())) == Counter((lang, " ".join(w), len(w), c) for (lang, w), c in f.items() if c >= 4)
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and scores that floating point would round up."""
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)], "lang string, phrase string, d int, f long")
    n = 7 * 10**13 + 1
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert [tuple(r) for r in collocations.scored(phrases, totals).collect()] == [("en", "a b", big - 2, big, big - 1, n, 1000 * (big - 2) * n // (big * (big - 1)))]


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None)])).count() == 0


def test_states_of_an_automaton():
    """Every phrase is in one state, and the state's longest phrase has the same endpos set."""
    rng = random.Random(9)
    words = [rng.randrange(4) for _ in range(300)]
    piece = np.sort(np.array([rng.randrange(40) for _ in words]))
    code, yes = np.array(words, np.uint64), np.ones(len(words), bool)
    ends: dict[tuple, list[int]] = {}
    for d in range(1, 6):
        for e in range(d - 1, len(words)):
            if piece[e - d + 1] == piece[e]:
                ends.setdefault(tuple(words[e - d + 1 : e + 1]), []).append(e)
    found = {}
    for place, length, shortest, count in collocations.automaton(code, code, piece, yes, yes, 5):
        for p, k, low, n in zip(place.tolist(), length.tolist(), shortest.tolist(), count.tolist(), strict=True):
            longest = tuple(words[p - k + 1 : p + 1])
            for d in range(low, k + 1):
                assert longest[k - d :] not in found
                found[longest[k - d :]] = n
                assert ends[longest[k - d :]] == ends[longest]
    assert found == {p: len(e) for p, e in ends.items()}


def test_query_is_its_sql(spark, tmp_path):
    rows = corpus(6, 900)
    frame(spark, rows).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = Counter(con.execute(collocations.SQL).fetchall())
    assert len(expected) > 20
    assert Counter(map(tuple, collocations.op11_collocations(spark, str(tmp_path)).collect())) == expected == collocations_by_force(rows, 100, 2000)
