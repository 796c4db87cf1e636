"""Spelling variants, held against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import spelling
from tests.llm.conftest import frame

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a: str, b: str) -> bool:
    """Whether the edit distance is 1, by its definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary_by_force(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def variants_by_force(rows):
    n = vocabulary_by_force(rows)
    of = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in of.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(of[w]), n[form[w]] if w in form else None))
    return Counter(out)


def spelt(seed: int):
    """Documents of words with edits at each place, chains of forms, equal counts, runs of equal letters and other letters."""
    rng = random.Random(seed)
    bases = ["letter", "bookkeeper", "Straße", "aaaaaaa", "ÉLÈVES", "élèves", "nation", "nations", "ration", "×÷×÷×÷"] + ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    bag = []
    for w in bases:
        bag += [w] * rng.choice([5, 30, 150, 800])
        for _ in range(6):
            v = w
            for _ in range(rng.choice([1, 1, 1, 2])):
                at = rng.randrange(len(v))
                v = rng.choice([v[:at] + v[at + 1 :], v[:at] + rng.choice("abcdeéz") + v[at + 1 :], v[:at] + rng.choice("abcdeé") + v[at:], v[:at] + v[at] + v[at:]])
            bag += [v] * rng.choice([4, 5, 6, 25, 160])
    rng.shuffle(bag)
    rows, at = [], 0
    while at < len(bag):
        k = rng.choice([1, 10, 400])
        words = bag[at : at + k]
        rows.append((len(rows) if rng.random() > 0.02 else None, rng.choice([" ", ", ", "1", "Ÿ", "—", "\n"]).join(words)))
        at += k
    return rows + [(None, None), (3, None), (4, ""), (5, " 1 \t"), (7, "Kelvin İstanbul")]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_brute_force(spark, seed):
    rows = spelt(seed)
    expected = variants_by_force(rows)
    assert sum(1 for w, f, r, *_ in expected if f and r != f) > 0, "no chains of forms"
    out = spelling.variants(frame(spark, rows))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, out.collect())) == expected


def test_variants_without_a_useful_bitmap(spark, monkeypatch):
    """A bitmap that is full lets every neighbour pass; the join alone decides, with the same result."""
    monkeypatch.setattr(spelling, "MAX_BITS", 6)
    monkeypatch.setattr(spelling, "BLOCK", 500)
    rows = spelt(3)[:40]
    assert Counter(map(tuple, spelling.variants(frame(spark, rows)).collect())) == variants_by_force(rows)


def test_variants_of_awkward_rows(spark, awkward, nothing):
    rows, df = awkward
    assert Counter(map(tuple, spelling.variants(df).collect())) == variants_by_force(rows)
    assert spelling.variants(nothing).count() == 0


def test_long_words_have_all_neighbours(spark):
    """A word of 30,000 letters meets its neighbours, as strings."""
    long = "ab" * 15_000
    rows = [(i, f"{long} {long}x {long[:100]}{long[101:]} {long[:50]}c{long[51:]}") for i in range(6)]
    assert Counter(map(tuple, spelling.variants(frame(spark, rows)).collect())) == variants_by_force(rows)


def test_neighbours_are_all_and_distinct():
    letters = sorted("abcé")
    codes = np.array([ord(c) for c in letters], np.uint32)
    for word in ("aabbca", "aaaaaa", "abcabc", "éaéaéa"):
        made = []
        for _, matrix in spelling.by_length([word]):
            for edit, hashes, _, place, letter in spelling.neighbours(matrix, codes):
                some = [spelling.edited(word, edit, p, letters[c]) for p, c in zip(place.tolist(), letter.tolist(), strict=True)]
                for at, m in spelling.by_length(some):
                    assert (spelling.word_hashes(m) == hashes[at]).all()
                made += some
        expected = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + c + word[i + 1 :] for i in range(6) for c in letters} | {word[:i] + c + word[i:] for i in range(7) for c in letters}
        assert Counter(made) == Counter(expected - {word})
