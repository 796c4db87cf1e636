"""Operators on words, held against brute force: substring dedup and the n-gram join."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from quarry.llm import ngram_join, substring_dedup
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_by_force(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def linked_by_force(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def passages(seed: int, n: int = 60):
    """Texts of shared passages of many lengths, some of which repeat."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    pool = [[word() for _ in range(rng.choice([20, 34, 35, 36, 52, 53, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(60))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, seed):
    rows = passages(seed)
    assert got(substring_dedup.deduplicated(frame(spark, rows), keep_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == removed_by_force(rows)


def test_substring_dedup_of_awkward_rows(spark, awkward, nothing):
    rows, df = awkward
    out = got(substring_dedup.deduplicated(df, keep_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    assert out == removed_by_force(rows)
    assert substring_dedup.deduplicated(nothing).count() == 0


def test_substring_dedup_where_a_block_of_words_ends_in_the_last_word(spark):
    """Words are hashed by blocks of 2**18 bytes; one that would begin inside a chunk's last word was empty, and an error."""
    words = [f"{i:07d}" for i in range((1 << 15) - 1)]  # with their spaces 2**18 - 8 bytes
    rows = [(1, " ".join([*words, "longer-than-eight-bytes"])), (2, " ".join(["new", *words[100:200]])), (3, "short " * 3)]
    out = got(substring_dedup.deduplicated(frame(spark, rows), keep_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    assert out == removed_by_force(rows)


def near_copies(seed: int):
    """Groups of near copies on both sides of the threshold, of sizes around the borders of the schemes."""
    rng = random.Random(seed)
    rows, i = [], 0
    for size in [1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 16, 20, 40, 100, 250, 259, 262, 300, 520]:
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1 + max(1, size // 40))):
                k = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.4:
                    copy[k] = f"e{rng.randrange(10**6)}"
                elif kind < 0.6 and len(copy) > 1:
                    del copy[k]
                elif kind < 0.8:
                    copy.insert(k, f"e{rng.randrange(10**6)}")
                else:
                    copy = copy + [f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + size // 8))]
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            i += 1
            base = copy if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_ngram_join_is_brute_force(spark, seed):
    rows = near_copies(seed)
    expected = linked_by_force(rows)
    assert len({c for _, _, c in expected}) < len(rows)
    assert got(ngram_join.linked(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == expected


def crowds(seed: int):
    """Groups of 200 classes: near copies of one text, chains of copies of copies, and texts that share most words but aren't linked."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(10**6)}"
    texts = []
    base = [word() for _ in range(90)]
    for _ in range(200):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            copy[rng.randrange(90)] = word()
        texts.append(copy)
    chain = [word() for _ in range(120)]
    for _ in range(200):
        chain = list(chain)
        for _ in range(rng.choice([1, 2, 3])):
            chain[rng.randrange(120)] = word()
        texts.append(chain)
    shared = [word() for _ in range(160)]
    texts += [shared + [word() for _ in range(rng.choice([10, 16, 17, 18, 19, 20, 21, 30, 40]))] for _ in range(200)]
    line = [word() for _ in range(9)]
    texts += [line[: rng.randrange(5, 10)] + [word() for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4]))] for _ in range(100)]
    long = [word() for _ in range(2600)]
    for _ in range(6):
        copy = list(long)
        for _ in range(rng.choice([10, 40, 56, 60, 70])):
            copy[rng.randrange(2600)] = word()
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(6, 1024), (7, 64)])
def test_ngram_join_of_large_groups(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = crowds(seed)
    expected = linked_by_force(rows)
    assert 200 < len({c for _, _, c in expected}) < len(rows) - 200
    assert got(ngram_join.linked(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == expected


def test_ngram_join_of_awkward_rows(spark, awkward, nothing):
    rows, df = awkward
    assert got(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == linked_by_force(rows)
    assert ngram_join.linked(nothing).count() == 0


def test_representatives_keep_one_document_of_each_component(spark, awkward, nothing):
    rows, df = awkward
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = linked_by_force(rows)
    blank = [r for r in rows if not WORD.search(r[1] or "")]
    words = [r for r in out if WORD.search(r[1] or "")]
    assert Counter(r for r in out if r not in words) == Counter(blank)
    assert Counter(i for i, _ in words) == Counter({c for _, n, c in expected if n})
    assert ngram_join.representatives(nothing).count() == 0
    only_null = frame(df.sparkSession, [(None, "a b c d e f"), (None, "a b c d e f"), (None, "x y z")])
    assert Counter(r["text"] for r in ngram_join.representatives(only_null).collect()) == Counter(["a b c d e f", "x y z"])


def test_ngram_join_of_a_class_in_every_partition(spark):
    """A text in 64 partitions and a near copy in 64: one signature a class, so one pair, and one component."""
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(2 * i + k, " ".join(t)) for i in range(64) for k, t in enumerate((words, near))]
    df = frame(spark, rows).repartition(64).select("doc_id", "text")
    ngram_join.small_batches(spark)
    classes = ngram_join._classes(df, "doc_id", "text", 12)
    assert classes.filter("kind = 0 and data is not null").count() > 2
    assert ngram_join._signatures(classes.filter("kind = 0")).count() == 2
    assert got(ngram_join.linked(df), "doc_id", "component_id") == Counter((i, 0) for i in range(128))
