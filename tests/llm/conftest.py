"""Documents that hold every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest

#: Extra columns with names that operators use inside.
CLASHING = ["node", "tie", "size", "shard", "slot", "key", "cls", "id", "row", "chunk", "range", "spans", "score", "label", "features", "at", "n", "a", "b", "digest", "payload", "owner", "group"]
COLUMNS = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{c}` string" for c in CLASHING]]


def frame(spark, rows):
    """Documents from (doc_id, text) pairs, with the extra columns."""
    full = [(i, t, None if i is None else "en", None if t is None else "web", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, ", ".join(COLUMNS))


@pytest.fixture(scope="session")
def awkward(spark):
    """(rows, DataFrame) of awkward documents."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    near = list(base)
    near[60] = "other"
    texts = [
        None, "", " \t\n ", "one", "ONE", "one two three four", "one  two\tthree\nfour five", " ".join(base), " ".join(base), "  ".join(near), " ".join(base).upper(),
        " ".join(base[:50] + passage + base[50:]), " ".join(passage), " ".join(rng.choice(words) for _ in range(8000)) + " " + " ".join(passage), "naïve café 😀 ü" * 40, "\x0b\x0c| nbsp wide", "a" * 30_000,
        " ".join(["same"] * 400), "x@y.com, +1 234 567 8901, 10.0.0.1, 4111 1111 1111 1111",
    ]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rows += [(8, " ".join(base)), (8, " ".join(base)), (1, None), (None, " ".join(base)), (None, None)]
    return rows, frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    """An empty table of documents."""
    return frame(spark, [])
