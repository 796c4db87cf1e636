"""Token windows of long texts, packed line by line by the rules of SURVEY B.8.

Tokens are those of a byte-pair tokenizer whose ranks are given, or runs without white space where none is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that a window is filled to, may reach by merging its tail, and may never exceed; and the characters that are counted at once.
SAFE, HIGH, MOST = 450, 480, 500
SLICE = 200_000
#: Fixed value: how the public byte-pair vocabulary of 50,257 ids parts a text before merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Short texts whose counts a worker remembers.
REMEMBERED = 1 << 16


def words_in(text: str) -> int:
    """Runs without white space."""
    return len(re.findall(r"\S+", text))


class Tokenizer:
    """Counts byte-pair tokens; longest is how many characters a token has at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self._encode = tiktoken.Encoding("windows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self._short = lru_cache(REMEMBERED)(lambda text: len(self._encode(text)))

    def __call__(self, text: str) -> int:
        """Tokens of a text; a text of more than SLICE characters is counted in slices."""
        if len(text) <= 64:
            return self._short(text)
        return sum(len(self._encode(text[i : i + SLICE])) for i in range(0, len(text), SLICE))


def ranks(spark: SparkSession, path: str) -> Broadcast:
    """The ranks of a vocabulary file (a token in base 64 and its rank a line), as a broadcast of the vocabulary's size."""
    if "://" in path:
        lines = [r["value"] for r in spark.read.text(path).collect()]
    else:
        with open(path) as file:
            lines = file.read().splitlines()
    return spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)})


def runs(sizes: list[int], safe: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of `safe` tokens together at most; an item of more than `most` is a range of its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if begin < i and (n > most or total + n > safe):
            yield begin, i
            begin, total = i, 0
        total += n
        if n > most:
            yield i, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def by_characters(text: str, count: Callable[[str], int], most: int) -> Iterator[tuple[str, int]]:
    """Pieces of a text without a place to cut: each as long as halving the rest finds that `most` tokens reach.

    A prefix longer than `most` of the longest tokens is over the budget without being counted, so a piece costs the same
    however long the rest is.
    """
    reach = most * getattr(count, "longest", len(text) + 1)
    at = 0
    while at < len(text):
        low, high, end = at + 1, len(text), at + 1
        while low <= high:
            middle = (low + high) // 2
            if middle - at <= reach and count(text[at:middle]) <= most:
                low, end = middle + 1, middle
            else:
                high = middle - 1
        yield text[at:end], count(text[at:end])
        at = end


def by_words(text: str, count: Callable[[str], int], safe: int, most: int) -> Iterator[tuple[str, int]]:
    """Windows of whole words, joined by one space; words beyond `most` by characters.

    Words that merge with a space before them worse than with one behind can be few enough one by one and too many
    together: such a window, if it holds all words, is halved, as the same cut would give it again.
    """
    words = text.split()
    sizes = [count(w + " ") for w in words]
    for a, b in runs(sizes, safe, most):
        if b - a == len(words) > 1 and count(" ".join(words)) > most:
            for half in (words[: b // 2], words[b // 2 :]):
                yield from within(" ".join(half), count, safe, most)
            continue
        yield from by_characters(words[a], count, most) if sizes[a] > most else within(" ".join(words[a:b]), count, safe, most)


def within(window: str, count: Callable[[str], int], safe: int, most: int) -> Iterator[tuple[str, int]]:
    """The window with its tokens; if they are more than `most`, cut between words, a single word by characters."""
    n = count(window)
    if n <= most:
        yield window, n
    elif len(window.split()) > 1:
        yield from by_words(window, count, safe, most)
    else:
        yield from by_characters(window, count, most)


def packed(text: str, count: Callable[[str], int] = words_in, safe: int = SAFE, high: int = HIGH, most: int = MOST) -> list[tuple[str, int]]:
    """(window, tokens): whole lines up to `safe` tokens; a line of more than `most` is cut between words into windows of its own; a short tail joins the window before it.

    A text of one line stays whole up to `most` tokens; a blank text is one empty window. A line counts with its line end,
    and no window has more than `most` tokens.
    """
    if not text.strip():
        return [("", 0)]
    lines = text.splitlines()
    if len(lines) == 1:
        n = count(lines[0])
        return [(text, n)] if n <= most else list(by_words(text, count, safe, most))
    sizes = [count(line + "\n") for line in lines]
    out: list[tuple[str, int]] = []
    for a, b in runs(sizes, safe, most):
        out += by_words(lines[a], count, safe, most) if sizes[a] > most else [("\n".join(lines[a:b]), sum(sizes[a:b]))]
    if len(out) > 1 and out[-1][1] < safe // 3 and out[-2][1] + out[-1][1] <= high:
        both = f"{out[-2][0]}\n{out[-1][0]}"
        if (n := count(both)) <= most:
            out[-2:] = [(both, n)]
    return [piece for window, _ in out for piece in within(window, count, safe, most)]


_made: dict[int, Tokenizer] = {}


def counter(given: Broadcast | None) -> Callable[[str], int]:
    """The counter of a task: one tokenizer a worker, white space without ranks."""
    if given is None:
        return words_in
    key = id(given.value)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(given.value)
    return _made[key]


def token_counts(rows: DataFrame, id_col: str, text_col: str, given: Broadcast | None = None) -> DataFrame:
    """(id_col, n_tokens) of whole texts; null texts have none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(given)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py() or "") for t in batch.column(1)], pa.int64())], ["i", "n_tokens"])

    return rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(counted, f"i {kind}, n_tokens long").withColumnRenamed("i", id_col)


def expanded(rows: DataFrame, id_col: str, text_col: str, given: Broadcast | None = None) -> DataFrame:
    """One row for each window: group id, window id (with a number where there are several), window_index, window_count, is_windowed, token_count, code.

    given: ranks() of a tokenizer. A null text is one empty window.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(given)
        for batch in batches:
            rows, at, many, tokens, code = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                found = packed(t.as_py(), count)
                rows += [i] * len(found)
                at += range(len(found))
                many += [len(found)] * len(found)
                tokens += [n for _, n in found]
                code += [c for c, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(many, pa.int32()), pa.array(tokens, pa.int64()), pa.array(code, pa.string())], ["function_group_id", "window_index", "window_count", "token_count", "code"])

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(cut, f"function_group_id {kind}, window_index int, window_count int, token_count long, code string")
    several = F.col("window_count") > 1
    name = F.col("function_group_id").cast("string")
    return out.withColumns({"is_windowed": several, "window_id": F.when(several, F.concat(name, F.lit("_w"), F.col("window_index").cast("string"))).otherwise(name)})
