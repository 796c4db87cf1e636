"""Token windows and window tiers, held against the reference's rules."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import windows


def by_force(text: str) -> list[tuple[str, int]]:
    """The reference's rules, word by word, with white-space tokens."""
    count = lambda t: len(t.split())

    def hard(line):
        out, chunk = [], []
        for word in line.split():
            if chunk and len(chunk) + 1 > 450:
                out.append(" ".join(chunk))
                chunk = []
            chunk.append(word)
        return out + [" ".join(chunk)]

    if not text.strip():
        return [("", 0)]
    lines = text.splitlines()
    if len(lines) == 1:
        return [(text, count(text))] if count(text) <= 500 else [(w, count(w)) for w in hard(text)]
    found, buffer = [], []
    for line in lines:
        if buffer and sum(map(count, buffer)) + count(line) > 450:
            found.append("\n".join(buffer))
            buffer = []
        if count(line) > 500:
            if buffer:
                found.append("\n".join(buffer))
            buffer = []
            found += hard(line)
        else:
            buffer.append(line)
    if buffer:
        found.append("\n".join(buffer))
    if len(found) > 1 and count(found[-1]) < 150 and count(found[-2]) + count(found[-1]) <= 480:
        found[-2:] = ["\n".join(found[-2:])]
    return [(w, count(w)) for w in found]


def test_windows_follow_the_reference():
    line = lambda n: " ".join(f"t{i}" for i in range(n))
    assert [n for _, n in windows.packed(line(300) + "\n" + line(170))] == [300, 170]
    assert [n for _, n in windows.packed(line(400) + "\n" + line(70))] == [470]
    assert [n for _, n in windows.packed(line(520) + "\n" + line(200))] == [450, 70, 200]
    assert windows.packed(" \n ") == [("", 0)]
    rng = random.Random(6)
    sizes = [0, 1, 5, 29, 30, 31, 100, 149, 150, 151, 170, 300, 330, 449, 450, 451, 480, 500, 501, 520, 900, 901, 1400]
    for _ in range(3000):
        text = rng.choice(["", "\n", "  "]) + rng.choice(["\n", "\n\n"]).join(line(rng.choice(sizes)) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "\n"])
        assert windows.packed(text) == by_force(text)


class Bpe:
    """The public vocabulary by its own library, for the rules as the reference states them, step by step."""

    def __init__(self):
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def count(self, text):
        return sum(len(self.encode(text[i : i + 200_000])) for i in range(0, len(text), 200_000))

    def halved(self, text, begin):
        """Where halving ends: the last middle that fits, as of the range of ends that is left."""
        left, right, best = begin + 1, len(text), begin + 1
        while left <= right:
            fits = self.count(text[begin : (left + right) // 2]) <= 500
            best = (left + right) // 2 if fits else best
            left, right = ((left + right) // 2 + 1, right) if fits else (left, (left + right) // 2 - 1)
        return best

    def characters(self, text):
        out, begin = [], 0
        while begin < len(text):
            end = self.halved(text, begin)
            out.append(text[begin:end])
            begin = end
        return out

    def hard(self, text):
        out, chunk = [], []
        for word in text.split():
            if self.count(word + " ") > 500:
                out += [" ".join(chunk)] if chunk else []
                out += self.characters(word)
                chunk = []
            elif chunk and sum(self.count(w + " ") for w in [*chunk, word]) > 450:
                out.append(" ".join(chunk))
                chunk = [word]
            else:
                chunk.append(word)
        out += [" ".join(chunk)] if chunk else []
        return [x for w in out for x in self.checked(w)]

    def checked(self, window):
        if self.count(window) <= 500:
            return [window]
        return self.characters(window) if len(window.split()) <= 1 else self.hard(window)

    def packed(self, text):
        if not text.strip():
            return [("", 0)]
        lines = text.splitlines()
        if len(lines) == 1:
            found = [text] if self.count(lines[0]) <= 500 else self.hard(text)
            return [(w, self.count(lines[0] if w is text else w)) for w in found]
        found, buffer = [], []
        size = lambda b: sum(self.count(x + "\n") for x in b)
        for line in lines:
            if buffer and (size([*buffer, line]) > 450 or size([line]) > 500):
                found.append(("\n".join(buffer), size(buffer)))
                buffer = []
            if size([line]) > 500:
                found += [(w, self.count(w)) for w in self.hard(line)]
            else:
                buffer.append(line)
        if buffer:
            found.append(("\n".join(buffer), size(buffer)))
        if len(found) > 1 and found[-1][1] < 150 and found[-2][1] + found[-1][1] <= 480 and self.count(found[-2][0] + "\n" + found[-1][0]) <= 500:
            found[-2:] = [(found[-2][0] + "\n" + found[-1][0], 0)]
        return [(x, self.count(x)) for w, _ in found for x in self.checked(w)]


def bpe_texts():
    rng = random.Random(12)
    word = lambda: rng.choice(["static", "memcpy(", "x", "->", "naïve", "😀", "0x7f", "a" * 40, "".join(rng.choice("abcxyz{}();é") for _ in range(rng.randrange(1, 30)))])
    line = lambda n: " ".join(word() for _ in range(n))
    out = ["", " \n\t", "one", line(200), line(2000), "".join(rng.choice("abcdefé{}();->") for _ in range(50_000)), "z" * 50_000, line(300) + "\n" + "".join(rng.choice("01") for _ in range(9000)) + " " + line(400) + "\n\n" + line(20), "x\r\ny\x0bz\n"]
    return out + ["\n".join(line(rng.choice([0, 1, 10, 60, 90, 150, 700])) for _ in range(rng.randrange(2, 12))) for _ in range(40)]


def test_tokenizer_windows_are_brute_force(spark):
    """Windows, counts and cuts by characters under the public byte-pair vocabulary, whole words of 50,000 characters among them."""
    own, given = Bpe(), windows.ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = bpe_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    found: dict[int, list] = {}
    for r in windows.expanded(df, "id", "text", given).orderBy("window_index").collect():
        found.setdefault(r["function_group_id"], []).append((r["code"], r["token_count"]))
        assert r["token_count"] <= 500 and r["window_id"] == (f"{r['function_group_id']}_w{r['window_index']}" if r["window_count"] > 1 else str(r["function_group_id"]))
    assert found == {i: own.packed(t) for i, t in enumerate([*texts, ""])}
    assert max(len(v) for v in found.values()) > 50
    counts = {r["id"]: r["n_tokens"] for r in windows.token_counts(df, "id", "text", given).collect()}
    assert counts == {i: own.count(t) for i, t in enumerate([*texts, ""])}


def test_words_that_are_too_many_only_together_are_cut(spark):
    """220 rules of 32 signs are 440 tokens with a space behind each and over 500 with one before: cutting them again gave the same window without end."""
    given = windows.ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [f"{before}{' '.join([sign * 32] * 220)}{after}" for sign in "#/" for before, after in (("", ""), ("int x;\n", "\nint y;"))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found: dict[int, list] = {}
    for r in windows.expanded(df, "id", "text", given).orderBy("window_index").collect():
        found.setdefault(r["function_group_id"], []).append((r["code"], r["token_count"]))
    count = Bpe().count
    for i, text in enumerate(texts):
        assert " ".join(c for c, _ in found[i]).split() == text.split() and len(found[i]) > 1
        assert all(n == count(c) <= 500 for c, n in found[i])


def test_long_texts_are_counted_in_slices(spark):
    own, count = Bpe(), windows.Tokenizer(windows.ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")).value)
    text = "naïve words 😀 " * 30_000
    assert count(text) == own.count(text) != len(own.encode(text))
    pieces = list(windows.by_characters("ab😀" * 70_000, count, 500))
    assert "".join(p for p, _ in pieces) == "ab😀" * 70_000 and all(n <= 500 for _, n in pieces)


def test_window_tiers_follow_the_reference(spark):
    rows = spark.createDataFrame([(True, 0.42), (False, 0.42), (True, 0.3), (False, 0.3), (False, 0.1)], "flagged boolean, top double")
    tier = S.precision_tier(F.col("flagged"), F.col("top") >= S.CONFIRMED)
    got = rows.select(S.agreement(F.col("flagged"), F.col("top") >= 0.26), tier, S.user_facing(tier)).collect()
    assert [tuple(r) for r in got] == [("agree_positive", "confirmed", True), ("review_suggested", "investigate", True), ("agree_positive", "soft_review", False), ("review_suggested", "safe", False), ("agree_negative", "safe", False)]


def test_boosts_follow_the_reference(spark):
    x = [0.10, 0.20, 0.70, 1.0, 0.12, 0.36]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(S.smooth_boost(F.col("x"))).collect()] == [0.46, 0.52, 0.82, 1.0, 0.472, 0.616]
    tiers = spark.createDataFrame([(0.32,), (0.28,), (0.25,)], "x double").select(S.deployment(F.col("x"))["deployment_tier"]).collect()
    assert [r[0] for r in tiers] == ["vuln", "needs_review", "safe"]
