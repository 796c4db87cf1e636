"""Operators that map texts, held against other libraries, brute force or an exact round trip."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, chat_format, decontaminate, media_chunks, pii
from tests.llm.conftest import frame


def hexed(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.public_vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, awkward, nothing, sf, tiktoken_encoding):
    rows, df = awkward
    rng = random.Random(9)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(200)) for _ in range(40)]
    odd += ["aaaaaaaa" * 20, "<|endoftext|>", "  \n\n\t x", "0123456789" * 9, "ababab" * 33, "''''\"\"\"`s't"]
    rows = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    df = df.unionByName(frame(spark, rows[-len(odd) :]))

    def expected(doc, text):
        ids = tiktoken_encoding.encode_ordinary(text or "")
        return doc, len(ids), hexed(b"".join(struct.pack("<I", i) for i in ids)), hexed((text or "").encode())

    assert Counter(tuple(r) for r in byte_bpe.encoded(df).collect()) == Counter(expected(*r) for r in rows)
    assert byte_bpe.encoded(nothing).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(tuple(r) for r in byte_bpe.encoded(docs).collect()) == Counter(expected(*r) for r in docs.select("doc_id", "text").collect())


def test_bpe_memo_may_be_emptied(tiktoken_encoding):
    path, pattern = byte_bpe.public_vocabulary()
    with open(path, "rb") as lines:
        bpe = byte_bpe.ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern, pieces=3, pairs=5)
    text = "The quick brown fox, jumping over lazy dogs; internationalisation of antidisestablishmentarianism."
    assert struct.unpack(f"<{len(bpe.encode(text)) // 4}I", bpe.encode(text)) == tuple(tiktoken_encoding.encode_ordinary(text))


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


#: Python's engine needs time in the square of its length to find nothing here.
NO_SPANS = "a" * 50_000 + "@"


def base_spans(text: str):
    if text == NO_SPANS:
        return []

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in KINDS.items() if {"email": "@", "ip": "."}.get(k, "") in text for m in re.finditer(p, text) if valid(k, m[0])]


def personal_texts():
    rng = random.Random(11)
    pieces = ["a@b.c", "x@y", "@", "a@b.c_d@e.f", "x@y@z.com", ".", "..", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.2.3.000000000000255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111", "+1 (234) 567-8901", "+12345678", "+1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+", "-", " ", " ", "\n", "é", "😀", "word", "9" * 25, "5555555555554444", "378282246310005", "call 415-555-2671", "me (at) home (dot) org", "e-mail: ", "2001:0db8:0000:0000:0000:ff00:0042:8329"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["1" * 50_000, "+1" + "-" * 20_000, NO_SPANS, "1." * 10_000, "a@b.c, " * 5_000, "4111 1111 1111 1111 x" * 2_000, "1" * 50_000 + ".1.1.1"]


def test_pii_base_spans_are_the_plain_patterns(spark, awkward, nothing):
    rows = [*awkward[0], *((5000 + i, t) for i, t in enumerate(personal_texts()))]
    out = pii.detected(frame(spark, rows)).collect()
    expected = Counter()
    for doc, text in rows:
        spans = base_spans(text or "")
        count = Counter(k for k, _, _ in spans)
        expected[doc, *[count[k] for k in KINDS], hexed(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())] += 1
    assert Counter(tuple(r)[:6] for r in out) == expected
    text_of = dict(rows)
    order = list(pii.KINDS)
    for r in out:
        listed = [(order.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert listed == sorted(listed)
        assert all(0 <= a < b <= len(text_of[r["doc_id"]] or "") for _, a, b in listed)
        base = {(order.index(k), a, b) for k, a, b in base_spans(text_of[r["doc_id"]] or "")} if r["doc_id"] and r["doc_id"] >= 5000 else set()
        assert base <= set(listed)
    assert pii.detected(nothing).count() == 0


def test_redaction_leaves_no_base_span_and_other_columns(spark, awkward, nothing):
    rows, df = awkward
    out = pii.redacted(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if r["doc_id"] == 19:
            assert r["text"] == "<EMAIL>, <PHONE>, <IP>, <CARD>"
    assert pii.redacted(nothing).count() == 0


def test_redaction_is_its_spans(spark):
    rows = [(i, t) for i, t in enumerate([*personal_texts(), "x" * 3000 + " a@b.c " + "y" * 3000, "😀" * 1500 + "10.0.0.1" + "é" * 1500 + "+1 234 567 8901"])]
    listed = {r["doc_id"]: r["spans"] for r in pii.detected(frame(spark, rows)).collect()}
    order = list(pii.KINDS)
    for r in pii.redacted(frame(spark, rows)).collect():
        text, out, at = dict(rows)[r["doc_id"]], [], 0
        for start, end, kind in sorted((int(a), int(b), order.index(k)) for k, a, b in (x.split(":") for x in listed[r["doc_id"]].split(",") if x)):
            if start >= at:
                out += [text[at:start], f"<{order[kind].upper()}>"]
            at = max(at, end)
        assert r["text"] == "".join(out) + text[at:]
        assert r["n_chars"] == len(r["text"])


def test_added_spans_are_judged(spark):
    """Cards in runs of digits and secrets are added, long words and numbers without check digits aren't."""
    rng = random.Random(4)
    code = lambda n, chars="0123456789abcdef": "".join(rng.choice(chars) for _ in range(n))

    def card(good):
        while True:
            n = "4" + code(15, "0123456789")
            if luhn(n) == good:
                return n

    rows, expected = [], {}
    for i in range(350):
        kind, word = i % 7, "und die " * rng.randrange(1, 5)
        item = [f'token = "{code(40)}"', f"password={code(18)}", "AKIA" + code(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"555-3296 {card(True)}", f"555-3296 {card(False)}", "ver" + "einerheit" * 2 + code(2, "abcdef"), f"und.{i}@mail.example.com"][kind]
        rows.append((i, f"{word}{item} und so weiter"))
        name = {3: "card", 6: "email"}.get(kind, "secret")
        found = re.search(r"AKIA\w{16}|(?<![\w])[0-9a-f]{16,}|\S+@\S+", item)
        start = len(word) + (found.start() if found else 0)
        expected[i] = f"{name}:{start}:{start + len(found[0])}" if kind in (0, 1, 2, 3, 6) else ""
    got = {r["doc_id"]: r["spans"] for r in pii.detected(frame(spark, rows)).collect()}
    assert got == expected


def test_reliabilities_are_plain_em():
    """Expectation-maximisation over counts is that over single spans, written out."""
    rng = random.Random(3)
    spans = [(rng.randrange(2), tuple(rng.choice([-1, 0, 1]) for _ in range(4))) for _ in range(400)]
    base = [rng.random() < 0.2 for _ in spans]
    count, known = Counter(spans), Counter(s for s, b in zip(spans, base, strict=True) if b)
    got = pii.reliabilities(sorted((k, v, n, known[k, v]) for (k, v), n in count.items()), rounds=7)
    first = [{(y, v): (r if (v > 0) == y else 1 - r) if v else 0.5 for y in (True, False) for v in (-1, 0, 1)} for r in pii.RIGHT]
    rate = [dict(r) for r in first]
    share = {0: 0.5, 1: 0.5}
    for _ in range(7):
        post = []
        for k, vs in spans:
            yes, no = share[k], 1 - share[k]
            for j, v in enumerate(vs):
                yes, no = yes * rate[j][True, v], no * rate[j][False, v]
            post.append(yes / (yes + no))
        free, post = post, [1.0 if b else p for p, b in zip(post, base, strict=True)]
        for k in share:
            own = [p for (q, _), p in zip(spans, post, strict=True) if q == k]
            share[k] = (sum(own) + 1) / (len(own) + 2)
        for j in range(4):
            for y in (True, False):
                weight = {v: (1 + pii.PRIOR * len(spans)) * first[j][y, v] + sum((p if y else 1 - p) for (_, vs), p in zip(spans, post, strict=True) if vs[j] == v) for v in (-1, 0, 1)}
                for v in weight:
                    rate[j][y, v] = weight[v] / sum(weight.values())
    assert all(abs(got[s] - p) < 1e-9 for s, p in zip(spans, free, strict=True))


def test_media_round_trip(spark, awkward, nothing):
    rows, df = awkward
    media, store = media_chunks.stored(df)
    out = media_chunks.read_media(media, store).collect()

    def expected(doc, text):
        data = (text or "").encode()
        payload = media_chunks.padded(data)
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == data.rstrip(b" ") and len(payload) - len(data) <= 192
        stored = media_chunks.wav(payload)
        return doc, len(data), len(payload), hexed(payload), zlib.crc32(payload[-16:]), len(stored), hexed(stored), media_chunks.feature(payload), True

    assert Counter(tuple(r) for r in out) == Counter(expected(*r) for r in rows)
    assert store.count() == store.select("digest").distinct().count() > 0
    assert media_chunks.read_media(*media_chunks.stored(nothing)).count() == 0


def test_frequent_chunks_are_dealt_over_places(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "OFTEN", 0)
    body = " ".join(str(n * n) for n in range(600))
    df = spark.createDataFrame([(n, f"{n} {body}" if n % 3 else body) for n in range(40)], "doc_id long, text string")
    media, store = media_chunks.stored(df)
    assert store.count() == store.select("digest").distinct().count() * media_chunks.SALTS > 0
    out = {r.doc_id: r for r in media_chunks.read_media(media, store).collect()}
    assert len(out) == 40 and all(r.verified for r in out.values())
    for r in df.collect():
        assert out[r.doc_id].payload_sha256 == hexed(media_chunks.padded(r.text.encode()))


def test_cuts_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    a = {d for d, _ in media_chunks.chunks(media_chunks.wav(media_chunks.padded(body)))}
    b = {d for d, _ in media_chunks.chunks(media_chunks.wav(media_chunks.padded(b"shifted" + body)))}
    assert len(a & b) > 0.8 * len(a)
    for media in (media_chunks.wav(media_chunks.padded(body)), media_chunks.wav(media_chunks.padded(b""))):
        ends = media_chunks.cuts(media)
        assert ends[-1] == len(media) and ends == sorted(set(ends))
        assert all(b - a <= media_chunks.MOST for a, b in zip([0, *ends], ends, strict=False))


def edits_by_force(item: str, text: str) -> int:
    """The fewest edits that turn an item into a part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_is_brute_force(spark, awkward, nothing):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 9, 16])))) for i in range(10)] + [(100, None), (101, ""), (102, "short"), (104, "bh"), (105, "ab cdefg ha"), (106, "dc"), (103, "Ünïcode  Text\twith MORE letters 😀 here")]
    rows = []
    for i in range(70):
        body = [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.8:
            planted = list(rng.choice([t for _, t in items[:10]] + [items[-1][1]]))
            for _ in range(rng.randrange(1 + len(planted) // 8)):
                k = rng.randrange(len(planted))
                planted[k] = rng.choice(["", "z", planted[k] + "y"])
            body.insert(rng.randrange(len(body) + 1), "".join(planted).upper() if rng.random() < 0.3 else "".join(planted))
        rows.append((i, "  ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    expected = set()
    for doc, text in rows:
        for item, t in items:
            m = decontaminate.normal(t or "")
            if m:
                e = edits_by_force(m, decontaminate.normal(text))
                if e <= int(len(m) * decontaminate.EDITS):
                    expected.add((doc, item, e))
    out = decontaminate.contaminated(docs, bench).collect()
    assert {tuple(r)[:3] for r in out} == expected and len(out) == len(expected) > 20
    for r in out:
        text, item = decontaminate.normal(dict(rows)[r["doc_id"]]), decontaminate.normal(dict(items)[r["item_id"]])
        assert edits_by_force(item, text[r["begin"] : r["end"]]) == r["edits"]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {d for d, _, _ in expected}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.clean(nothing, bench).count() == 0
    assert decontaminate.clean(awkward[1], bench.limit(0)).count() == len(awkward[0])
    assert decontaminate.contaminated(awkward[1], bench).count() == 0


def turns_by_force(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hexed("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()), len(loss), hexed(loss.encode()))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(8)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<|", "|>", "\\", "\n", "ok", "é", "😀", "<", "", "user\n"]
    text = lambda: rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "ass\nistant", "a\\n", "<|im_end|>"]), text()) for c in [*range(30), None] for t in rng.sample(range(9), rng.randrange(1, 6))]
    rows += [(40, 0, "assistant", "x" * 3_000_000), (40, 1, "assistant", "y" * 10), (40, 1, "assistant", "y" * 10), (41, None, "user", "no turn"), (41, 0, "user", "turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("piece", "loss", "formatted")})
    pieces = chat_format.formatted(df)
    out = chat_format.read_back(pieces).collect()
    assert len(out) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:5] for r in out} == turns_by_force(rows)
    whole = {}
    for r in pieces.orderBy("piece").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    assert {r["conv_id"]: r["formatted_chars"] for r in out} == {k: len(v) for k, v in whole.items()}
    for conv, t in whole.items():
        assert t.count("<|im_start|>") == t.count("<|im_end|>\n") == sum(r[0] == conv for r in rows)
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


def test_each_stored_copy_of_a_medium_is_read(spark):
    """Of equal media stored by several tasks, a copy whose own bytes are not what they should be is not verified; the others are."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(3, "doc_id")
    media, store = media_chunks.stored(df)
    copies = [r["docs"] for r in media.filter(F.size("outside") > 0).orderBy("row").collect()]
    assert len(copies) > 1
    last = media.agg(F.max("row")).first()[0]
    for spoilt in (F.concat("inline", F.lit(b"xx")), F.substring("inline", 1, 10)):
        odd = media.withColumn("inline", F.when(F.col("row") == last, spoilt).otherwise(F.col("inline")))
        found = {r.doc_id: r.verified for r in media_chunks.read_media(odd, store).collect()}
        assert found == {d: docs != copies[-1] for docs in copies for d in docs}
