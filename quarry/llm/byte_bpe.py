"""Byte-level BPE encoding and decoding.

The bytes of a piece of text are mapped to Latin-1 characters, so that a pyahocorasick trie over the vocabulary finds
the longest token at any position. The encoder takes the longest match, checks that it is compatible with the token
before it (undoing both tokens' merges must never show a merge that BPE would have done earlier), else tries the
next shorter token, else steps back. Compatibility of adjacent tokens is memoised, and a position from which no
encoding follows is marked, so every position is left at most once for each of its tokens: time is linear in the text.
The result is exactly what doing the merges in order of rank gives.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """An encoder and decoder for a rank file of 'base64-token rank' lines and a pattern that cuts a text into pieces.

    `pieces` bounds the memo of encoded pieces, `pairs` that of adjacent-token compatibility; a full memo is emptied.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = 600_000, pairs: int = 1_000_000):
        self.rank, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces, self.pairs = pieces, pairs
        self.trie = ahocorasick.Automaton()
        for token, r in ranks.items():
            self.trie.add_word(token.decode("latin-1"), r)
        self.length = {r: len(t) for t, r in ranks.items()}
        #: The longest vocabulary token that is a proper prefix of a token.
        self.shorter = {r: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t, r in ranks.items()}
        #: The two tokens whose merge makes a token; None for single bytes and for tokens that no merge makes.
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            two = self.merged(token, r) if len(token) > 1 else []
            self.parts[r] = (two[0], two[1]) if len(two) == 2 else None
            if self.parts[r]:
                self.merge[self.parts[r]] = r
        #: Tokens that the merges can't make are never a result.
        self.made = {r for r, p in self.parts.items() if p or self.length[r] == 1}

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain BPE with a heap of merges by rank; only ranks under `below` if given."""
        if not piece:
            return []
        part = [bytes([b]) for b in piece]
        right, left = list(range(1, len(part))) + [-1], list(range(-1, len(part) - 1))
        limit = len(self.rank) + 10**9 if below is None else below
        heap = [(r, i, part[i] + part[i + 1]) for i in range(len(part) - 1) if (r := self.rank.get(part[i] + part[i + 1], limit)) < limit]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != whole:
                continue
            part[i], part[j], right[i] = whole, None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get(part[a] + part[b], limit)) < limit:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        return [self.rank[p] for p in part if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE can leave token a before token b.

        Both tokens' last merges are undone in falling order of rank, at the border only. If at some moment the two
        tokens at the border would merge with a rank under that of the merges undone so far, BPE had merged them.
        """
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= self.pairs:
                self.compatible.clear()
            known = self.compatible[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        none = 1 << 60
        # A merge on the left of equal rank comes first, so b's own merge counts as later than an equal one at the border.
        bound = none
        while True:
            r = self.merge.get((a, b))
            if r is not None and r < bound:
                return False
            up, vp = self.parts[a], self.parts[b]
            if up is None and vp is None:
                return True
            if vp is None or (up is not None and a > b):
                bound, a = a, up[1]
            else:
                bound, b = b + 1, vp[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece, by backtracking from longest matches."""
        chars = piece.decode("latin-1")
        size, longest = len(chars), self.trie.longest_prefix
        dead = bytearray(size + 1)
        out: list[int] = []
        at = 0
        token = self._longest(chars, 0, longest) if size else None
        while at < size:
            last = out[-1] if out else None
            while token is not None:
                end = at + self.length[token]
                if not dead[end] and token in self.made and (last is None or self.fits(last, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = self._longest(chars, at, longest) if at < size else None
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                back = out.pop()
                at -= self.length[back]
                token = self.shorter[back]
        return out

    def _longest(self, chars: str, at: int, longest) -> int | None:
        window = chars[at : at + self.widest]
        n = longest(window)
        # The trie's longest path may end inside a longer token; go back to a whole one.
        while n and (r := self.rank.get(window[:n].encode("latin-1"))) is None:
            n -= 1
        return r if n else None

    @property
    def widest(self) -> int:
        got = self.__dict__.get("_widest")
        if got is None:
            got = self.__dict__["_widest"] = max(self.length.values())
        return got

    def packed(self, piece: str) -> bytes:
        """A piece's ids as little-endian unsigned 32-bit integers, memoised."""
        got = self.memo.get(piece)
        if got is None:
            if len(self.memo) >= self.pieces:
                self.memo.clear()
            got = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= 64:
                self.memo[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed; special tokens' strings are ordinary text."""
        get, packed = self.memo.get, self.packed
        return b"".join([get(p) or packed(p) for p in self.pattern.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file, once in a Python worker."""
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; a map over rows without a shuffle, so a lost executor only repeats its rows.

    Returns id_col, n_tokens, ids_sha256 and decoded_sha256, with keep_ids also `ids`, the packed ids as binary. Null and
    empty texts have no tokens and the digests of nothing. Repeated rows give repeated rows; other columns are not read.
    The vocabulary (public_vocabulary() unless given) must be at `path` on each worker.
    """
    if path is None or pattern is None:
        path, pattern = public_vocabulary()
    small_batches(docs.sparkSession)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash, ids = [], [], [], []
            for text in texts(batch.column(1)):
                packed = bpe.encode(text)
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
                if keep_ids:
                    ids.append(packed)
            columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all documents."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
