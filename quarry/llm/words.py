"""Words of whole texts as 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from quarry.llm.common import utf8

U = np.uint64
#: Bytes that are hashed at once, so that a very long text needs no more memory than others.
BLOCK = 1 << 18
#: Odd multipliers of the two families of hashes, and of the words in a run.
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
STEPS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


def _blocks(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words of about BLOCK bytes each; none is empty, wherever in the last word a block would end."""
    if not len(starts):
        return []
    cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], ends[-1], BLOCK)))
    cuts = [0, *cuts[(cuts > 0) & (cuts < len(starts))].tolist(), len(starts)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column of texts; nulls have none.

    starts, ends: where each word is in raw, the texts' bytes. of: n + 1 places in them, where each text's words begin.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, at = utf8(column)
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.raw, self.at = raw, at
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = at[1:-1][at[1:-1] < len(raw)] if len(at) > 2 else at[:0]
        begins[inner] |= word[inner]
        stops = np.zeros(len(raw) + 1, bool)
        stops[1:] = word
        stops[1:-1] &= ~word[1:]
        stops[inner[inner > 0]] |= word[inner[inner > 0] - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops)
        self.of = np.searchsorted(self.starts, at)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A hash for each word."""
        base, out = int(BASES[family]), np.zeros(len(self.starts), U)
        for a, b in _blocks(self.starts, self.ends):
            size = self.ends[a:b] - self.starts[a:b]
            first = np.cumsum(size) - size
            within = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            bytes_ = self.raw[np.repeat(self.starts[a:b], size) + within].astype(U) + U(1)
            bytes_ *= powers(base, 1 << max(6, int(size.max()).bit_length()))[within]
            out[a:b] = mixed(np.add.reduceat(bytes_, first) + size.astype(U) * BASES[1 - family])
        return out


def runs(hashes: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """A hash for each run of n consecutive words, by where it starts; runs over two texts' border are of no use."""
    if len(hashes) < n:
        return np.zeros(0, U)
    weight = powers(int(STEPS[family]), n)
    if n <= 8:
        total = np.zeros(len(hashes) - n + 1, U)
        for k in range(n):
            total += hashes[k : len(hashes) - n + 1 + k] * weight[k]
        return mixed(total + U(n))
    # Twice the run each time: the run of 2k words is two of k words; the bits of n say which runs make up n words.
    total, done, power, size = None, 0, hashes, 1
    while size <= n:
        if n & size:
            part = power[done : len(hashes) - n + 1 + done]
            total = part * weight[done] if total is None else total + part * weight[done]
            done += size
        if 2 * size <= n:
            power = power[: len(power) - size] + power[size:] * weight[size]
        size *= 2
    return mixed(total + U(n))
