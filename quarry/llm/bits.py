"""Bitmaps of sets of 64-bit hashes: of bounded size, with two bits a hash, so that what is in the set always passes and little else does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most binary digits of a bitmap's size (2 ** 27 bits are 16 MB), and the bits that an element gets up to that.
MAX_BITS, EACH = 27, 256


def size_for(count: int, most: int = MAX_BITS) -> int:
    """The bits of a bitmap for so many hashes, a power of two."""
    return 1 << min(most, max(16, (EACH * count).bit_length()))


def bitmap(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """The bitmap of a column of hashes: bits / 8 bytes on the driver, whatever the number of hashes."""
    h, mask = F.col(col), F.lit(bits - 1)
    at = F.explode(F.array(h.bitwiseAND(mask) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(mask) + 1))
    places = hashes.select(at.alias("at"))
    parts = places.select(F.bitmap_bucket_number("at").alias("k"), F.bitmap_bit_position("at").alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(bytes(r["b"]), np.uint8)
        begin = (r["k"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out


def passes(bitmap_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash (unsigned) are set."""
    mask = np.uint64(8 * len(bitmap_) - 1)
    out = np.ones(len(hashes), bool)
    for shift in (np.uint64(0), np.uint64(32)):
        at = (hashes >> shift) & mask
        out &= (bitmap_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
