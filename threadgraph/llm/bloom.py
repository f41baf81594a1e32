"""Bloom filter of fixed size, filled by Spark and handed to tasks.

It only spares rows that cannot match a later exact join: when more keys are added than it
was made for, more rows pass and the result stays the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def build(keys: DataFrame, column: str, bits: int = BITS):
    """Broadcast bitmap (at most ``bits`` / 8 bytes) of a column of 64-bit hashes; two bits a key."""
    k = F.col(column)
    at = F.explode(F.array(k.bitwiseAND(bits - 1), F.shiftrightunsigned(k, 32).bitwiseAND(bits - 1)))
    words = keys.select(at.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v"))
    got = words.toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each unsigned 64-bit key whether the filter may hold it."""
    mask = np.uint64(len(bitmap) * 32 - 1)
    ok = np.ones(len(keys), bool)
    for b in (keys & mask, (keys >> np.uint64(32)) & mask):
        ok &= (bitmap[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return ok


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit sums (the finaliser of a public hash function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
