"""A Bloom filter of bounded size, to leave most rows without a partner out of a shuffle.

It only ever lets too many rows through: the join that follows decides.  Beyond
MOST_BITS it saturates and the join merely shuffles more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 16, 1 << 27, 12


def _places(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def build(df: DataFrame, key: str, count: int):
    """A broadcast filter over about `count` values of a column of 64-bit hashes; at most 16 MB, summed up on the executors."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_KEY * count):
        bits *= 2
    place = df.select(F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    word = place.select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = word.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bit"))
    return df.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def hits(shared, hashes: np.ndarray) -> np.ndarray:
    words = shared.value
    h, bits = hashes.view(np.uint64), np.uint64(len(words) * 64 - 1)
    out = np.ones(len(h), bool)
    for at in (h & bits, (h >> np.uint64(32)) & bits):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
