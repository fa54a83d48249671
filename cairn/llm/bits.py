"""A set of 64-bit keys of a fixed size, whatever the number of keys: for leaving out most of what a join would not match before it is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the set, a power of two: 2 MB. More keys than slots make it useless, never wrong.
BITS = 1 << 24


def bit_set(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The slots that the keys (one bigint column) fall into. Made by the executors; bits / 64 numbers at most come to the driver."""
    slot = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(bits)).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) AS int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the set: true for all that are."""
    slot = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
