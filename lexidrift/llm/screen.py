"""A screen of fixed size: a bit for each remainder of the keys, built inside the JVM and collected in blocks.

It lets every key through that it was built from, and some others; what it lets through
is joined exactly afterwards, so its size decides on speed alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and most bits of a screen: 32 MB at most reach the driver and the executors.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Bits of one block of the JVM's bitmaps.
_BLOCK = 1 << 15


def bits_for(keys: int) -> int:
    """A power of two of at least `BITS_A_KEY` bits a key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(keys, 1) - 1).bit_length()))


def screen(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bits of the long `column`, eight a byte; one row of 4 KB for each 32,768 bits is collected."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    blocks = keys.select(F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(1, bits // _BLOCK) * (_BLOCK // 8), dtype=np.uint8)
    for row in blocks.collect():
        at_byte = (row["block"] - 1) * (_BLOCK // 8)
        out[at_byte : at_byte + _BLOCK // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the screen lets through."""
    at = (keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
