"""A set of 64-bit hashes as a table of bits, small enough to be sent to all tasks.

A hash that was put in is always found; another one may be found too, about once in
16 times, more often where the table has reached its bound.  So it only spares work:
whoever uses it confirms what it lets through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28  # 32 MB


class BitTable:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bit_table(hashes: DataFrame, column: Column | str, most: int = MAX_BITS) -> BitTable:
    """Table of a long ``column`` of ``hashes`` (read twice: to count and to fill), of 16
    bits per row, ``most`` at the most.  The driver sees one number per 64 bits."""
    size = min(most, 1 << max(16, int(np.ceil(np.log2(16 * max(1, hashes.count()))))))
    at = hashes.select((F.col(column) if isinstance(column, str) else column).bitwiseAND(F.lit(size - 1)).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[got["cell"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return BitTable(bits)
