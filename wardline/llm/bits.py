"""A bit filter of bounded size: says "surely not in the set" where data lie, before anything is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 27  # powers of two of the number of bits; the largest filter has 16 MB


class BitFilter:
    """Bits of two places of each 64-bit hash. What it lets through wrongly only costs work.

    There are 16 bits for each of ``n`` hashes, but never more than ``2 ** MOST``. Over more hashes it lets more
    through, so callers must do the exact work on all that passes.
    """

    def __init__(self, hashes: DataFrame, n: int):
        """``hashes`` has one long column."""
        self.power = min(MOST, max(LEAST, (16 * max(1, n)).bit_length()))
        mask, h = (1 << self.power) - 1, F.col(hashes.columns[0])
        bits = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("bit"))
        words = bits.select(F.shiftright("bit", 5).alias("cell"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("w"))
        cells = np.zeros(1 << (self.power - 5), np.uint32)
        held = words.groupBy("cell").agg(F.bit_or("w").alias("w")).toArrow()  # at most 2 ** (MOST - 5) rows of two longs
        cells[held.column("cell").to_numpy()] = held.column("w").to_numpy().astype(np.uint32)
        self.cells = hashes.sparkSession.sparkContext.broadcast(cells)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash (signed or not) may be in the set."""
        cells, h = self.cells.value, hashes.astype(np.uint64, copy=False) if hashes.dtype == np.uint64 else hashes.view(np.uint64)
        mask, out = np.uint64((1 << self.power) - 1), np.ones(len(h), bool)
        for bit in (h & mask, (h >> np.uint64(32)) & mask):
            out &= (cells[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return out
