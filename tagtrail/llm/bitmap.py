"""Bitmaps of fixed size that tell which hashes cannot occur on the other side of a join.

A bitmap only spares work: what it lets through is joined exactly afterwards. Its size does not follow the data; a
table that is too large for it lets more rows through and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 23


def bitmap(hashes: DataFrame, column: str | Column, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits with the bit of each hash set; ORed in Spark, at most 2**(bits - 6) rows reach the driver."""
    bit = F.shiftrightunsigned(F.col(column) if isinstance(column, str) else column, 64 - bits)
    words = (
        hashes.select(F.shiftright(bit, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("set"))
        .groupBy("word").agg(F.bit_or("set").alias("set"))
    ).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    words = words.filter(words["word"].is_valid())
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each unsigned 64-bit hash whether its bit is set."""
    bits = (len(words).bit_length() - 1) + 6
    at = hashes >> np.uint64(64 - bits)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
