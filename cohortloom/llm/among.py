"""Bit tables of fixed size: rows that may have a partner, found without moving the others.

A table holds one bit per hash value of the keys, so its size never grows with the data. A row whose
bit is unset has no partner; a set bit may be by chance. Large key sets fill the table and it stops
helping, never errs: an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_BITS = 24
ARRAY_BITS = 25


def _words(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (
        keys.filter(key.isNotNull())
        .select(F.shiftright(slot, 6).alias("_word"), F.expr("1L").alias("_one"), slot.alias("_slot"))
        .withColumn("_bit", F.expr("shiftleft(_one, cast(_slot & 63 as int))"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )


def maybe_among(df: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``other`` of ``keys``: all that are, and few more.

    The table has at most 2**18 rows of two integers, so it may be broadcast.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << JOIN_BITS))
    table = _words(keys, other, JOIN_BITS)
    return (
        df.withColumn("_slot", slot)
        .withColumn("_word", F.shiftright("_slot", 6))
        .join(F.broadcast(table), "_word")
        .filter(F.expr("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1L) = 1L"))
        .drop("_slot", "_word", "_bits")
    )


def bit_array(keys: DataFrame, key: str, bits: int = ARRAY_BITS) -> np.ndarray:
    """One bit per value of the low bits of a 64-bit ``key``: 4 MB, whatever the number of keys."""
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        keys.select(F.shiftright(slot, 6).alias("word"), slot.alias("slot"), F.expr("1L").alias("one"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(one, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()  # at most 2**(bits - 6) rows
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def bit_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
