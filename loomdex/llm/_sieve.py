"""Fixed-size bit filters that keep most unwanted rows out of a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, whatever the tables' sizes: at most 16,384 rows of 64 are broadcast, or 2 MB as an array. A full
#: filter lets every row pass; it drops no wanted row.
BITS, ARRAY_BITS = 1 << 20, 1 << 24


def _bits(spots: DataFrame, size: int) -> DataFrame:
    """(w, bits): the words of the filter that hold a bit; spots: a column of hashes, or nulls."""
    spot = F.col(spots.columns[0])
    bit = F.pmod(spot, F.lit(size))
    return spots.where(spot.isNotNull()).select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))


def sieve(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` (no null) may occur in ``wanted``; all that do occur are among them."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    words = _bits(wanted.where(F.col(column).isNotNull()).select(F.xxhash64(column)), BITS).withColumnsRenamed({"w": "__w", "bits": "__held"})
    spots = rows.withColumn("__w", F.floor(bit / 64).cast("int")).withColumn("__bit", (bit % 64).cast("int"))
    return spots.join(F.broadcast(words), "__w").where(F.expr("shiftrightunsigned(__held, __bit) & 1 = 1")).select(*rows.columns)


def bitmap(spots: DataFrame) -> np.ndarray:
    """The filter of a column of hashes as an array of 64-bit words, for workers."""
    rows = _bits(spots, ARRAY_BITS).toArrow()
    words = np.zeros(ARRAY_BITS // 64, np.uint64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def marked(words: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether the filter has each hash."""
    bit = np.mod(spots, ARRAY_BITS)
    return (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
