"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame expressions only.

Every shard bids for every key: a uniform draw from hash(key, shard) turned into
-ln(draw) / weight, and the smallest bid wins. Key, shard names and weights decide
alone, so a new shard takes only the keys it now wins and no key moves between old ones.

Defined cases: a null key is a key of its own; a null text has no bytes (size 1);
repeated rows follow their key into one shard and get slots of their own; only the named
columns are read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm._store import materialize

#: Parts in which the rows of a shard are numbered side by side; raise it with the input.
SLOT_PARTS = 1024


def bid(key: F.Column, shard: int, weight: float = 1.0) -> F.Column:
    h = F.xxhash64(key, F.lit(shard), key.isNull())
    draw = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(draw) / F.lit(float(weight))


def shard_of(key: F.Column, weights: Sequence[float]) -> F.Column:
    """The winning shard's number; ties, which 53 bits make rare, go to the smaller number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    bids = [F.struct(bid(key, i, w).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8, added_weight: float = 1.0, parts: int = SLOT_PARTS) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every record.

    slot numbers a shard's records from 0 without gaps. They are numbered in many parts
    of each shard at once; a part's rows are spread by hash and by place in the input, so
    no key fills one, and counts of the parts, one row each, give where a part begins.
    """
    k = F.col(key)
    slim = docs.select(
        k,
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(k, weights).alias("shard"),
        shard_of(k, [*weights, added_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64(k, F.pmod(F.monotonically_increasing_id(), F.lit(64))), F.lit(parts)).cast("int").alias("__part"),
    )
    slim = materialize(slim)
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("shard", "__part").agg(F.count("*").alias("__n")).select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__part").orderBy(key, "text_crc32", "size")
    numbered = slim.withColumn("__i", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "__part"]).select(key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__i")).cast("long").alias("slot"), "grown_shard")
