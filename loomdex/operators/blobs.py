"""Blobs by the hash of their content, as a table (hash, size, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.hashing import sha256_hex

SCHEMA = "hash string, size bigint, content binary"


def put(blobs: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """The table with new contents; what it has already is not stored again."""
    data = F.col(content).cast("binary")
    new = contents.where(F.col(content).isNotNull()).select(sha256_hex(data).alias("hash"), F.octet_length(data).cast("long").alias("size"), data.alias("content")).dropDuplicates(["hash"])
    return blobs.unionByName(new.join(blobs.select("hash"), "hash", "left_anti").select(*blobs.columns))


def get(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (hash) with size and content, null for what is not there."""
    return wanted.join(blobs, "hash", "left")


def exists(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(blobs.select("hash", F.lit(True).alias("__there")), "hash", "left").select("hash", F.coalesce("__there", F.lit(False)).alias("found"))


def delete(blobs: DataFrame, unwanted: DataFrame) -> DataFrame:
    return blobs.join(unwanted.select("hash"), "hash", "left_anti")


def collect_garbage(blobs: DataFrame, used: DataFrame) -> DataFrame:
    """Only the blobs that some row of used (hash) names."""
    return blobs.join(used.select("hash").distinct(), "hash", "left_semi")
