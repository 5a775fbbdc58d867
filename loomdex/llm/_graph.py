"""Connected components of a link table, with star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm._store import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id that links reach; one row for each id in a link.

    Alternates large-star and small-star steps; each round is two joins on a node id, is
    written to the shared folder, and at least halves long chains; the round before it is
    deleted. No part of the graph is held by one task or the driver. An empty link table
    gives an empty result. The result reads the last round's table, which ``discard`` deletes.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, materialize(small.where("u <> v").distinct())
        discard(last)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._loomdex_path = edges._loomdex_path
    return out


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)
