"""Nearest neighbours by a block matrix join on int8 tiles.

Candidates and queries are cut into tiles. In each pair of tiles one product of int8
codes gives every inner product to within a proven error: for x = s*c + e, the true
value differs from the coded one by at most |s_q c_q||e_x| + |e_q||x|. Pairs whose upper
bound falls under the k-th best lower bound are out; the rest are computed again from
the original vectors in double precision, and heaps keep each query's best.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite
component, take no part; vectors meet only vectors of their own length; of equal
vectors the smaller ids come first; a query's own row is no candidate (rows that repeat
its id are its own too); fewer than k candidates give all; only the two named columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a tile, which bound a task's memory: a product holds QUERY_TILE x CANDIDATE_TILE numbers.
QUERY_TILE, CANDIDATE_TILE = 2048, 8192


def usable(vector: F.Column) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, and norms of what they miss."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def tile_pair(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query, its k best (score, -id) among the candidates, best first."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    qc, qs, qn, qe = quantize(q)
    cc, cs, cn, ce = quantize(c)
    # Products of codes are whole numbers; float32 holds them up to 2**24.
    kind = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64
    near = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = qn[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :]
    slack = slack * (1 + 1e-9) + 1e-12 * (qn + qe)[:, None] * (cn + ce)[None, :]
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - slack)
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    keep = (near + slack >= floor[:, None]) & ~own
    best: list[list[tuple[float, int]]] = []
    for i in range(len(q)):
        at = np.flatnonzero(keep[i])
        heap: list[tuple[float, int]] = []
        for j in range(0, len(at), 4096):
            part = at[j : j + 4096]
            score = (c[part] * q[i]).cumsum(axis=1)[:, -1]  # summed in order of the components
            heap = heapq.nlargest(k, [*heap, *zip(score.tolist(), (-c_ids[part]).tolist())])
        best.append(heap)
    return best


def search(vectors: DataFrame, queries: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_tile: int = QUERY_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """(query_id, rank, key, score): the k rows of largest inner product for each row that ``queries`` selects."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))
    asked = rows.where("asked")
    n_query_tiles = asked.groupBy("dim").agg(F.ceil(F.count("*") / query_tile).cast("int").alias("tiles"))
    n_tiles = rows.groupBy("dim").agg(F.ceil(F.count("*") / candidate_tile).cast("int").alias("c_tiles"))
    plan = n_query_tiles.join(n_tiles, "dim")  # one row for each length of vector
    # Tiles hold about equally many rows: a row's tile comes from a hash of its id.
    tile = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")
    c = rows.join(F.broadcast(plan), "dim").withColumn("ct", tile("c_tiles", 1)).withColumn("qt", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    q = asked.join(F.broadcast(plan), "dim").withColumn("qt", tile("tiles", 2)).withColumn("ct", F.explode(F.sequence(F.lit(0), F.col("c_tiles") - 1)))
    c = c.select(*(F.col(x).alias(f"c_{x}") for x in ("dim", "ct", "qt", "id", "v")))
    q = q.select(*(F.col(x).alias(f"q_{x}") for x in ("dim", "ct", "qt", "id", "v")))
    out = "query_id long, id long, score double"

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        def unpack(t: pa.Table, side: str):
            flat = t.column(f"{side}_v").combine_chunks()
            flat = flat.flatten().to_numpy(zero_copy_only=False)
            return t.column(f"{side}_id").to_numpy(), flat.reshape(t.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, q_rows = unpack(left, "q")
        c_ids, c_rows = unpack(right, "c")
        found: list[tuple[int, float, int]] = []
        for at in range(0, len(q_ids), 256):
            part = slice(at, at + 256)
            for qid, best in zip(q_ids[part].tolist(), tile_pair(q_ids[part], q_rows[part], c_ids, c_rows, k)):
                found += [(qid, s, -i) for s, i in best]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "id": pa.array([f[2] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64())})

    best = q.groupBy("q_dim", "q_ct", "q_qt").cogroup(c.groupBy("c_dim", "c_ct", "c_qt")).applyInArrow(pair, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asked: Iterable[int], k: int) -> Iterator[tuple[int, int, int, float]]:
    """The definition, for tests: (query, rank, id, score)."""
    for i in asked:
        score = (x.astype(np.float64) * x[i].astype(np.float64)).cumsum(axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        for r, j in enumerate(order, 1):
            yield int(ids[i]), r, int(ids[j]), float(score[j])
