"""Exact nearest rows without reading all: rows in buckets around pivots, cut off by the triangle inequality.

Vectors are compared on the unit sphere, where the distance of two vectors falls as their
cosine similarity rises. Each row lies in the bucket of its nearest pivot, sorted by its
distance to it. For a query only the pivots are looked at first: a row x of pivot p cannot
be nearer than |d(q, p) - d(x, p)|, so a bucket's least and greatest distance bound all its
rows. Buckets are opened by that bound, nearest first, in rounds of growing size. After
each round the k-th best similarity is the distance that further rows have to beat: buckets
beyond it stay closed, and in those that are opened the sorted distances let Parquet skip
row groups. Rows and order are those of ``search.knn``. Vectors must be finite or null;
zero vectors have similarity 0 and lie in a bucket of their own, with null ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomdex.functions import vectors
from loomdex.operators import search

#: Pivots, rows of the sample they are made of, and passes over it.
PIVOTS, SAMPLE, PASSES = 64, 4096, 6
#: What rounding may take from a distance.
SLACK = 1e-6
#: The bucket of rows without a direction.
NONE = -1


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the rows that have one, their places)."""
    rows = [(i, np.asarray(v, np.float64)) for i, v in enumerate(lists.to_pylist()) if v is not None]
    live = [(i, v, n) for i, v in rows if len(v) and (n := float(np.linalg.norm(v))) > 0]
    if not live:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    return np.stack([v / n for _, v, n in live]), np.array([i for i, _, _ in live])


def choose(sample: np.ndarray, many: int) -> np.ndarray:
    """Pivots of a sample of unit vectors: far apart at first, then moved to the middle of what is nearest to each."""
    if not len(sample):
        return sample
    held = [0]
    away = np.full(len(sample), inf)
    while len(held) < min(many, len(sample)):
        away = np.minimum(away, 1 - sample @ sample[held[-1]])
        if away.max() <= 1e-12:
            break
        held.append(int(away.argmax()))
    pivots = sample[held]
    for _ in range(PASSES):
        nearest = (sample @ pivots.T).argmax(axis=1)
        middle = np.stack([sample[nearest == p].sum(axis=0) if (nearest == p).any() else pivots[p] for p in range(len(pivots))])
        length = np.linalg.norm(middle, axis=1, keepdims=True)
        pivots = np.where(length > 0, middle / np.where(length > 0, length, 1), pivots)
    return pivots


@dataclass
class Report:
    """What a search opened: buckets, and rows that these hold, of all there are."""

    opened: list[int] = field(default_factory=list)
    rows: int = 0
    of_buckets: int = 0
    of_rows: int = 0


@dataclass
class NearIndex:
    rows: DataFrame  # the rows, with __pivot and __away
    columns: list[str]
    pivots: np.ndarray
    #: Rows, least and greatest distance of each pivot's bucket.
    spans: dict[int, tuple[int, float, float]]
    vector: str = "vector"

    def search(self, query: Sequence[float], k: int, where: Column | None = None, ties: Sequence[str] = ("filePath", "id")) -> tuple[DataFrame, Report]:
        """(the k rows of largest cosine similarity, of those that ``where`` lets pass, with score; what was opened)."""
        vectors.check_top_k(k)
        vectors.check_query(query)
        report = Report(of_buckets=len(self.spans), of_rows=sum(n for n, _, _ in self.spans.values()))
        q = np.asarray(query, np.float64)
        length = float(np.linalg.norm(q))
        # Without a direction every row scores 0, so no bucket is farther than another.
        to = np.linalg.norm(self.pivots - q / length, axis=1) if length and len(self.pivots) else np.zeros(len(self.pivots))
        low = {p: sqrt(2) if p == NONE and length else max(0.0, to[p] - far, near - to[p]) if length else 0.0 for p, (_, near, far) in self.spans.items()}
        waiting, limit, most, best = sorted(self.spans, key=lambda p: (low[p], p)), inf, 1, None
        while waiting and low[waiting[0]] <= limit + SLACK:
            here: list[int] = []
            # As many buckets as the k rows need at least, twice as many with each round.
            while waiting and low[waiting[0]] <= limit + SLACK and (len(here) < most or sum(self.spans[p][0] for p in here) < k):
                here.append(waiting.pop(0))
            most *= 2
            report.opened += here
            report.rows += sum(self.spans[p][0] for p in here)
            found = self.rows.where(F.col("__pivot").isin(here))
            if limit < inf:
                bounds = [(F.col("__pivot") == p) & F.col("__away").between(float(to[p]) - limit - SLACK, float(to[p]) + limit + SLACK) for p in here if p != NONE]
                bounds += [F.col("__pivot") == NONE] if NONE in here else []
                either = bounds[0]
                for more in bounds[1:]:
                    either = either | more
                found = found.where(either)
            found = search.knn((found if where is None else found.where(where)).select(*self.columns), query, k, self.vector, ties)
            if best is not None:
                found = found.unionByName(best).orderBy(F.desc("score"), *ties).limit(k)
            got = found.toArrow()  # k rows at most
            best = self.rows.sparkSession.createDataFrame(got, found.schema)
            scores = [s for s in got["score"].to_pylist() if s is not None]
            if len(scores) == k and length:
                limit = sqrt(max(0.0, 2 - 2 * min(scores)))
        if best is None:
            best = search.knn(self.rows.select(*self.columns), query, k, self.vector, ties)
        return best, report


def build(rows: DataFrame, path: str, pivots: int = PIVOTS, sample: int = SAMPLE, vector: str = "vector", key: str = "id") -> NearIndex:
    """Writes rows in buckets around pivots at a folder. The pivots come from at most ``sample`` rows, in order of a hash."""
    spark = rows.sparkSession
    taken = rows.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(sample).select(vector).toArrow()
    units, _ = _units(taken[vector].combine_chunks())
    centres = choose(units, pivots)
    sent = spark.sparkContext.broadcast(centres)
    schema = StructType([*rows.schema.fields, StructField("__pivot", IntegerType()), StructField("__away", DoubleType())])
    names = rows.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            units, at = _units(batch.column(names.index(vector)))
            pivot, away = np.full(batch.num_rows, NONE, np.int32), np.zeros(batch.num_rows)
            if len(at):
                pivot[at] = nearest = (units @ centres.T).argmax(axis=1)
                away[at] = np.linalg.norm(units - centres[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], schema.names)

    # Rebalance keeps a bucket's rows together but splits a bucket that is too large for a task.
    placed = rows.mapInArrow(place, schema).hint("rebalance", "__pivot").sortWithinPartitions("__pivot", "__away")
    placed.write.partitionBy("__pivot").parquet(path)
    held = spark.read.schema(schema).parquet(path)
    spans = held.groupBy("__pivot").agg(F.count("*").alias("n"), F.min("__away").alias("near"), F.max("__away").alias("far")).collect()
    return NearIndex(held, rows.columns, centres, {r["__pivot"]: (r.n, r.near, r.far) for r in spans}, vector)
