"""Vector expressions: similarity, checks, and the deterministic embedding of tests and examples."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a literal query, whose norm is taken once on the driver; 0 where a norm is 0."""
    q = [float(x) for x in query]
    check_query(q)
    length = math.sqrt(math.fsum(x * x for x in q))
    v = doubles(v)
    n = norm(v)
    return F.when((n == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(dot(v, F.array(*[F.lit(x) for x in q])) / (n * F.lit(length)))


def cosine_arrow(query: Sequence[float]):
    """The same as an Arrow function: one matrix product a batch, for long vectors."""
    q = np.asarray(query, np.float64)
    length = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(s):
                yield pd.Series([], dtype="float64")
                continue
            known = s.notna().to_numpy()
            out = np.full(len(s), np.nan)
            if known.any():
                x = np.stack(s.to_numpy()[known]).astype(np.float64)
                n = np.linalg.norm(x, axis=1) * length
                out[known] = np.divide(x @ q, n, out=np.zeros(len(x)), where=n > 0)
            yield pd.Series(out).astype("Float64").mask(~known)

    return score


def check_query(q: Sequence[float], dimensions: int | None = None) -> None:
    if dimensions is not None and len(q) != dimensions:
        raise ValueError(f"query vector has {len(q)} dimensions, the store has {dimensions}")
    if not q or not all(math.isfinite(x) for x in q):
        raise ValueError("query vector must be finite and not empty")


def check_top_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("topK must be a positive whole number")
    return k


def finite(v: Column) -> Column:
    return F.coalesce(F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def or_zero(v: Column, dimensions: int) -> Column:
    """The vector, or zeros where it is null, of another length, or not finite."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return F.when(finite(v) & (F.size(v) == dimensions), v.cast("array<float>")).otherwise(zeros)


def embed_sha256(text: Column, dimensions: int = 64) -> Column:
    """Component i is byte i mod 32 of the text's SHA-256, over 255."""
    # The digest stands outside the inner lambda, so it is taken once a text and not once a component.
    byte = lambda digest, i: F.conv(F.substring(digest, F.lit(2 * (i % 32) + 1), F.lit(2)), 16, 10).cast("double")
    made = F.transform(F.array(F.sha2(text.cast("binary"), 256)), lambda digest: F.array(*[byte(digest, i) / 255 for i in range(min(dimensions, 32))]))[0]
    if dimensions <= 32:
        return made
    whole = F.flatten(F.array_repeat(made, -(-dimensions // 32)))
    return whole if dimensions % 32 == 0 else F.slice(whole, 1, dimensions)


def embed_query(text: str, dimensions: int = 64) -> list[float]:
    digest = hashlib.sha256(text.encode()).digest()
    return [digest[i % 32] / 255 for i in range(dimensions)]


def one_hot(text: Column, dimensions: int) -> Column:
    """1 at the first character's code modulo the length."""
    at = F.pmod(F.ascii(text), F.lit(dimensions))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(i == at, F.lit(1.0)).otherwise(F.lit(0.0)))
