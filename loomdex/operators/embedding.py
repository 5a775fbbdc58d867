"""Embedding of texts in batches, with failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to vectors, many at a time; it may raise.
Embed = Callable[[list[str]], list[list[float]]]

BATCH, ATTEMPTS = 32, 3
SCHEMA = "hash string, vector array<float>, error string, attempts int"


class DimensionMismatchError(ValueError):
    """A vector of another length than the store's: the model is the wrong one, so the run stops."""


@dataclass(frozen=True)
class Batches:
    """An embedder called on ``size`` texts at a time and tried ``attempts`` times."""

    call: Embed
    dimensions: int
    size: int = BATCH
    attempts: int = ATTEMPTS

    def _checked(self, texts: list[str]) -> list[list[float]]:
        got = self.call(texts)
        if len(got) != len(texts):
            raise ValueError(f"embedding count mismatch: expected {len(texts)}, got {len(got)}")
        for vector in got:
            if len(vector) != self.dimensions:
                raise DimensionMismatchError(f"embedding has {len(vector)} dimensions, not {self.dimensions}")
        return got

    def _tried(self, texts: list[str]) -> tuple[list[list[float]] | None, str | None, int]:
        """(vectors or none, the last error, tries)."""
        error = None
        for k in range(max(1, self.attempts)):
            try:
                return self._checked(texts), None, k + 1
            except DimensionMismatchError:
                raise
            except Exception as failure:
                error = str(failure) or type(failure).__name__
        return None, error, max(1, self.attempts)

    def rows(self, hashes: list[str], texts: list[str]) -> Iterator[tuple]:
        """A row for each text: its vector, or the error that it alone brings about."""
        for at in range(0, len(texts), self.size):
            part, names = texts[at : at + self.size], hashes[at : at + self.size]
            vectors, error, tries = self._tried(part)
            if vectors is not None:
                yield from ((h, v, None, tries) for h, v in zip(names, vectors))
            elif len(part) == 1:
                yield names[0], None, error, tries
            else:  # one text may fail the others of its batch, so each is tried by itself
                for h, t in zip(names, part):
                    alone, error, more = self._tried([t])
                    yield h, None if alone is None else alone[0], error, tries + more


def embed(texts: DataFrame, batches: Batches) -> DataFrame:
    """texts (hash, content) -> (hash, vector, error, attempts): error is null where there is a vector.

    Batches are formed in the tasks that hold the texts. A batch that fails is tried again,
    then text by text. A wrong number of vectors fails a batch; a vector of the wrong length
    stops the run. A null text is embedded as an empty one.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = list(batches.rows(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]))
            if made:
                hashes, vectors, errors, tries = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string()), pa.array(tries, pa.int32())], ["hash", "vector", "error", "attempts"])

    return texts.select("hash", "content").mapInArrow(run, SCHEMA)


def failed_files(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """(filePath, errorMessage, attempts): the files with a chunk (filePath, hash) that could not be embedded, with the error
    of the smallest hash."""
    bad = embedded.where("error is not null").select("hash", "error", "attempts")
    hit = chunks.select("filePath", "hash").distinct().join(bad, "hash")
    return hit.groupBy("filePath").agg(F.min_by("error", "hash").alias("errorMessage"), F.max("attempts").alias("attempts"))
