"""Line search that skips files: a signature of each file's trigrams, and the trigrams that a match cannot lack.

A signature is a bit set of a file's ASCII trigrams (of the lower-case text), sized by how
many distinct ones there are, with two bits each; it can hold a trigram too many but none
too few. A literal, or the literal stretches that a pattern cannot do without, give the
trigrams that a file must have; lines of the other files need not be read or split. What
is left is searched as ``search.grep`` does, so results are the same. A pattern without
such a stretch of three characters reads all files. Signatures must be of the contents
that are searched.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import globs
from loomdex.operators import chunking, search

#: A trigram is a number below 2**21; bits of a signature, and how many for each distinct trigram at least.
CODES, LEAST, PER = 1 << 21, 256, 8
#: Odd factors that spread a trigram's two bits.
FACTORS = (0x9E3779B1, 0x85EBCA77)
#: Trigrams that a search asks for at most; fewer conditions let more files through and lose none.
ASKED = 16
#: Escapes that the JVM's patterns read in another way than Python's parser, which finds the stretches.
_OTHER = re.compile(r"\\[cvNRXQEGhHVkxu0]|\(\?[a-zA-Z-]*[xu]")


def _spots(codes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each trigram."""
    return np.concatenate([(codes.astype(np.uint64) * np.uint64(f) >> np.uint64(11)) & np.uint64(bits - 1) for f in FACTORS])


def signature(text: bytes) -> np.ndarray:
    """The words of 64 bits of a lower-case text's trigrams."""
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    codes = np.zeros(0, np.int64)
    if len(b) >= 3:
        plain = b < 0x80
        codes = np.unique((b[:-2] << 14 | b[1:-1] << 7 | b[2:])[plain[:-2] & plain[1:-1] & plain[2:]])
    bits = min(CODES, max(LEAST, 1 << (PER * len(codes)).bit_length()))
    held = np.zeros(bits, bool)
    held[_spots(codes, bits)] = True
    return np.packbits(held, bitorder="little").view(np.int64)


def signatures(files: DataFrame, path: str = "filePath", content: str = "content") -> DataFrame:
    """(filePath, signature array<long>) of every file; a null content has no trigrams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature((t.as_py() or "").encode()) for t in batch.column(1)]
            if made:
                ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], ["filePath", "signature"])

    return files.select(F.col(path).alias("filePath"), F.lower(content).alias("content")).mapInArrow(run, "filePath string, signature array<long>")


def _runs(parsed) -> list[str]:
    """Literal stretches that every match of a parsed pattern holds."""
    out: list[str] = []
    now = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            now += chr(value)
            continue
        out, now = [*out, now], ""
        if name == "SUBPATTERN":
            out += _runs(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            out += _runs(value[2])
        elif name == "ATOMIC_GROUP":
            out += _runs(value)
    return [r for r in (*out, now) if r]


def _codes(stretch: str) -> list[int]:
    low = [ord(c) for c in "".join(c.lower() if c.isascii() else c for c in stretch)]
    return [a << 14 | b << 7 | c for a, b, c in zip(low, low[1:], low[2:]) if max(a, b, c) < 0x80]


def required(pattern: str, fixed: bool = False) -> list[int]:
    """Trigrams that a file with a match must have; none if that cannot be told."""
    if fixed:
        stretches = [pattern]
    else:
        if _OTHER.search(pattern):
            return []
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("error")
                stretches = _runs(re._parser.parse(pattern))
        except Exception:  # what Python's parser does not know may still be a pattern of the JVM
            return []
    return sorted(set().union(*map(_codes, stretches)))[:ASKED] if stretches else []


def may_match(held: Column, codes: Iterable[int]) -> Column:
    """Whether a signature has all the trigrams."""
    out = F.lit(True)
    mask = (F.size(held) * 64 - 1).cast("long")
    for code in codes:
        for f in FACTORS:
            spread = (code * f >> 11) & (CODES - 1)
            word = F.get(held, F.shiftright(F.lit(spread).cast("long").bitwiseAND(mask), 6).cast("int"))
            out = out & (F.shiftrightunsigned(word, spread & 63).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out


def candidates(signed: DataFrame, pattern: str, patterns: Iterable[str] | None = None, fixed: bool = False) -> DataFrame:
    """(filePath): the files (filePath, signature) whose lines have to be searched."""
    codes = required(pattern, fixed)
    return signed.where(globs.glob_filter(F.col("filePath"), patterns) & may_match(F.col("signature"), codes)).select("filePath")


def grep(files: DataFrame, signed: DataFrame, pattern: str, patterns: Iterable[str] | None = None, case_sensitive: bool = False, max_results: int = search.MAX_RESULTS, fixed: bool = False) -> DataFrame:
    """As ``search.grep`` over the files' lines, but only files that may match are split into lines."""
    patterns = list(patterns) if patterns is not None else None
    wanted = files.join(candidates(signed, pattern, patterns, fixed), "filePath", "left_semi")
    return search.grep(chunking.explode_lines(wanted), pattern, patterns, case_sensitive, max_results, fixed)
