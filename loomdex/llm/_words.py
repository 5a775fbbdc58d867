"""Vectorised word handling over Arrow string columns.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text; everything works on
the UTF-8 buffer of a whole Arrow slice at once, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``most`` bytes of text each; a longer text is a run of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words of a run of rows: byte ranges, and for each row the range of its words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # n + 1 pointers into starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * up[1:], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _MULT)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def words(column: pa.Array, lower: bool = True) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(h: np.ndarray, rows: np.ndarray, size: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size``-word windows: (hash, row, first word). With whole_if_short a row of fewer words gives its whole sequence."""
    n = len(h)
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - rows[:-1][row_of]
    full = place + size <= counts[row_of]
    out = np.zeros(n, np.uint64)
    m = n - size + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for k in range(size):
            acc = mix(acc * _MULT + h[k : k + m])
        out[:m] = acc
    at = np.flatnonzero(full)
    got, owner, first = out[at], row_of[at], at
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                live = counts[short] > k
                step = mix(extra[live] * _MULT + h[rows[:-1][short[live]] + k])
                extra[live] = step
            extra = mix(extra + counts[short].astype(np.uint64))
            got, owner, first = np.concatenate([got, extra]), np.concatenate([owner, short]), np.concatenate([first, rows[:-1][short]])
    return got, owner, first


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
