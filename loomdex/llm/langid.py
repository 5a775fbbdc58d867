"""Language identification with bit-sliced Bloom filters of character n-grams.

For each learned language, the n-grams whose share among its n-grams reaches
``MIN_SHARE`` enter a Bloom filter. The filters of all languages lie side by side: a
slot is a bit mask of languages, so the AND of an n-gram's few slots names every
language that holds it. A text's language is the one with most hits after the hits
expected by false positives are taken off.

Defined cases: a text that is null or has no letter is ``und``; hits that tie go to the
language with more training n-grams, then to the smaller name; rows whose language is
null teach nothing; with nothing learned every text is ``und``; repeated rows count as
often as they occur; only the named columns are read; an empty table gives an empty
result. Very long texts are read whole, in slices.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm._words import column, mix, slices

N, HASHES, SLOTS_PER_GRAM = 4, 3, 16
#: The share that puts an n-gram into a language's filter, which bounds a filter to 1 / MIN_SHARE n-grams.
MIN_SHARE = 1e-4
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of lower-cased letters and word gaps, and whether each row has a letter."""
    parts = [" " + t.lower() + " " if t else "" for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(parts)), sizes)
    is_letter = letter_table()[points]
    has = np.zeros(len(parts), bool)
    has[row[is_letter]] = True
    # Runs of other characters shrink to one gap.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
    if len(keep):
        keep[0] = True
    keep[1:] |= row[1:] != row[:-1]
    p = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    row = row[keep]
    m = len(p) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(m, np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + p[k : k + m]
    same = row[:m] == row[N - 1 :]
    return mix(h[same]), row[:m][same], has


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # slots x ceil(languages / 64)
    false_rate: np.ndarray
    weight: np.ndarray  # training n-grams of each language

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Slots by double hashing."""
        size = np.uint64(len(self.table) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & size).astype(np.int64)

    def hits(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (rows x languages) and n-grams of each row."""
        count = np.bincount(row, minlength=n).astype(np.float64)
        out = np.zeros((n, len(self.languages)))
        mask = None
        for at in self.slots(h):
            got = self.table[at]
            mask = got if mask is None else mask & got
        for i in range(len(self.languages)):
            bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            seen = np.bincount(row[bit == 1], minlength=n)
            out[:, i] = np.maximum(seen - count * self.false_rate[i], 0) / (1 - self.false_rate[i])
        return out, count


def build(languages: list[str], members: list[np.ndarray], weight: list[float]) -> Filters:
    """Filters from each language's n-gram hashes, sized by the largest."""
    most = max([len(m) for m in members], default=1)
    size = 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())
    out = Filters(languages, np.zeros((size, (len(languages) + 63) // 64), np.uint64), np.zeros(len(languages)), np.array(weight))
    for i, m in enumerate(members):
        for at in out.slots(m):
            np.bitwise_or.at(out.table[:, i // 64], at, np.uint64(1 << (i % 64)))
        filled = ((out.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        out.false_rate[i] = min(filled**HASHES, 0.99)
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> Filters:
    """Counts the n-grams of every whole text of a known language and keeps each language's frequent ones."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # language codes, hashes, counts
        names: dict[str, int] = {}

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            code, h, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((h, code))
            code, h, n = code[order], h[order], n[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (code[1:] != code[:-1])
            at = np.flatnonzero(new)
            return code[at], h[at], np.add.reduceat(n, at)

        def batch() -> Iterator[pa.RecordBatch]:
            if held:
                code, h, n = merged()
                by = list(names)
                held.clear()
                for at in range(0, len(h), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([by[c] for c in code[cut].tolist()], pa.string()), pa.array(h[cut].view(np.int64)), pa.array(n[cut])], ["lang", "gram", "n"])

        for part in slices(batches, text):
            langs = column(part, lang).to_pylist()
            h, row, _ = grams(column(part, text).to_pylist())
            codes = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            if len(h):
                key = codes[row]
                held.append((key, h, np.ones(len(h), np.int64)))
                held[:] = [merged()]
            if held and len(held[0][1]) > 1_000_000:
                yield from batch()
        yield from batch()

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).alias("__lang"))
    lang = "__lang"
    counts = known.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from loomdex.llm._store import materialize

    counts = materialize(counts)
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        return build([], [], [])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, float(total[k]))])
    top = counts.where(F.col("n") >= min_share * share[F.col("lang")]).select("lang", "gram").toPandas()
    members = [top.gram[top.lang == k].to_numpy().astype(np.int64).view(np.uint64) for k in languages]
    return build(languages, members, [float(total[k]) for k in languages])


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): score is the winner's part of all corrected hits."""
    packed = pickle.dumps(filters)
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    name = hashlib.sha1(packed).hexdigest()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _once(name, lambda: pickle.loads(sent.value))
        for part in slices(batches, text):
            h, row, has = grams(column(part, text).to_pylist())
            n = part.num_rows
            if f.languages:
                hits, _ = f.hits(h, row, n)
                # Ties by training size; argmax takes the first, that is the smaller name.
                best = (hits + 1e-9 * f.weight / max(f.weight.max(), 1)).argmax(axis=1)
                score = np.divide(hits[np.arange(n), best], hits.sum(axis=1), out=np.zeros(n), where=hits.sum(axis=1) > 0)
                pred = [f.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist())]
            else:
                pred, score = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([column(part, key), pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


_made: dict[str, object] = {}


def _once(name: str, make):
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]
