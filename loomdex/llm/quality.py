"""Quality rules: statistics of whole texts, and a learned decision list over them.

Sequential covering on labelled statistics: a rule is grown one threshold at a time by
information gain on two thirds of the rows that are still uncovered, pruned on all of
them, and kept while it is precise enough; the rows it covers are set aside. The list
becomes one ordered CASE expression that Spark evaluates.

Defined cases: a null or empty text has all statistics 0; rows with equal ids share
their label; labels that are null are ignored, and with none of one class the list is
empty (nothing is rejected beyond the base rules); only the named columns are read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm._words import SPACE, column, slices, windows, words
from loomdex.llm._worker import release

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_letters", "n_punct", "n_distinct_words", "n_chars")
#: Labelled documents that the list is learned from, a bounded sample by hash of the id.
TRAINING_ROWS = 20_000

_START = np.ones(256, bool)
_START[0x80:0xC0] = False  # bytes that continue a character
_SYMBOL, _UPPER, _DIGIT, _LETTER, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3] = True  # two-byte Latin letters
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if not len(h):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return np.bincount(o[new], minlength=n)


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of an Arrow string column."""
    w = words(texts, lower=False)
    n, data, offsets = len(w.rows) - 1, w.data, w.offsets
    h, row_of = w.hashes(), w.row_of()

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    start = _START[data]
    out = {"n_words": w.counts, "word_chars": per_row(start & ~SPACE[data]), "n_symbols": per_row(_SYMBOL[data])}
    # Lines: cut at \n and at the ends of texts; a line's hash covers all of its bytes.
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_row = np.searchsorted(offsets, begin, "right") - 1
    text_end = np.searchsorted(offsets[:-1], begin, "right")
    # A break at a text's last byte starts an empty line that belongs to that text; it has no words, so it never counts.
    end = np.minimum(np.concatenate([begin[1:], [len(data)]]), offsets[np.minimum(text_end, n)]) if n else begin
    has_word = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, line_row = begin[has_word], end[has_word], line_row[has_word]
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if len(end) else end
    line_hash = _spans(data, begin, end)
    n_lines = np.bincount(line_row, minlength=n) if n else np.zeros(0, np.int64)
    out["n_dup_lines"] = n_lines - _distinct(line_row, line_hash, n)
    out["n_repeat_words"] = _repeats(h, w.rows, n)
    out["n_lines"] = n_lines
    for name, flags in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_letters", _LETTER), ("n_punct", _PUNCT)):
        out[name] = per_row(flags[data])
    out["n_distinct_words"] = _distinct(row_of, h, n)
    out["n_chars"] = per_row(start)
    return out


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    from loomdex.llm._words import Words

    return Words(data, np.array([0, len(data)]), begin, end, np.array([0, len(begin)])).hashes()


def _repeats(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words inside windows that occur twice or more in their text."""
    grams, owner, first = windows(h, rows, WINDOW)
    if not len(grams):
        return np.zeros(n, np.int64)
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    edge = np.zeros(len(h) + 1, np.int32)
    at = first[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(covered, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, statistics ..., carry ...) of every whole text; columns to carry along must not be named like a statistic."""
    names = [*BASE, *EXTRA]
    schema = T.StructType([docs.schema[key], *(T.StructField(x, T.LongType()) for x in names), *(docs.schema[c] for c in carry)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, text):
            got = statistics_of(column(part, text))
            yield pa.RecordBatch.from_arrays([column(part, key), *(pa.array(got[x], pa.int64()) for x in names), *(column(part, c) for c in carry)], [key, *names, *carry])

    return docs.select(*dict.fromkeys([key, text, *carry])).mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ---------------------------------------------------------------- learning

#: Ratios that conditions compare with thresholds: name, numerator, denominator.
FEATURES = (
    ("symbols", "n_symbols", "n_chars"),
    ("word_length", "word_chars", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "n_letters"),
    ("digits", "n_digits", "n_chars"),
    ("letters", "n_letters", "n_chars"),
    ("punctuation", "n_punct", "n_chars"),
    ("distinct", "n_distinct_words", "n_words"),
    ("words", "n_words", None),
)


#: How many bad rows a rule must catch to pay for one good row that it rejects.
COST = 10


@dataclass
class Rule:
    """All of (feature, is_upper_bound, threshold); what it covers is rejected."""

    terms: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, upper, t in self.terms:
            out &= x[:, f] <= t if upper else x[:, f] > t
        return out

    def column(self) -> F.Column:
        out = F.lit(True)
        for f, upper, t in self.terms:
            out = out & (feature(f) <= F.lit(t) if upper else feature(f) > F.lit(t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f][0]} {'<=' if upper else '>'} {t:.4g}" for f, upper, t in self.terms)


def feature(i: int) -> F.Column:
    _, top, bottom = FEATURES[i]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def feature_matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([columns[a].astype(np.float64) / (1 if b is None else np.maximum(columns[b], 1)) for _, a, b in FEATURES], axis=1)


def _grow(x: np.ndarray, bad: np.ndarray, deepest: int) -> Rule:
    rule, inside = Rule(), np.ones(len(x), bool)
    while len(rule.terms) < deepest and (bad[inside] == 0).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        base, best, term = np.log2(max(p0, 1e-9) / n0), 1e-9, None
        for f in range(x.shape[1]):
            v = x[inside, f]
            order = np.argsort(v, kind="stable")
            v, y = v[order], bad[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            below, n_below = np.cumsum(y)[cut], cut + 1
            t = (v[cut] + v[cut + 1]) / 2
            for upper, p, n in ((True, below, n_below), (False, p0 - below, n0 - n_below)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, term = gain[k], (f, upper, float(t[k]))
        if term is None:
            break
        rule.terms.append(term)
        inside &= Rule([term]).covers(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last terms while bad rows less ``COST`` times good rows covered does not fall."""

    def worth(r: Rule) -> float:
        c = r.covers(x)
        return float((1 + COST) * bad[c].sum() - COST * c.sum())

    best = rule
    for n in range(len(rule.terms) - 1, 0, -1):
        shorter = Rule(rule.terms[:n])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, most: int = 16, deepest: int = 4, seed: int = 3) -> list[Rule]:
    """A decision list that rejects bad rows; every rule's precision on all rows left to it is at least ``precision``."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    draw = np.random.default_rng(seed)
    while len(rules) < most and bad[left].sum() >= 5:
        at = draw.permutation(np.flatnonzero(left))
        cut = len(at) * 2 // 3
        rule = _prune(_grow(x[at[:cut]], bad[at[:cut]], deepest), x[at], bad[at])
        covered = rule.covers(x) & left
        if not rule.terms or covered.sum() < 5 or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> F.Column:
    """The list as one ordered expression: false at the first rule that covers a row, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = TRAINING_ROWS) -> list[Rule]:
    """Learns from the statistics of labelled documents that pass the base rules; label 0 is bad.

    About ``most_rows`` labels at most, those whose hash lies under a threshold, are used;
    so few rows can be broadcast to the documents whatever the table's size.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label")).where(F.col("__label").isNotNull() & F.col("__key").isNotNull())
    known = known.groupBy("__key").agg(F.max("__label").alias("__label"))
    share = most_rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__key", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key")
    seen = statistics(some, "__key", "__text", ("__label",)).where(~base_failed())
    rows = seen.select("__key", "__label", *BASE, *EXTRA).toPandas().sort_values(["__key", *BASE, *EXTRA])
    if not len(rows):
        return []
    x = feature_matrix({c: rows[c].to_numpy() for c in (*BASE, *EXTRA)})
    return learn(x, (rows["__label"].to_numpy() == 0).astype(np.int64))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics ..., base_failed, kept): the base rules and the learned list on every document."""
    rules = learn_rules(docs, labels, key, text)
    return statistics(docs, key, text).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the base rules and the learned list keep, with all their columns."""
    rules = learn_rules(docs, labels, key, text)
    renamed = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    place = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    others = tuple(c for c in renamed.columns if c not in (place[key], place[text]))
    judged = statistics(renamed, place[key], place[text], (place[text], *others)).where(~base_failed() & verdict(rules))
    return judged.select(*(F.col(place[c]).alias(c) for c in docs.columns))
