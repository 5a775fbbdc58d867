"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, for whole Arrow slices at once.

The texts of a slice are coded by both tokenizers and put one behind the other, so that
every token end is a byte offset into one buffer and document borders are offsets too.
One ``bincount`` of the A ends and one of the B ends give, by running sums, how many tokens
of each side end up to any byte. A slice is cut where both counts are set; the sums at
document borders, subtracted, are each document's numbers. The B tokens that overlap an A
token are a run whose ends are two of these sums, so links need no search either.

A pair's count (in how many documents it is linked) covers the whole corpus. Each task
sums the pairs of its documents before they are shuffled. The most frequent pairs
(``TOP_PAIRS``, a bound) go to all workers as a sorted array; documents' other pairs meet
their counts in a join, and as these are the rare ones no key of that join is hot.

Defined cases: a null or empty text, or one whose tokens do not spell a space and the text
byte for byte (a B tokenizer that normalises, a literal U+2581), has no tokens: all numbers
are zero and ``groups`` is empty. Special tokens' strings are plain text. Texts are coded
whole at any length; repeated rows count as documents of their own, also with null ids;
ties for the highest count all count as best. Only the named key and text are read, so other
columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.llm._counts import most_frequent
from loomdex.llm._store import materialize
from loomdex.llm._words import column, slices
from loomdex.llm._worker import once
from loomdex.llm.bpe import PATTERN, read_model

#: Pairs that go to every worker with their counts, at most: 17 bytes each.
TOP_PAIRS = 1 << 19
#: Distinct pairs that a task sums before it passes them on.
HELD_PAIRS = 1 << 20
MADE = "n_a long, n_b long, n_groups long, n_links long, groups string"


class ByteLevel:
    """Token ids of a byte-level BPE file (JSON), special strings taken as plain text."""

    def __init__(self, path: str) -> None:
        model = read_model(path)
        self.pieces = [b"" if i in set(model["specials"].values()) else p for i, p in enumerate(model["pieces"])]
        made = [m & 0xFFFFF for m in sorted(model["merges"].values())]
        if made == sorted(made):  # ids in the order of merges: the vocabulary is a table of ranks
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces) if p}
            self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation(), library.no_padding()
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids

    def many(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text."""
        return [self.encode(" " + t) for t in texts]


class Pieces:
    """Token ids of a piece model, which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.library.id_to_piece
        self.pieces = [bytes([int(name(i)[3:-1], 16)]) if self.library.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.library.vocab_size())]

    def many(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []


class Side:
    """The ids of one tokenizer over a slice, and the bytes that they spell."""

    def __init__(self, coder) -> None:
        self.coder = coder
        self.data = np.frombuffer(b"".join(coder.pieces), np.uint8)
        self.size = np.array([len(p) for p in coder.pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        names = [str(i).encode() for i in range(len(coder.pieces))]
        self.digits = np.array([len(n) for n in names])
        self.width = int(self.digits.max())
        self.names = np.frombuffer(b"".join(n.ljust(self.width + 1) for n in names), np.uint8).reshape(-1, self.width + 1)

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, for each text the end of its ids)."""
        lists = self.coder.many(texts)
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64) if lists else np.zeros(0, np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]) if len(ends) else 0), ends

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - sizes), sizes)]


def _per(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over the runs that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


@dataclass
class Aligned:
    """What the texts of a slice have, text by text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: bytes  # all group texts, one behind the other
    group_ends: np.ndarray
    pairs: np.ndarray  # distinct links of each text, a * (ids of B) + b, ascending
    times: np.ndarray
    pair_ends: np.ndarray


def align_texts(texts: list[str | None], a: Side, b: Side) -> Aligned:
    n = len(texts)
    live = np.array([i for i, t in enumerate(texts) if t], np.int64)
    chosen = [texts[i] for i in live]
    raw = [b" " + t.encode() for t in chosen]
    sizes = np.array([len(r) for r in raw], np.int64)
    ids_a, ends_a = a.code(chosen)
    ids_b, ends_b = b.code(chosen)

    def trim(right: np.ndarray) -> tuple:
        """Only the texts that are right."""
        many_a, many_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        ids = ids_a[np.repeat(right, many_a)], ids_b[np.repeat(right, many_b)]
        return *ids, np.cumsum(many_a[right]), np.cumsum(many_b[right]), [r for r, k in zip(raw, right) if k], live[right], sizes[right]

    right = (_per(a.size[ids_a], ends_a) == sizes) & (_per(b.size[ids_b], ends_b) == sizes)
    if not right.all():
        ids_a, ids_b, ends_a, ends_b, raw, live, sizes = trim(right)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    right = _per((a.spell(ids_a) != flat) | (b.spell(ids_b) != flat), np.cumsum(sizes)) == 0
    if not right.all():
        ids_a, ids_b, ends_a, ends_b, raw, live, sizes = trim(right)
    total = int(sizes.sum())
    border = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    size_a = a.size[ids_a]
    at_a, at_b = np.cumsum(size_a), np.cumsum(b.size[ids_b])
    held_a, held_b = np.bincount(at_a, minlength=total + 1), np.bincount(at_b, minlength=total + 1)
    cut = (held_a > 0) & (held_b > 0)
    upto_a, upto_b, upto_cut = np.cumsum(held_a), np.cumsum(held_b), np.cumsum(cut)

    # Links: the B tokens that end behind an A token's start and start before its end.
    first = upto_b[at_a - size_a]
    many = upto_b[at_a - 1] + 1 - first
    link_ends = np.concatenate([[0], np.cumsum(many)])
    left = np.repeat(np.arange(len(ids_a)), many)
    link_b = np.arange(int(link_ends[-1])) - np.repeat(link_ends[:-1] - first, many)
    links_at = link_ends[upto_a[border]]
    code = ids_a[left] * len(b.size) + ids_b[link_b]
    most = len(a.size) * len(b.size)
    key, times = np.unique(np.repeat(np.arange(len(live)), np.diff(links_at)) * most + code, return_counts=True)
    pairs_at = np.searchsorted(key, np.arange(1, len(live) + 1) * most)

    # Group texts: A tokens of a group, then its B tokens, each with its digits and one separator.
    ends = np.flatnonzero(cut)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    slot_a = np.arange(len(ids_a)) + upto_b[starts][upto_cut[at_a - 1]]
    slot_b = np.arange(len(ids_b)) + upto_a[ends][upto_cut[at_b - 1]]
    slots = len(ids_a) + len(ids_b)
    width = max(a.width, b.width) + 1
    rows, digits = np.zeros((slots, width), np.uint8), np.zeros(slots, np.int64)
    rows[slot_a, : a.width + 1], rows[slot_b, : b.width + 1] = a.names[ids_a], b.names[ids_b]
    digits[slot_a], digits[slot_b] = a.digits[ids_a], b.digits[ids_b]
    separator = np.full(slots, ord(","), np.uint8)
    separator[slot_a[upto_a[ends] - 1]] = ord("|")
    last_b = slot_b[upto_b[ends] - 1]
    separator[last_b] = ord(";")
    rows[np.arange(slots), digits] = separator
    used = digits + 1
    used[slot_b[upto_b[border[1:]] - 1]] -= 1  # nothing follows a text's last group
    text = rows[np.arange(width) < used[:, None]].tobytes()
    text_at = np.concatenate([[0], np.cumsum(used)])[upto_a[border[1:]] + upto_b[border[1:]]]

    def whole(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[live] = values
        return out

    return Aligned(
        whole(np.diff(upto_a[border])), whole(np.diff(upto_b[border])), whole(np.diff(upto_cut[border])), whole(np.diff(links_at)),
        text, np.cumsum(whole(np.diff(text_at, prepend=0))), key % most, times, np.cumsum(whole(np.diff(pairs_at, prepend=0))),
    )


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times) of every text: groups as ``a1,a2|b1;a3|b2,b3``; pairs the distinct
    links, a id * size of B's vocabulary + b id, ascending; times the occurrences of each."""
    schema = StructType([*docs.select(key).schema.fields, *_made(docs).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = once("a", a_path, lambda: Side(ByteLevel(a_path))), once("b", b_path, lambda: Side(Pieces(b_path)))
        for part in slices(batches, text):
            got = align_texts(column(part, text).to_pylist(), a, b)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], got.pair_ends]), pa.int32()), pa.array(x, pa.int64())) for x in (got.pairs, got.times)]
            offsets = np.concatenate([[0], got.group_ends]).astype(np.int32)
            groups = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(got.groups))
            numbers = [pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
            yield pa.RecordBatch.from_arrays([column(part, key), *numbers, groups, *lists], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _made(docs: DataFrame) -> StructType:
    return docs.sparkSession.createDataFrame([], f"{MADE}, pairs array<long>, times array<long>").schema


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``aligned`` each pair is linked."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            both = np.concatenate([codes, new])
            weights = np.concatenate([counts, np.ones(len(new), np.int64)])
            codes, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, weights, len(codes)).astype(np.int64)
            if len(codes) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["pair", "n"])
                codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["pair", "n"])

    return aligned.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, size_b: int, most: int = TOP_PAIRS) -> DataFrame:
    """aligned (pairs, times and any columns) with n_best (links whose pair's count is the highest of its A id) and
    count_sum (of all links' counts), without pairs and times. size_b: ids of B's vocabulary."""
    spark, carried = aligned.sparkSession, [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = materialize(aligned.withColumn("__row", F.monotonically_increasing_id()), compression="zstd")
    a = F.floor(F.col("pair") / size_b).alias("a")
    counts = materialize(pair_counts(rows))
    highest = counts.groupBy(a).agg(F.max("n").alias("high"))  # a row for each id of A's vocabulary at most
    counts = materialize(counts.select("*", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("high")).alias("best")))
    top = most_frequent(counts, most).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    schema = StructType([*rows.drop("pairs", "times").schema.fields, *spark.createDataFrame([], "n_best long, count_sum long, rare array<struct<pair:long,times:long>>").schema.fields])

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = sent.value
        for batch in batches:
            lists = column(batch, "pairs")
            pairs, times = lists.flatten().to_numpy(zero_copy_only=False), column(batch, "times").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
            known = codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)
            here = (lambda x: np.where(known, x[at], 0) * times) if len(codes) else (lambda x: np.zeros(len(pairs), np.int64))
            rare_ends = np.concatenate([[0], np.cumsum(_per(~known, ends))])
            rare = pa.StructArray.from_arrays([pa.array(x[~known], pa.int64()) for x in (pairs, times)], ["pair", "times"])
            made = [pa.array(_per(here(best.astype(np.int64)), ends)), pa.array(_per(here(n), ends)), pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in (*carried, "__row")), *made], schema.names)

    found = materialize(rows.mapInArrow(look_up, schema))
    rare = found.select("__row", F.explode("rare").alias("x")).select("__row", "x.pair", "x.times").join(counts, "pair")
    rare = rare.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("times")).alias("__sum"))
    joined = found.join(rare, "__row", "left")
    added = [(F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "__best"), ("count_sum", "__sum"))]
    return joined.select(*carried, *added)


def vocabulary_size(b_path: str) -> int:
    return len(Pieces(b_path).pieces)
