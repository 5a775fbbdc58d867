"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The words that the corpus repeats most are compiled, with the ids of their pieces,
into an acyclic automaton whose states are shared between equal suffixes. Arc outputs
add up to a word's number (minimal perfect hashing), which points to its ids. Workers
memory-map the automaton. A word it does not hold is merged pair by pair, exactly, so
the lexicon only decides speed, never a result.

Defined cases: a null or empty text has no ids and decodes to ""; very long words
(over ``LONG`` bytes) are merged with a heap in n log n; repeated rows give equal
rows; only the named id and text columns are read, so other columns cannot clash; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import pickle
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm._counts import most_frequent
from loomdex.llm._store import materialize
from loomdex.llm._words import column, slices, utf8
from loomdex.llm._worker import once

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than a single space or line feed between words: such texts are split as a whole.
UNUSUAL = r"  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG = 64
#: Bounds of the lexicon (words, and bytes of one) and of each worker's memo of words.
LEXICON_WORDS, LEXICON_BYTES, MEMO_WORDS = 60_000, 48, 400_000


# ---------------------------------------------------------------- model file


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_model(path: str) -> dict:
    """The parts of a tokenizer file (JSON, byte-level BPE) that coding needs, with bytes in place of symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_symbols())}
    vocab = spec["model"]["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    pieces = [b""] * size
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token)
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for content, i in specials.items():
        pieces[i] = content.encode()
    singles = [vocab[c] for c in byte_symbols()]
    return {"pieces": pieces, "merges": merges, "specials": specials, "singles": singles}


# ---------------------------------------------------------------- merging


_NONE = 1 << 40


def merge(word: bytes, singles: list[int], merges: dict[int, int]) -> list[int]:
    """The exact BPE pieces of one word: the best-ranked pair first, leftmost among equals.

    merges: for a pair of ids, ``a << 20 | b``, its rank and the id it makes, ``rank << 20 | id``.
    """
    ids = [singles[b] for b in word]
    if len(ids) > LONG:
        return _merge_long(ids, merges)
    get = merges.get
    ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best == _NONE:
            break
        i = ranks.index(best)
        new = ids[i] = best & 0xFFFFF
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(new << 20 | ids[i + 1], _NONE)
        if i:
            ranks[i - 1] = get(ids[i - 1] << 20 | new, _NONE)
    return ids


def _merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    n, get = len(ids), merges.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found >> 20, i, ids[i], ids[i + 1], found & 0xFFFFF) for i in range(n - 1) if (found := get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (found := get(ids[left] << 20 | ids[after[left]])) is not None:
                heapq.heappush(heap, (found >> 20, left, ids[left], ids[after[left]], found & 0xFFFFF))
    return [x for x in ids if x >= 0]


class BatchMerger:
    """``merge`` for many short words at once: one matrix row a word, one pair merged in each row a step."""

    def __init__(self, singles: list[int], merges: dict[int, int]) -> None:
        self.singles, self.merges = np.array(singles, np.int64), merges
        order = np.array(sorted(merges), np.int64)
        self.keys, self.values = order, np.array([merges[k] for k in order.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.values[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as int32 bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 14), (14, 24), (24, LONG)):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(group), 8192):
                self._block([words[i] for i in group[k : k + 8192]], group[k : k + 8192], high, out)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = np.array(merge(words[i], self.singles.tolist(), self.merges), np.int32).tobytes()
        return out

    def _block(self, words: list[bytes], owner: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        size = np.array([len(w) for w in words])
        ids = np.full((len(words), width + 2), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.singles[raw], -1)
        ranks = np.full((len(words), width + 1), _NONE, np.int64)
        ranks[:, : width - 1] = self._rank(ids[:, : width - 1], ids[:, 1:width])
        columns = np.arange(width + 1)
        done_ids = []
        while len(ids):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(ids))
            best = ranks[rows, at]
            over = best == _NONE
            if over.any():
                done_ids.append((owner[over], ids[over]))
                live = ~over
                ids, ranks, owner, at, best = ids[live], ranks[live], owner[live], at[live], best[live]
                rows = np.arange(len(ids))
                if not len(ids):
                    break
            ids[rows, at] = best & 0xFFFFF
            ids[:, :-1] = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ranks[:, :-1] = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            ranks[rows, at] = self._rank(ids[rows, at], ids[rows, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
        for own, rows in done_ids:
            counts = (rows >= 0).sum(axis=1)
            narrow = rows.astype(np.int32)
            for i, row, n in zip(own.tolist(), narrow, counts.tolist()):
                out[i] = row[:n].tobytes()


# ---------------------------------------------------------------- lexicon


class Lexicon:
    """A minimal acyclic transducer from words to id lists, in one block of bytes that can be memory-mapped."""

    def __init__(self, block) -> None:
        head = np.frombuffer(block, np.int64, 4)
        states, arcs, words, ids = (int(x) for x in head)
        at = 32


        def take(kind, n):
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += (out.nbytes + 7) // 8 * 8
            return out

        self.keys, self.target, self.output = take(np.int64, arcs), take(np.int32, arcs), take(np.int32, arcs)
        self.pointer, self.ids, self.final = take(np.int32, words + 1), take(np.int32, ids), take(np.uint8, states)
        self.block = block

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, or -1: one automaton step for all words a byte."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        if not n or not len(self.target):
            return out
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        live, state, total, step = np.flatnonzero(size > 0), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            key = state[live] << 8 | raw[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            live, arc = live[found], arc[found]
            total[live] += self.output[arc]
            state[live] = self.target[arc]
            step += 1
            ended = size[live] == step
            last = live[ended]
            out[last] = np.where(self.final[state[last]] == 1, total[last], -1)
            live = live[~ended]
        return out

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as int32 bytes, or None."""
        p, ids = self.pointer, self.ids
        return [None if k < 0 else ids[p[k] : p[k + 1]].tobytes() for k in self.numbers(words).tolist()]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Builds the automaton from sorted words, merging each finished state with an equal one."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    counts: list[int] = []
    path: list[list] = [[False, []]]  # states of the last word's path: final, arcs

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(key)
                counts.append(int(final) + sum(counts[t] for _, t in arcs))
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last, words = b"", sorted(entries)
    for w in words:
        if not w:
            continue
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        freeze(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    freeze(0)
    root = (False, tuple(path[0][1]))
    order = [root, *arcs_of]  # a frozen state s is s + 1
    keys, targets, outputs, finals = [], [], [], []  # an arc's key: state << 8 | byte, ascending
    for state, (final, arcs) in enumerate(order):
        total = int(final)
        for b, t in arcs:
            keys.append(state << 8 | b)
            targets.append(t + 1)
            outputs.append(total)
            total += counts[t]
        finals.append(final)
    words = [w for w in words if w]
    pointer = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(entries[w]) for w in words], out=pointer[1:]) if words else None
    flat = [i for w in words for i in entries[w]]
    out = np.array([len(order), len(keys), len(words), len(flat)], np.int64).tobytes()
    for part in (np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), pointer, np.array(flat, np.int32), np.array(finals, np.uint8)):
        raw = part.tobytes()
        out += raw + bytes(-len(raw) % 8)
    return out


def map_block(block: bytes) -> mmap.mmap:
    """Maps a block through a file without a name, so nothing stays in the worker's folder."""
    handle, name = tempfile.mkstemp(prefix="lexicon-")
    try:
        os.write(handle, block)
        return mmap.mmap(handle, len(block), access=mmap.ACCESS_READ)
    finally:
        os.close(handle)
        os.unlink(name)


# ---------------------------------------------------------------- coding


class Coder:
    """Codes texts with a memo of words; only words that the memo lacks go to the automaton, and from there to the merger."""

    def __init__(self, model: dict, block=None) -> None:
        self.specials, self.lexicon = model["specials"], Lexicon(block) if block is not None else None
        self.merger = BatchMerger(model["singles"], model["merges"])
        self.find = regex.compile(PATTERN).findall
        self.unusual = regex.compile(UNUSUAL).search
        special = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.special = regex.compile(f"({special})").split if special else None
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        raw = [w.encode() for w in new]
        got: list[bytes | None] = self.lexicon.get(raw) if self.lexicon is not None else [None] * len(raw)
        unseen = [i for i, ids in enumerate(got) if ids is None]
        for i, ids in zip(unseen, self.merger.merge([raw[i] for i in unseen])):
            got[i] = ids
        self.words.update(zip(new, got))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as int32 bytes."""
        if len(self.words) + len(self.spaced) > MEMO_WORDS:
            self.words.clear()
            self.spaced.clear()
        plans, units, needed = [], set(), set()
        for text in texts:
            plan: list = []  # parts of a text: an id, a list of words, or (first words, units that a space precedes)
            for part in self.special(text) if text and self.special and any(s in text for s in self.specials) else [text] if text else []:
                if part in self.specials:
                    plan.append(np.int32(self.specials[part]).tobytes())
                elif self.unusual(part):
                    plan.append(self.find(part))
                    needed.update(plan[-1])
                elif part:
                    # Single spaces only: what follows one is split the same way by itself as in the text.
                    first, *rest = part.split(" ")
                    plan.append((self.find(first), rest))
                    needed.update(plan[-1][0])
                    units.update(filterfalse(self.spaced.__contains__, rest))
            plans.append(plan)
        cut = {u: [" " + u] if u.isalpha() else self.find(" " + u) for u in units}
        for pieces in cut.values():
            needed.update(pieces)
        self._learn(needed)
        word, spaced = self.words.__getitem__, self.spaced
        for u, pieces in cut.items():
            spaced[u] = word(pieces[0]) if len(pieces) == 1 else b"".join(map(word, pieces))
        out = []
        for plan in plans:
            done = [x if isinstance(x, bytes) else b"".join(map(word, x)) if isinstance(x, list) else b"".join(map(word, x[0])) + b"".join(map(spaced.__getitem__, x[1])) for x in plan]
            out.append(done[0] if len(done) == 1 else b"".join(done))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


class Decoder:
    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def column(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of id lists (flat, with offsets); bytes that are no UTF-8 become U+FFFD."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.at[ids] - (ends - sizes), sizes)
        raw = self.data[place].tobytes()
        cuts = np.concatenate([[0], ends])[offsets]
        try:
            for k in range(len(cuts) - 1):
                raw[cuts[k] : cuts[k + 1]].decode()
        except UnicodeDecodeError:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each space-separated word of up to LEXICON_BYTES characters occurs, over all texts."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            live = [(w, n) for w, n in counts.items() if len(w) <= LEXICON_BYTES]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in live], pa.string()), pa.array([n for _, n in live], pa.int64())], ["word", "n"])

        for part in slices(batches, text):
            for t in column(part, text).to_pylist():
                if t:
                    counts.update(t.split())
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    return docs.select(text).mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, model: dict, text: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """Counts all words of all texts and compiles the most frequent ``most`` (a bound on its size only)."""
    top = most_frequent(materialize(count_words(docs, text).where("n > 1")), most).collect()
    find = regex.compile(PATTERN).findall
    entries: dict[bytes, list[int]] = {}
    for row in top:
        for piece in (*find(" " + row.word), *find(row.word)):
            raw = piece.encode()
            if raw not in entries and len(raw) <= LEXICON_BYTES:
                entries[raw] = merge(raw, model["singles"], model["merges"])
    return compile_lexicon(entries)


#: Batches of a task to batches; one worker process can run several in turn.
Step = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(docs: DataFrame, model_path: str, id_col: str, text: str, lexicon: bytes | None) -> Step:
    model = read_model(model_path)
    block = build_lexicon(docs, model, text) if lexicon is None else lexicon
    packed = pickle.dumps((model, block))
    key, sent = hashlib.sha1(packed).hexdigest(), docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            model, block = pickle.loads(sent.value)
            return Coder(model, map_block(block))

        coder = once("coder", key, make)
        for part in slices(batches, text):
            rows = coder.encode_many(column(part, text).to_pylist())
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
            yield pa.RecordBatch.from_arrays([column(part, id_col), pa.ListArray.from_arrays(pa.array(offsets), flat)], [id_col, "ids"])

    return run


def _decoder(spark: SparkSession, model_path: str, id_col: str, ids: str) -> Step:
    packed = pickle.dumps(read_model(model_path)["pieces"])
    key, sent = hashlib.sha1(packed).hexdigest(), spark.sparkContext.broadcast(packed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = once("decoder", key, lambda: Decoder(pickle.loads(sent.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = column(part, ids)
                if lists.null_count:
                    lists = lists.fill_null([])
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([column(part, id_col), column(part, ids), decoder.column(flat, offsets)], [id_col, ids, "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """(id_col, ids array<int>): the ids of every whole text. Builds the lexicon from the corpus if none is given."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(_encoder(docs, model_path, id_col, text, lexicon), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_col, ids, decoded): the text of every id list; an id outside the vocabulary raises IndexError, a null list is empty."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids).mapInArrow(_decoder(encoded.sparkSession, model_path, id_col, ids), f"`{id_col}` {kind}, `{ids}` array<int>, decoded string")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every text; a task has one worker for both, so no second one is left with memory of its own."""
    first, then = _encoder(docs, model_path, id_col, text, None), _decoder(docs.sparkSession, model_path, id_col, "ids")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(lambda batches: then(first(batches)), f"`{id_col}` {kind}, ids array<int>, decoded string")


__all__ = ["Coder", "Decoder", "Lexicon", "build_lexicon", "compile_lexicon", "count_words", "decode", "encode", "encode_decode", "merge", "read_model", "utf8"]
