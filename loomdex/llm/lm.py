"""Language-model scores of whole documents: add-one unigrams, and a gated recurrent network.

Counts come from all training texts. The network (see gru.py) reads each text from its
first word to its end with its state carried on. It is fitted by truncated backpropagation
in two steps, both in executors: a start on whole texts, in order of their id's hash, until
they have ``FIT_TOKENS`` tokens; then all training texts (one in ``SHARE``, which is 1), in
blocks of about ``FIT_TOKENS`` tokens dealt by another hash. Each block goes on from the start by itself, and the
parameters are averaged, weighted by tokens. So what the network is fitted on grows with
the input, and any block can be trained again alone.
Words beyond the ``KNOWN`` most frequent are looked up by a join, so no table of all
words is ever in one place.

Defined cases: a null or empty text is its end token alone; words never seen in training
share one place in the distribution, as in the base; without training texts both scores
are 0; repeated rows are scored each; only the named columns are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm._counts import most_frequent
from loomdex.llm._store import materialize
from loomdex.llm._words import column, slices, words
from loomdex.llm.gru import PER_CLASS, Gru

#: Words that every worker knows by count; of them, words with an output of their own; tokens the network is fitted on.
KNOWN, WORDS, FIT_TOKENS = 1 << 17, 4096, 1_500_000
#: One in so many training texts goes to the blocks; tasks that add up their parameters.
SHARE, ADDERS = 1, 16
#: Texts are scored side by side in groups of about so many tokens.
GROUP_TOKENS = 2_000_000


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): the hash and number of each lower-cased word, over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate(held_h), np.concatenate(held_n)
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], np.add.reduceat(n, at)

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = merged()
            held_h.clear(), held_n.clear()
            for at in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 200_000].view(np.int64)), pa.array(n[at : at + 200_000])], ["h", "n"])

        for part in slices(batches, text):
            h, n = np.unique(words(column(part, text)).hashes(), return_counts=True)
            if len(h):
                held_h.append(h)
                held_n.append(n)
                size += len(h)
            if size > 1_500_000:
                h, n = merged()
                held_h[:], held_n[:], size = [h], [n], len(h)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if held_h:
            yield from flush()

    return docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    hashes: np.ndarray  # of known words, ascending
    counts: np.ndarray
    token: np.ndarray  # each known word's token for the network
    log_inside: np.ndarray  # log10 of a band word's share in its band, 0 for words
    end: int
    end_count: int
    rare: int  # the token of words that are not known
    tokens: int  # N
    types: int  # V
    rare_tokens: int
    rare_types: int
    net: Gru | None
    start: np.ndarray = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place among known words, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        if self.start is None:
            self.start = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        at = self.start[(h >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            inside = at[left] < len(self.hashes)
            left = left[inside]
            key = self.hashes[at[left]]
            hit = key == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[key < h[left]]
            at[left] += 1
        return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_tokens: int = FIT_TOKENS, known: int = KNOWN, n_words: int = WORDS, share: int = SHARE) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (h, n) that rare words are looked up in."""
    counts = materialize(word_counts(docs, text))
    row = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = docs.count()
    top = most_frequent(counts, known).toPandas().sort_values(["n", "h"], ascending=[False, True])
    h, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    # Words by count; the end of a text is the first of them.
    own = min(len(h), n_words - 1)
    token = np.zeros(len(h), np.int64)
    token[:own] = np.arange(1, own + 1)
    band = np.floor(np.log2(np.maximum(n[own:], 1))).astype(np.int64)
    names = np.unique(band)[::-1]
    token[own:] = own + 1 + np.searchsorted(-names, -band)
    totals = np.array([n[own:][band == b].sum() for b in names], np.float64)
    log_inside = np.zeros(len(h))
    if own < len(h):
        log_inside[own:] = np.log10(n[own:] / totals[token[own:] - own - 1])
    rare_tokens, rare_types = int(row.n - n.sum()), int(row.types - len(h))
    net = Gru.start(np.concatenate([[texts], n[:own]]).astype(np.float64), np.concatenate([totals, [rare_tokens + 1.0]])) if texts else None
    order = np.argsort(h, kind="stable")
    model = Model(h[order], n[order], token[order], log_inside[order], 0, texts, own + 1 + len(names), int(row.n) + texts, int(row.types) + 1 if texts else 0, rare_tokens, rare_types, net)
    if net is not None:
        _train(docs, model, key, text, fit_tokens, share)
    return model, counts


def _tokenize(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end after each text, pointers, word hashes, places among known words)."""
    w = words(texts)
    h = w.hashes()
    at = model.find(h)
    rows = len(w.rows) - 1
    ptr = w.rows + np.arange(rows + 1)
    ids = np.full(len(h) + rows, model.end, np.int32)
    place = np.arange(len(h)) + w.row_of()
    ids[place] = np.where(at >= 0, model.token[at] if len(model.token) else 0, model.rare)
    return ids, ptr, h, at


def _sizes(text: str) -> F.Column:
    """Tokens of a text, its end among them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def _train(docs: DataFrame, model: Model, key: str, text: str, most: int, share: int) -> None:
    """Fits the model's network: a start on some texts, then blocks of all of them (or of one in ``share``)."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    part = model.tokens and 1.1 * most / model.tokens
    first = docs.where(draw < part).select(F.lit(0).cast("long").alias("block"), draw.alias("draw"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    (row,) = _blocks(first.repartition(1), model, None, most).collect() or (None,)
    if row is None:
        return
    model.net, steps = pickle.loads(row.net)
    chosen = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit(12), F.xxhash64(text)), F.lit(share)) == 0)
    # The tokens of all training texts are counted already.
    tokens = model.tokens if share == 1 else int(chosen.agg(F.coalesce(F.sum(_sizes(text)), F.lit(0)).alias("n")).first().n)
    n = max(1, -(-tokens // most))
    block = F.pmod(F.xxhash64(F.col(key), F.lit(13), F.xxhash64(text)), F.lit(n))
    rows = chosen.select(block.alias("block"), draw.alias("draw"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # A task for each block: dealt by hash, some tasks would train several.
    rows = rows.repartitionById(n, F.col("block").cast("int"))
    trained = materialize(_blocks(rows, model, steps, None))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for n_tokens, raw in zip(column(batch, "tokens").to_pylist(), column(batch, "net")):
                net = pickle.loads(raw.as_buffer())[0]
                got = {k: getattr(net, k).astype(np.float64) * n_tokens for k in Gru.PARAMETERS}
                total = got if total is None else {k: total[k] + v for k, v in got.items()}
                tokens += n_tokens
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], ["block", "tokens", "net"])

    sums, tokens = None, 0
    for row in trained.repartition(ADDERS, F.col("block") % ADDERS).mapInArrow(add, "block long, tokens long, net binary").toLocalIterator():
        got = pickle.loads(row.net)
        sums = got if sums is None else {k: sums[k] + v for k, v in got.items()}
        tokens += row.tokens
    for k in Gru.PARAMETERS if tokens else ():
        setattr(model.net, k, (sums[k] / tokens).astype(np.float32))


def _blocks(rows: DataFrame, model: Model, steps: dict[str, np.ndarray] | None, most: int | None) -> DataFrame:
    """(block, tokens, net): the network after each block (block, draw, th, text), whole texts in order of draw.

    net: the network, and its squared gradients if the block was to start from none; with
    ``most`` a block ends after the text that reaches so many tokens.
    """
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model, steps)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, total = None, 0

        def give() -> pa.RecordBatch:
            m, held_steps = pickle.loads(sent.value)
            new = m.net.fresh_steps() if held_steps is None else held_steps
            m.net.train(np.concatenate(held), m.end, steps=new)
            made = pickle.dumps((m.net, new if held_steps is None else None))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total], pa.int64()), pa.array([made], pa.binary())], ["block", "tokens", "net"])

        known, _ = pickle.loads(sent.value)
        for batch in batches:
            for one in slices([batch], "text"):
                ids, ptr, *_ = _tokenize(known, column(one, "text"))
                for i, b in enumerate(column(one, "block").to_pylist()):
                    if held and b != now:
                        yield give()
                        held.clear()
                        total = 0
                    now = b
                    if most is None or total < most:
                        held.append(ids[ptr[i] : ptr[i + 1]])
                        total += len(held[-1])
        if held:
            yield give()

    return rows.sortWithinPartitions("block", "draw", "th").mapInArrow(run, "block long, tokens long, net binary")


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    packed = pickle.dumps(model)
    sent, name = docs.sparkSession.sparkContext.broadcast(packed), hashlib.sha1(packed).hexdigest()
    kind = docs.schema[key].dataType.simpleString()
    log = math.log10(math.e)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _once(name, lambda: pickle.loads(sent.value))
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            net = m.net.score(ids, ptr, m.end) * log if m.net is not None else np.zeros(len(sizes))
            net = net + np.concatenate([x[3] for x in held])
            keys = [pa.concat_arrays([x[0][i] for x in held]) for i in (0, 1)]
            rest = [pa.concat_arrays([x[4][i] for x in held]) for i in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, pa.array(sizes.astype(np.int64)), *rest[:3], pa.array(net), *rest[3:]], names)

        names = ["uid", key, "n_tokens", "n_known", "n_rare", "base", "net", "rare_h", "rare_n"]
        for part in slices(batches, text):
            ids, ptr, h, at = _tokenize(m, column(part, text))
            rows = part.num_rows
            owner = np.repeat(np.arange(rows), np.diff(ptr) - 1)
            known = at >= 0
            n_known = np.bincount(owner[known], minlength=rows) + (m.end_count > 0)
            logs = np.log10(m.counts[at[known]] + 1.0)
            base = np.bincount(owner[known], logs, rows) + math.log10(m.end_count + 1)
            inside = np.bincount(owner[known], m.log_inside[at[known]], rows)
            # Words that are not known: distinct ones of each row with their numbers.
            ro, rh = owner[~known], h[~known]
            order = np.lexsort((rh, ro))
            ro, rh = ro[order], rh[order]
            new = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (ro[1:] != ro[:-1])])) if len(ro) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([new, [len(ro)]]))
            cuts = pa.array(np.searchsorted(ro[new], np.arange(rows + 1)).astype(np.int32))
            n_rare = np.bincount(ro, minlength=rows)
            columns = [
                pa.array(n_known.astype(np.int64)), pa.array(n_rare.astype(np.int64)), pa.array(base),
                pa.ListArray.from_arrays(cuts, pa.array(rh[new].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
            ]
            held.append(((column(part, "uid"), column(part, key)), ids, ptr, inside, columns))
            size += len(ids)
            if size >= GROUP_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    schema = f"uid long, `{key}` {kind}, n_tokens long, n_known long, n_rare long, base double, net double, rare_h array<long>, rare_n array<int>"
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), key, text).mapInArrow(run, schema)
    rows = materialize(rows)
    rare = rows.select("uid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("uid", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("m"))
    found = rare.join(counts, "h").groupBy("uid").agg(F.sum("m").alias("found"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("logs"))
    full = rows.drop("rare_h", "rare_n").join(found, "uid", "left").fillna(0, ["found"]).fillna(0.0, ["logs"])
    whole, tail = model.tokens + 1 * (model.types + 1), model.rare_tokens + model.rare_types + 1
    return full.select(
        key,
        "n_tokens",
        (F.col("n_known") + F.col("found")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        (F.col("net") + F.col("logs") - F.col("n_rare") * math.log10(tail)).alias("score") if model.net is not None else F.lit(0.0).alias("score"),
    )


_made: dict[str, object] = {}


def _once(name: str, make):
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


__all__ = ["FIT_TOKENS", "KNOWN", "PER_CLASS", "SHARE", "WORDS", "Model", "fit", "score", "word_counts"]
