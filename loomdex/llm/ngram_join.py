"""Exact Jaccard self-join on word n-gram sets, with token-combination prefixes.

Tokens are the hashes of a text's n-grams, ordered from rare to frequent by a counting
sketch over all texts. Two sets with Jaccard >= t overlap in at least o = ceil(t * size)
tokens, so each may lack e = size - o of its own in the other. Tokens fall into classes:
rare ones, of which one in common is enough for a candidate, and frequent ones, split by
their hash into parts, of which a candidate needs k in common in one part (k = 2, for very
frequent ones 3). To rob a prefix of every such common combination of a part with p tokens
takes p - k + 1 missing tokens, so a prefix is extended until these numbers add up to
e + 1; then the two sets' prefixes must share a combination. The number of parts grows
with the sets' size, so that a part holds a few tokens and a set of any size has about as
many combinations as prefix tokens. Sets index themselves for each power of two that a
partner's size may lie in.

Equal sets are one class from the start. Every class is compared with one pivot, the
smallest set of one of its buckets. What is in different components after that is put
into tiles of about ``TILE`` classes (of one component, or of one bucket), and tiles that
meet in a bucket are compared as blocks, each pair of tiles once however many buckets they
share; a block gives back links that span what it connects, not all of them. So a group of
n near copies costs about n comparisons, and no link that would join two components is
missed.

Defined cases: a text without words, or null, has the empty set and links with nothing;
fewer words than n form one token; rows that repeat an id are members like others; a
null id stands behind all others, and a component of null ids alone has a null id; only
the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm._graph import connected_components
from loomdex.llm._sieve import bitmap, marked
from loomdex.llm._store import discard, materialize
from loomdex.llm._words import column, mix, slices, windows, words

#: Counters of the frequency sketch; their classes (a byte each) are what workers get.
SKETCH, CHUNKS = 1 << 20, 64
#: Very frequent tokens are those of so many more frequency steps than frequent ones (eight for each doubling).
VERY = 40
#: Classes of a tile, about.
TILE = 256
#: Cells of a set's histogram, a byte each: cell-wise minima bound two sets' overlap from above.
CELLS = 256
_SALT = np.uint64(0xA24BAED4963EE407)


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text: (hashes ascending within rows, row pointers)."""
    w = words(texts)
    rows = len(w.rows) - 1
    h, owner, _ = windows(w.hashes(), w.rows, n, whole_if_short=True)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def class_ids(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set; equal sets, and only they but for hash collisions, share it."""
    counts = np.diff(ptr).astype(np.uint64)

    def per_row(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        return total[ptr[1:]] - total[ptr[:-1]]

    return mix(mix(per_row(mix(h)) + counts) + per_row(mix(h + _SALT)))


def histograms(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Each set's tokens by cell; 255 stands for 255 or more."""
    rows = len(ptr) - 1
    cell = np.repeat(np.arange(rows), np.diff(ptr)) * CELLS + (mix(h) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=rows * CELLS), 255).astype(np.uint8).reshape(rows, CELLS)


def steps(count: np.ndarray) -> np.ndarray:
    """Frequency classes, eight for each doubling: fine enough to tell a repeated token from a sketch cell's other tokens."""
    return np.minimum(np.floor(8 * np.log2(count + 1)), 255).astype(np.uint8)


def profile(docs: DataFrame, n: int, key: str, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """(key, size, cid, cells) of every document; the sketch's frequency classes; the class from which tokens are frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for part in slices(batches, text, 1 << 20):
            h, ptr = sets_of(column(part, text), n)
            counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [column(part, key).cast(pa.int64()), pa.array(np.diff(ptr).astype(np.int64)), pa.array(class_ids(h, ptr).view(np.int64)), pa.nulls(m, pa.int32()), pa.array([c.tobytes() for c in histograms(h, ptr)], pa.binary())], ["key", "size", "cid", "chunk", "counts"]
            )
        if counts.any():
            # A counter of one task stops at 65,535; sums only order tokens, so any such rule keeps results exact.
            cut = np.minimum(counts, 65_535).astype(np.uint16).reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64())] * 3 + [pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], ["key", "size", "cid", "chunk", "counts"])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(column(batch, "chunk").to_pylist(), column(batch, "counts")):
                got = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
                sums[c] = sums[c] + got if c in sums else got
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([steps(s).tobytes()], pa.binary()), pa.array([int(s.sum())], pa.int64())], ["chunk", "classes", "n"])

    both = materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_renamed(run, key, text), "key long, size long, cid long, chunk int, counts binary"))
    classes, tokens = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint8), 0
    for row in both.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(total, "chunk int, classes binary, n long").collect():
        classes[row.chunk] = np.frombuffer(row.classes, np.uint8)
        tokens += row.n
    frequent = int(steps(np.array([max(256, 4 * tokens / SKETCH)]))[0])
    return both.where("chunk is null").select("key", "size", "cid", F.col("counts").alias("cells")), classes.reshape(-1), frequent


def _renamed(run, key: str, text: str):
    """Inside, the columns are named key and text whatever their names outside; run still asks by the outer names."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns([key, text]) for b in batches)

    return inner


def _parts(level: int, num: int, den: int) -> tuple[int, int, int]:
    """(largest k, parts of frequent tokens, parts of very frequent ones) for sets that index themselves under 2**level.

    In a part of p tokens p - k + 1 count for the prefix, so parts cost their sets 1 or 2
    tokens each; there are never so many that a whole set could not reach its e + 1.
    """
    least = -(-num * (1 << level) // den)  # the smallest set that may have a partner of this level
    spare = -(-num * least // den) - 1
    lacking = (1 << level) - (-(-num * (1 << level) // den)) + 1
    if spare < 1:
        return 1, 1, 1
    if spare < 3:
        return 2, 1, 1
    room = max(1, spare // 4)
    return 3, min(max(1, lacking // 3), room), min(max(1, lacking // 4), room)


def index_rows(h: np.ndarray, ptr: np.ndarray, classes: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row): the index entries of each set for Jaccard >= num / den."""
    sizes = np.diff(ptr)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = classes[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((h, rank, owner))
    h, rank = h[order], rank[order]
    kind = 1 + (rank >= frequent) + (rank >= frequent + VERY)
    smallest, largest = -(-num * sizes // den), sizes * den // num
    need = sizes - smallest + 1
    live = (sizes > 0) & ((smallest < sizes) | (largest > sizes))  # others have no partner but equal sets
    low, high = (np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) for x in (smallest, largest))
    buckets, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    plain = live & (np.bincount(owner, kind > 1, len(sizes)) == 0)  # rare tokens only: alike under each level
    low[plain] = high[plain]
    for level in range(int(low[live].min(initial=0)), int(high[live].max(initial=-1)) + 1):
        some = live & (low <= level) & (level <= high)
        at = np.flatnonzero(some[owner])
        if not len(at):
            continue
        most, twos, threes = _parts(level, num, den)
        o, t, k = owner[at], h[at], np.minimum(kind[at], most)
        spread = mix(t ^ _SALT)
        part = np.where(k == 2, 1 + (spread % np.uint64(twos)).astype(np.int64), np.where(k == 3, 1 + twos + (spread % np.uint64(threes)).astype(np.int64), 0))
        # Each token's place among the tokens of its part.
        by = np.lexsort((part, o))
        fresh = np.concatenate([[True], (o[by][1:] != o[by][:-1]) | (part[by][1:] != part[by][:-1])])
        start = np.flatnonzero(fresh)
        place = np.empty(len(t), np.int64)
        place[by] = np.arange(len(t)) - start[np.cumsum(fresh) - 1]
        counts = place >= k - 1
        done = np.cumsum(counts)
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        before = (done - counts)[first]
        inside = done - counts - np.repeat(before, np.diff(np.append(first, len(o)))) < need[o]
        alone = inside & (k == 1)
        buckets.append(mix(t[alone]))
        rows.append(o[alone])
        by = by[inside[by] & (k[by] > 1)]
        o, t, k, part = o[by], t[by], k[by], part[by]
        same = lambda d: (o[d:] == o[:-d]) & (part[d:] == part[:-d])
        d = 1
        while d < len(t) and (near := same(d)).any():
            i = np.flatnonzero(near & (k[d:] == 2))
            buckets.append(mix(mix(t[i] + _SALT) + t[i + d]))
            rows.append(o[i])
            for e in range(1, d):
                i = np.flatnonzero(near & (k[d:] == 3))
                buckets.append(mix(mix(mix(t[i] + _SALT) + t[i + e]) + t[i + d]))
                rows.append(o[i])
            d += 1
    bucket, row = np.concatenate(buckets), np.concatenate(rows)
    order = np.lexsort((bucket, row))
    bucket, row = bucket[order], row[order]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    return bucket[new], row[new]


def _index(docs: DataFrame, n: int, text: str, classes: np.ndarray, frequent: int, num: int, den: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, np.zeros(0, np.uint64)
        for part in slices(batches, text, 1 << 20):
            h, ptr = sets_of(column(part, text), n)
            cid = class_ids(h, ptr)
            # Of equal sets in a task one is indexed.
            _, first = np.unique(cid, return_index=True)
            new = first[~np.isin(cid[first], seen)]
            seen = np.concatenate([seen, cid[new]])
            fresh = np.zeros(len(cid), bool)
            fresh[new] = True
            sizes = np.diff(ptr)[fresh]
            h, cid = h[np.repeat(fresh, np.diff(ptr))], cid[fresh]
            bucket, row = index_rows(h, np.concatenate([[0], np.cumsum(sizes)]), table, frequent, num, den)
            for at in range(0, len(row), 200_000):
                r = row[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 200_000].view(np.int64)), pa.array(cid[r].view(np.int64)), pa.array(sizes[r].astype(np.int32))], ["bucket", "cid", "size"])

    return docs.select(text).mapInArrow(run, "bucket long, cid long, size int")


def _token_sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, n: int, key: str, text: str, short: bool = False) -> DataFrame:
    """(cid, tokens) of the wanted classes; bit filters of a fixed size keep most other texts from being read for it.

    tokens: 64 bits each, or with ``short`` 16 bits, of which several tokens may have the same.
    """
    ends = members.join(wanted, "cid")
    one = ends.groupBy("cid").agg(F.min("key").alias("key"))
    spot = F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    keys, cids = (docs.sparkSession.sparkContext.broadcast(bitmap(one.select(x))) for x in (spot, "cid"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row without an id is always read: its class may have no other.
            spot = column(batch, "spot")
            keep = marked(keys.value, spot.fill_null(0).to_numpy(zero_copy_only=False)) | spot.is_null().to_numpy(zero_copy_only=False)
            for part in slices([batch.filter(pa.array(keep))], "text", 1 << 20):
                h, ptr = sets_of(column(part, "text"), n)
                cid = class_ids(h, ptr).view(np.int64)
                _, first = np.unique(cid, return_index=True)
                first = first[marked(cids.value, cid[first])]
                h = (h >> np.uint64(48)).astype(np.uint16) if short else h
                tokens = [h[ptr[r] : ptr[r + 1]].tobytes() for r in first]
                yield pa.RecordBatch.from_arrays([pa.array(cid[first]), pa.array(tokens, pa.binary())], ["cid", "tokens"])

    texts = docs.select(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("long"))).alias("spot"), F.col(text).alias("text"))
    found = texts.mapInArrow(run, "cid long, tokens binary")
    return found.dropDuplicates(["cid"])


def _near(rows: list[pa.RecordBatch], kind: type, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cid, component, i, j): the pairs of rows of a comparison whose overlap reaches the threshold and that lie in different components.

    Each row of side 0 meets each of side 1, and those of side 2 meet each other. kind
    says what tokens are: whole ones, short ones (their overlap is that of the multisets
    or more, so at least that of the tokens), or a histogram's cells, a bound likewise.
    """
    cid, side, comp, size = (np.concatenate([column(b, c).to_numpy() for b in rows]) for c in ("cid", "side", "component", "size"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    common = _cell_bounds(rows, left, right) if kind is np.uint8 else _overlaps(rows, kind, left, right)
    both = size[left][:, None] + size[right][None, :]
    i, j = np.nonzero((num + den) * common >= num * both)
    i, j = left[i], right[j]
    ok = (i != j) & (comp[i] != comp[j])
    return cid, comp, i[ok], j[ok]


def _cell_bounds(rows: list[pa.RecordBatch], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """No less than the overlap of each pair: the sum of cell-wise minima, without a bound where both are full."""
    cells = np.frombuffer(b"".join(v for b in rows for v in column(b, "tokens").to_pylist()), np.uint8).reshape(-1, CELLS)
    out, other = np.zeros((len(left), len(right)), np.int64), cells[right]
    full = other == 255
    for at, i in enumerate(left):
        out[at] = np.minimum(cells[i], other).sum(axis=1, dtype=np.int64)
        mine = cells[i] == 255
        if mine.any():
            out[at][(full & mine).any(axis=1)] = 1 << 40
    return out


def _overlaps(rows: list[pa.RecordBatch], kind: type, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each pair's common tokens."""
    sets = [np.frombuffer(v.as_buffer(), kind) for b in rows for v in column(b, "tokens")]
    size = np.array([len(s) for s in sets])
    # The overlaps of all pairs are a matrix product over the tokens that occur twice or more, some columns at a time.
    token, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(of, minlength=len(token)) > 1
    name = np.cumsum(often) - 1
    owner, of = owner[often[of]], name[of[often[of]]]
    order = np.argsort(of, kind="stable")
    owner, of = owner[order], of[order]
    common = np.zeros((len(left), len(right)), np.float64)
    wide, last = 4096, int(of[-1]) + 1 if len(of) else 0
    for at in range(0, last, wide):
        lo, hi = np.searchsorted(of, [at, at + wide])
        held = np.zeros((len(sets), min(wide, last - at)), np.float32)
        np.add.at(held, (owner[lo:hi], of[lo:hi] - at), 1)
        common += held[left] @ held[right].T
    return common.astype(np.int64)


def _spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The links that connect what those before them do not: at most one less than there are components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for at, (a, b) in enumerate(zip(comp[i].tolist(), comp[j].tolist())):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append(at)
    return kept


def _by_job(jobs: DataFrame, sets: DataFrame, answer, schema: str) -> DataFrame:
    """answer(rows of one job) for every job (job, cid, side, component, tokens), a job at a time; rows of two longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, out = None, [np.zeros((0, 2), np.int64)]

        def give() -> pa.RecordBatch:
            all_ = np.concatenate(out)
            out[:] = out[:0]
            return pa.RecordBatch.from_arrays([pa.array(all_[:, 0].copy()), pa.array(all_[:, 1].copy())], names)

        for batch in batches:
            job = column(batch, "job").to_numpy()
            cuts = [0, *(np.flatnonzero(job[1:] != job[:-1]) + 1).tolist(), len(job)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if held and job[lo] != now:
                    out.append(answer(now, held))
                    held.clear()
                now = job[lo]
                held.append(batch.slice(lo, hi - lo))
            if sum(map(len, out)) > 10_000:
                yield give()
        if held:
            out.append(answer(now, held))
        if out:
            yield give()

    names = [x.split()[0] for x in schema.split(", ")]
    full = jobs.join(sets, "cid").select("job", "cid", "side", "component", "size", "tokens")
    return full.repartition("job").sortWithinPartitions("job").mapInArrow(run, schema)


def _compare(jobs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between classes of the same job that span what the job connects."""

    def answer(job: int, rows: list[pa.RecordBatch]) -> np.ndarray:
        cid, comp, i, j = _near(rows, np.uint64, num, den)
        kept = _spanning(comp, i, j)
        return np.stack([cid[i[kept]], cid[j[kept]]], axis=1)

    return _by_job(jobs, sets, answer, "a long, b long")


def _likely(jobs: DataFrame, sets: DataFrame, kind: type, num: int, den: int) -> DataFrame:
    """The rows of jobs that may have a link there, by histograms or short tokens."""

    def answer(job: int, rows: list[pa.RecordBatch]) -> np.ndarray:
        cid, _, i, j = _near(rows, kind, num, den)
        found = np.unique(cid[np.concatenate([i, j])])
        return np.stack([np.full(len(found), job), found], axis=1)

    return jobs.join(_by_job(jobs, sets, answer, "job long, cid long"), ["job", "cid"])


def _salted(n: str) -> F.Column:
    """Which of the tiles of a group of n a class belongs to."""
    return F.pmod(F.xxhash64("cid", F.lit(3)), F.ceil(F.col(n) / TILE))


def _stars(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Jobs that compare each class with the smallest set of one of its buckets."""
    pivots = shared.groupBy("bucket").agg(F.min(F.struct("size", "cid")).alias("p"))
    met = shared.join(pivots, "bucket").where((F.col("cid") != F.col("p.cid")) & (den * F.col("p.size") >= num * F.col("size")))
    pairs = materialize(met.groupBy("cid").agg(F.min("p").alias("p"), F.first("size").alias("size")).select("cid", "size", F.col("p.cid").alias("pivot"), F.col("p.size").alias("pivot_size")))
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
    rows = pairs.join(sizes, "pivot").select(F.xxhash64("pivot", _salted("n")).alias("job"), "cid", "size", "pivot", "pivot_size")
    heads = rows.select("job", F.col("pivot").alias("cid"), F.col("pivot_size").alias("size"), F.lit(0).alias("side")).distinct()
    return rows.select("job", "cid", "size", F.lit(1).alias("side")).unionByName(heads).withColumn("component", F.col("cid"))


def _tiles(shared: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """Jobs that compare all classes of different components that share a bucket."""
    placed = shared.join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left")
    placed = placed.select("bucket", "cid", "size", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "cid").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    rows = materialize(placed.join(open_.select("bucket", "n"), "bucket"))
    one = rows.groupBy("cid").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.first("size").alias("size"), F.first("linked").alias("linked"), F.first("component").alias("component"))
    # A component that fills tiles has its own; small ones go with their neighbours, or each would be a tile.
    large = one.where("linked").groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") >= TILE)
    one = one.join(large, "component", "left").withColumn("family", F.when(F.col("c").isNotNull(), F.xxhash64(F.lit(1), "component")).otherwise(F.xxhash64(F.lit(2), "home")))
    sizes = one.groupBy("family").agg(F.count("*").alias("m"))
    one = materialize(one.join(sizes, "family").select("cid", "size", "component", F.xxhash64("family", _salted("m")).alias("tile")))
    spots = rows.select("bucket", "cid").join(one, "cid").groupBy("bucket", "tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"))
    spots = materialize(spots)
    left, right = (spots.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high", "least", "most"))) for s in "ab")
    apart = (F.least("low_a", "low_b") != F.greatest("high_a", "high_b")) & (den * F.col("most_a") >= num * F.col("least_b")) & (den * F.col("most_b") >= num * F.col("least_a"))
    pairs = left.join(right, "bucket").where((F.col("tile_a") < F.col("tile_b")) & apart).select("tile_a", "tile_b")
    own = spots.where("low <> high").select(F.col("tile").alias("tile_a"), F.col("tile").alias("tile_b"))
    pairs = materialize(pairs.unionByName(own).distinct().withColumn("job", F.xxhash64("tile_a", "tile_b")))
    sides = pairs.select("job", F.col("tile_a").alias("tile"), F.when(F.col("tile_a") == F.col("tile_b"), 2).otherwise(0).alias("side"))
    sides = sides.unionByName(pairs.where("tile_a <> tile_b").select("job", F.col("tile_b").alias("tile"), F.lit(1).alias("side")))
    return sides.join(one, "tile").select("job", "cid", "side", "component", "size")


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, cid, component_id): component_id is the smallest key that links reach.

    Links: Jaccard of the sets of n-word tokens of lower-cased words >= num / den.
    """
    members, classes, frequent = profile(docs, n, key, text)
    index = materialize(_index(docs, n, text, classes, frequent, num, den))
    wide = index.groupBy("bucket").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select("bucket")
    shared = materialize(index.join(wide, "bucket").distinct())
    discard(index)

    def sets(jobs: DataFrame, short: bool = False) -> DataFrame:
        return _token_sets(docs, members, jobs.select("cid").distinct(), n, key, text, short)

    cells = members.select("cid", F.col("cells").alias("tokens")).dropDuplicates(["cid"])
    jobs = materialize(_stars(shared, num, den))
    jobs = materialize(_likely(jobs, cells, np.uint8, num, den))
    links = materialize(_compare(jobs, sets(jobs), num, den))
    comps = materialize(connected_components(links))
    jobs = materialize(_tiles(shared, comps, num, den))
    jobs = materialize(_likely(jobs, cells, np.uint8, num, den))
    jobs = materialize(_likely(jobs, sets(jobs, True), np.uint16, num, den))
    more = materialize(_compare(jobs, sets(jobs), num, den))
    if not more.isEmpty():
        comps = materialize(connected_components(links.unionByName(more)))
    full = members.drop("cells").join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = full.where("size > 0").groupBy("component").agg(F.min("key").alias("component_id"))
    return full.join(least, "component", "left").select(
        F.col("key").alias(key), "size", "cid", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )
