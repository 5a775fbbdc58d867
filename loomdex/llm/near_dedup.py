"""SimHash near-dedup: fingerprints within a few bits of each other, found with vantage-point trees.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Equal
fingerprints are one point. A tree of vantage points over a bounded sample of the points
cuts the space into shards: at each node a point goes inside or outside by its Hamming
distance to the vantage point and a radius. Each shard's own points are disjoint. A point
whose distance is within ``bits`` of the radius may have a partner on the other side, so it
also visits that side (triangle bound); of a pair that a node parts only the inside point
visits. In a shard a tree over its own points is built and searched by own and visiting
points together, branch by branch under the same bounds, and small leaves are compared
exactly. A shard with many visitors is dealt to several tasks with its own points in each.

Points that are joined already need no further comparison: in a shard, a branch all of
whose points are in one group is not searched by points of that group, and only links that
join two groups come out. Before shards are filled, points within ``bits`` of a vantage
point they meet are linked to it; the groups that then have more points than a shard should
hold ("large") send their points only to shards that hold another large group, and all
other points visit both ways instead. So a great group of near copies, whose points lie in
every band, is not copied into every one of its shards. Nothing is dropped by either rule.

Defined cases: a null or empty text and one without a word have fingerprint zero, a point
like any other; fewer words than a shingle are one shingle; shingles count as often as they
occur; very long texts are hashed in blocks; bytes that are no UTF-8 are hashed as they
are; rows with a null key belong to components and do not name them (a component of null
keys alone has null); repeated rows come out each; only the named columns are read, so
others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.llm._graph import connected_components
from loomdex.llm._store import materialize
from loomdex.llm._words import column, slices

WORDS, BITS, SEED = 4, 4, 42
#: Shingles of a text that are hashed before their bits are summed.
BLOCK = 1 << 16
#: Points of the sample that shards are cut by, points a shard should hold, and points of a task's visitors, about.
SAMPLE, SHARD, VISITORS = 1 << 15, 2_048, 1 << 16
#: Points that are dealt to shards at a time.
PIECE = 1 << 14
#: Points of a leaf, which are compared with all that reach it.
LEAF = 48


# ---------------------------------------------------------------- fingerprints


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 bits of a text (UTF-8): lower case of A-Z, shingles of words, XXH64 of each joined by spaces."""
    import xxhash

    digest = xxhash.xxh64_digest
    plain = b" ".join(raw.lower().split())  # of bytes: ASCII letters and the six ASCII white spaces only
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(plain)]])
    many = max(len(starts) - words + 1, 1)
    starts, ends = starts[:many], ends[min(words, len(ends)) - 1 :]
    counts = np.zeros(2048, np.int64)
    place = np.arange(8) * 256
    for at in range(0, many, BLOCK):
        spots = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.frombuffer(b"".join([digest(plain[i:j], seed) for i, j in spots]), np.uint8)
        counts += np.bincount((hashes.reshape(-1, 8) + place).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones.ravel() > many).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fingerprint long) of every text."""
    schema = StructType([*docs.select(key).schema.fields, *docs.sparkSession.createDataFrame([], "fingerprint long").schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            raw = column(part, text).cast(pa.binary())
            points = np.array([fingerprint(t.as_py() or b"", words, seed) for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([column(part, key), pa.array(points.view(np.int64))], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


# ---------------------------------------------------------------- trees


def distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def choose(points: np.ndarray, bits: int, seed: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that part the points at the least cost in visits; None if nothing parts them.

    Inside are points of a distance up to the radius. The cost weighs the share of points
    near the radius, which would be searched twice, against how evenly the points are parted.
    """
    best, found = np.inf, None
    for k in np.random.default_rng(seed).integers(0, len(points), tries):
        share = np.bincount(distance(points, points[k]), minlength=65) / len(points)
        inside = np.cumsum(share)[:64]
        padded = np.concatenate([np.zeros(bits + 1), np.cumsum(share), np.ones(bits)])
        near = padded[2 * bits + 1 : 2 * bits + 65] - padded[1:65]  # distances from radius - bits + 1 to radius + bits
        live = (inside > 0) & (inside < 1)
        if not live.any():
            continue
        p = np.where(live, inside, 0.5)
        cost = np.where(live, (np.log1p(near) + 0.02) / -(p * np.log(p) + (1 - p) * np.log1p(-p)), np.inf)
        radius = int(np.argmin(cost))
        if cost[radius] < best:
            best, found = cost[radius], (points[k], radius)
    return found


@dataclass
class Tree:
    """Inner nodes: vantage point, radius and two children; a child below zero is shard -child - 1."""

    points: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    shards: int


def grow(sample: np.ndarray, most: int, bits: int = BITS) -> Tree:
    """A tree whose shards hold at most about ``most`` points of the sample each."""
    nodes: list[list] = []
    shards = 0
    todo = [(sample, -1, 0)]  # points, node above, side
    while todo:
        held, above, side = todo.pop()
        found = choose(held, bits, len(nodes)) if len(held) > max(most, 1) else None
        if found is None:
            shards += 1
            here = -shards
        else:
            here = len(nodes)
            nodes.append([*found, 0, 0])
            near = distance(held, found[0]) <= found[1]
            todo += [(held[near], here, 2), (held[~near], here, 3)]
        if above >= 0:
            nodes[above][side] = here
    points, radius, inside, outside = zip(*nodes) if nodes else ((),) * 4
    return Tree(np.array(points, np.uint64), np.array(radius, np.int16), np.array(inside, np.int64), np.array(outside, np.int64), shards)


def route(tree: Tree, points: np.ndarray, bits: int, inward: bool = False, barred=None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("own" or "visit", index of a point, shard) in parts, and ("star", index, node) where a point is within ``bits``
    of a vantage point. inward: own points visit inward too. barred(index, child): visits that need not be made."""
    index, node, own = np.arange(len(points)), np.full(len(points), 0 if len(tree.points) else -1), np.ones(len(points), bool)
    while len(index):
        done = node < 0
        for kind, chosen in (("own", done & own), ("visit", done & ~own)):
            yield kind, index[chosen], -node[chosen] - 1
        index, node, own = index[~done], node[~done], own[~done]
        if not len(index):
            return
        away = np.bitwise_count(points[index] ^ tree.points[node]).astype(np.int16)
        yield "star", index[away <= bits], node[away <= bits]
        radius = tree.radius[node]
        inner = away <= radius
        turned = inner & (away > radius - bits) | ~inner & (away <= radius + bits) & (inward | ~own)
        other = np.where(inner, tree.outside[node], tree.inside[node])
        if barred is not None:
            turned[turned] = ~barred(index[turned], other[turned])
        node = np.concatenate([np.where(inner, tree.inside[node], tree.outside[node]), other[turned]])
        index, own = np.concatenate([index, index[turned]]), np.concatenate([own, np.zeros(int(turned.sum()), bool)])


def spans(tree: Tree, shards: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest number that the shards below each child hold, at index child + tree.shards; (1, 0) for none."""
    low, high = np.full(tree.shards + len(tree.points), 1, np.int64), np.zeros(tree.shards + len(tree.points), np.int64)
    for shard, (a, b) in shards.items():
        low[tree.shards - shard - 1], high[tree.shards - shard - 1] = a, b
    for node in range(len(tree.points) - 1, -1, -1):  # children come after their node
        below = [c + tree.shards for c in (tree.inside[node], tree.outside[node]) if low[c + tree.shards] <= high[c + tree.shards]]
        if below:
            low[node + tree.shards], high[node + tree.shards] = low[below].min(), high[below].max()
    return low, high


class Groups:
    """Union-find over small integers, with whole-array steps for stars."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def of(self, members: np.ndarray) -> np.ndarray:
        at = self.up[members]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                self.up[members] = at
                return at
            at = above

    def star(self, centre: int, members: np.ndarray) -> list[tuple[int, int]]:
        """Joins members to a centre; a link for each group that was apart from it."""
        roots, first = np.unique(self.of(members), return_index=True)
        here = self.of(np.array([centre]))[0]
        fresh = members[first[roots != here]]
        if len(fresh):
            every = np.append(roots, here)
            self.up[every] = every.min()
        return [(int(centre), x) for x in fresh.tolist()]


def search(own: np.ndarray, visiting: np.ndarray, bits: int = BITS, groups: np.ndarray | None = None) -> np.ndarray:
    """Links (pairs of points, two columns) that connect what pairs within ``bits`` of an own and another point connect.

    groups: numbers of groups that own and visiting points (in this order) are known to form.
    """
    points = np.concatenate([own, visiting])
    joined, out = Groups(len(points)), []
    if groups is not None and len(points):
        first = np.unique(groups, return_index=True, return_inverse=True)
        joined.up = first[1][first[2]]
    todo = [(np.arange(len(own)), np.arange(len(points)), 0)]
    while todo:
        held, asking, depth = todo.pop()
        if not len(held) or not len(asking):
            continue
        roots = joined.of(held)
        if (roots == roots[0]).all():
            asking = asking[joined.of(asking) != roots[0]]
            if not len(asking):
                continue
        found = choose(points[held], bits, depth, 2) if len(held) > LEAF else None
        if found is None:
            for at in range(0, len(held), LEAF):  # more than a leaf only if no radius parts the points
                part = held[at : at + LEAF]
                near = np.bitwise_count(points[part][:, None] ^ points[asking][None, :]) <= bits
                for i in np.flatnonzero(near.any(axis=1)):
                    out += joined.star(part[i], asking[near[i]])
            continue
        point, radius = found
        away, asked = distance(points[held], point), distance(points[asking], point)
        out += joined.star(held[np.argmin(away)], held[away <= bits])
        todo += [(held[away > radius], asking[asked > radius - bits], depth + 1), (held[away <= radius], asking[asked <= radius + bits], depth + 1)]
    return points[np.array(out, np.int64).reshape(-1, 2)]


# ---------------------------------------------------------------- shards


def _table(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)


def _pieces(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The points of batches, ``PIECE`` at a time, and other columns of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            yield column(part, "fingerprint").to_numpy().view(np.uint64), [column(part, n).to_numpy(zero_copy_only=False) for n in names]


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): pairs of points (column ``fingerprint``, distinct) within ``bits`` that connect all that such pairs connect."""
    spark = points.sparkSession
    n = points.count()
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "fingerprint"), 1)
    # Hash order takes about the sample's size from a table of any size, in expectation never more.
    taken = points if n <= sample else points.where(mark < int((1 << 63) * (sample / n)))
    held = np.sort(taken.select("fingerprint").toArrow()["fingerprint"].to_numpy()).view(np.uint64)
    tree = grow(held, max(1, int(shard * len(held) / max(n, 1))), bits)
    sent = spark.sparkContext.broadcast(pickle.dumps(tree))

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(sent.value)
        for values, _ in _pieces(batches):
            for kind, index, node in route(tree, values, bits):
                if kind == "star":
                    ends = values[index], tree.points[node]
                    yield _table(["a", "b"], *(e[ends[0] != ends[1]].view(np.int64) for e in ends))

    starred = materialize(points.select("fingerprint").mapInArrow(stars, "a long, b long"))
    joined = materialize(connected_components(starred))
    large = materialize(joined.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("component"))
    grouped = points.select("fingerprint").join(joined.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").join(large.withColumn("large", F.lit(True)), "component", "left")
    grouped = materialize(grouped.select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), F.coalesce("large", F.lit(False)).alias("large")))
    any_large = not large.isEmpty()

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(sent.value)
        for values, (component, _) in _pieces(batches, "component", "large"):
            for kind, index, at in route(tree, values, bits):
                if kind == "own":
                    yield _table(["shard", "low", "high"], at, component[index], component[index])

    # The least and greatest large group of each shard: a row a shard, whatever the number of points.
    ranges = grouped.where("large").mapInArrow(homes, "shard long, low long, high long").groupBy("shard").agg(F.min("low"), F.max("high"))
    ranges = {shard: (low, high) for shard, low, high in ranges.collect()} if any_large else {}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(sent.value)
        low, high = spans(tree, ranges)
        for values, (component, large) in _pieces(batches, "component", "large"):

            def barred(index: np.ndarray, child: np.ndarray) -> np.ndarray:
                """A large group's points visit only where there is another large group."""
                child, one = child + tree.shards, component[index]
                return large[index] & ((low[child] > high[child]) | (low[child] == one) & (high[child] == one))

            parts: dict[bool, list] = {True: [], False: []}
            for kind, index, at in route(tree, values, bits, any_large, barred if any_large else None):
                if kind != "star" and len(index):
                    parts[kind == "own"].append((index, at))
            for own, held in parts.items():
                if held:
                    yield pack(*map(np.concatenate, zip(*held)), values.view(np.int64), component, own)

    def pack(index: np.ndarray, at: np.ndarray, values: np.ndarray, component: np.ndarray, own: bool) -> pa.RecordBatch:
        """A row for each shard with all of the points, so that rows do not grow with visits."""
        order = np.argsort(at, kind="stable")
        index, at = index[order], at[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = pa.array(np.append(cuts, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[index])) for v in (values, component)]
        return pa.RecordBatch.from_arrays([pa.array(at[cuts]), pa.array(np.full(len(cuts), own)), *lists], ["shard", "own", "points", "groups"])

    dealt = materialize(grouped.mapInArrow(deal, "shard long, own boolean, points array<long>, groups array<long>"))
    # One row a shard: how many tasks its visitors need.
    tasks = dealt.groupBy("shard").agg((F.floor(F.sum(F.when(F.col("own"), 0).otherwise(F.size("points"))) / VISITORS) + 1).cast("int").alias("tasks"))
    told = dealt.join(F.broadcast(tasks), "shard")
    salts = F.when(F.col("own"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("points"), F.col("tasks")).cast("int")))
    salted = told.select("shard", "own", "points", "groups", F.explode(salts).alias("salt"))

    def compare(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        parts = [(table["points"].filter(pa.array(k)).combine_chunks().flatten().to_numpy(), table["groups"].filter(pa.array(k)).combine_chunks().flatten().to_numpy()) for k in (own, ~own)]
        found = search(parts[0][0].view(np.uint64), parts[1][0].view(np.uint64), bits, np.concatenate([parts[0][1], parts[1][1]]))
        return pa.table([pa.array(found[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])

    found = materialize(salted.groupBy("shard", "salt").applyInArrow(compare, "a long, b long"))
    return starred.unionByName(found)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(key, fingerprint long, component): component is the smallest key that links reach."""
    rows = materialize(fingerprints(docs, key, text, words, seed))
    points = materialize(rows.groupBy("fingerprint").agg(F.min(key).alias("first")))
    joined = connected_components(links(points, bits, shard))
    placed = points.join(joined.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = materialize(placed.select("fingerprint", "first", "component"))
    names = named.groupBy("component").agg(F.min("first").alias("__least"))
    told = named.join(names, "component").select("fingerprint", F.col("__least").alias("component"))
    return rows.join(told, "fingerprint").select(key, "fingerprint", "component")
