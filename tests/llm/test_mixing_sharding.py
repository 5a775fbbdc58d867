from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomdex.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, target string, shard string"


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by the definition: shares, caps, and the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = rest / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > most * sizes[s]}
        if not over:
            out |= {s: share * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= over
    return out


def corpus(spark, n=600):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), None if i % 11 == 0 else "abc"[min(2, i % 23 // 9)] if i % 5 else "tiny" if i < 20 else "a", "t", "s") for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "empty", "t", "s"), (n + 1, "", "empty", "t", "s")], SCHEMA)


def test_targets_and_totals(spark):
    got = mixing.copies(corpus(spark)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 3
    want = water(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 37)
    again = {(r.doc_id, r.copies) for r in mixing.copies(corpus(spark).repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mixed_rows(spark):
    docs = corpus(spark, 200)
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.copies(docs.limit(0)).count() == 0


def test_shards(spark):
    docs = corpus(spark).unionByName(corpus(spark, 5)).unionByName(spark.createDataFrame([(None, "x", "a", "t", "s")] * 3, SCHEMA))
    got = sharding.assign(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert len(slots) == 8 and max(map(len, slots.values())) < 2 * len(got) / 8
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by_key.values())
    sizes = {(r.doc_id, r["size"]) for r in got}
    assert (600, 1) in sizes and (601, 1) in sizes
    assert sharding.assign(docs.limit(0)).count() == 0


def test_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), sharding.shard_of(F.col("id"), [1.0, 3.0]).alias("s"))
    share = keys.where("s = 1").count() / 20_000
    assert abs(share - 0.75) < 0.02
    for bad in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("doc_id"), bad)
