from __future__ import annotations

import xxhash
from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions import hashing
from loomdex.operators import dead_letters, merkle, store
from loomdex.operators.store import ChunkStore
from loomdex.plans.engine import Engine, Settings


def rows(spark, *paths, content="c"):
    data = [(f"{p}:1-1:f", p, content, "typescript", None, "function", 1, 1, "h", [1.0, 0.0], 0) for p in paths]
    return spark.createDataFrame(data, schemas.CHUNKS)


def test_store_contract(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), 2)
    assert s.stats()["totalChunks"] == 0 and s.stats()["fragmentationRatio"] == 0
    assert s.upsert(rows(spark, "src/a.ts", "src/nested/b.ts", "tests/t.ts")) == {"deleted": 0, "newFiles": 3}
    assert s.upsert(rows(spark, "src/a.ts", content="new")) == {"deleted": 1, "newFiles": 0}
    assert s.rows().where("content = 'new'").count() == 1 and s.stats()["totalChunks"] == 3
    assert s.delete_prefix("sr") == 0
    assert s.delete_prefix("src") == 2
    assert s.delete_path("none") == 0
    assert s.rename("tests/t.ts", "tests/u.ts") == 1
    assert [tuple(r) for r in s.rows().select("id", "filePath").collect()] == [("tests/u.ts:1-1:f", "tests/u.ts")]
    assert s.stats()["staleCount"] == 4 and s.stats()["fragmentationRatio"] == 4 / 5
    again = ChunkStore(spark, str(tmp_path / "s"), 2)
    assert again.compact("t")["removed"] == 4 and again.stats()["staleCount"] == 0
    assert again.compact("t")["compacted"] is False


def test_unusable_vectors_become_zeros(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), 2)
    bad = rows(spark, "a").withColumn("vector", F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float"))).unionByName(rows(spark, "b").withColumn("vector", F.lit(None).cast("array<float>")))
    s.upsert(bad)
    assert {tuple(r.vector) for r in s.rows().collect()} == {(0.0, 0.0)}


def test_compaction_thresholds():
    assert store.should_compact(8, 2) and not store.should_compact(9, 1)
    assert store.should_compact(100, 1, threshold=0) and not store.should_compact(100, 0, threshold=0)


def test_replacing_leaves_no_stale_rows(spark):
    old = rows(spark, "a", "b")
    new = rows(spark, "a", content="n").withColumn("id", F.lit("other"))
    assert store.upsert(old, new).count() == 2
    assert store.upsert(old, new.limit(0), spark.createDataFrame([("b",)], "filePath string")).count() == 1


def test_hashes(spark):
    df = spark.createDataFrame([("héllo", bytearray(b"x" * (3 << 20))), (None, bytearray(b"ab"))], "s string, b binary")
    got = df.select(hashing.content_hash(F.col("s")), hashing.partial_hash(F.col("b"))).collect()
    big = b"x" * (1 << 20) * 2 + str(3 << 20).encode()
    assert tuple(got[0]) == (xxhash.xxh64("héllo".encode()).hexdigest(), xxhash.xxh64(big).hexdigest())
    assert tuple(got[1]) == (None, xxhash.xxh64(b"ab").hexdigest())


def tree_files(spark, n=101, packages=5):
    return spark.createDataFrame([(f"packages/p{p}/src/f{i}.ts", f"h{i}") for p in range(packages) for i in range(n - 1)], "path string, hash string")


def test_tree(spark):
    files = tree_files(spark)
    nodes = merkle.build(files, "sha256").cache()
    assert nodes.count() == 500 + 5 * 2 + 1
    assert merkle.subtree(nodes, "packages/p0/src").count() == 101
    gone = spark.createDataFrame([("packages/p0/src",)], "path string")
    assert nodes.count() - merkle.delete_subtrees(nodes, gone).count() == 101
    root = merkle.root_hash(nodes, "sha256").first()[0]
    assert root == merkle.root_hash(merkle.build(files.orderBy(F.desc("path")), "sha256"), "sha256").first()[0]
    changed = spark.createDataFrame([("packages/p1/src/f3.ts", "new"), ("packages/p9/x.ts", "h")], "path string, hash string")
    updated = merkle.update(nodes, changed, gone, "sha256")
    want = files.where("not startswith(path, 'packages/p0/') and path <> 'packages/p1/src/f3.ts'").unionByName(changed)
    assert {tuple(r) for r in updated.collect()} == {tuple(r) for r in merkle.build(want, "sha256").collect()}
    assert merkle.root_hash(nodes.limit(0), "sha256").first()[0] is None


def test_diff_renames_and_orphans(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    changes = merkle.diff(old, new)
    assert {tuple(r) for r in changes.collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert tuple(merkle.reconciliation(changes).first()) == (1, 1, 1, 1)
    ev = spark.createDataFrame([(1, "deleted", "x", "h"), (2, "deleted", "y", "h"), (3, "added", "n1", "h"), (4, "added", "n2", "h"), (5, "added", "n3", "h"), (6, "added", "n4", None)], "seq long, type string, filePath string, contentHash string")
    assert {(r.oldPath, r.newPath) for r in merkle.rename_pairs(ev).collect()} == {("x", "n1"), ("y", "n2")}
    used, rest = merkle.apply_renames(ev, spark.createDataFrame([("x",)], "filePath string"))
    assert used.count() == 1 and sorted(r.seq for r in rest.collect()) == [2, 4, 5, 6]
    nodes = merkle.build(spark.createDataFrame([("k/a", "1"), ("g/h/b", "2")], "path string, hash string"), "sha256")
    orphans, kept = merkle.collect_orphans(nodes, spark.createDataFrame([("k/a",)], "path string"))
    assert [r.path for r in orphans.collect()] == ["g/h/b"] and sorted(r.path for r in kept.collect()) == ["k", "k/a"]


def test_cache_and_dead_letters(spark):
    cache = spark.createDataFrame([("h1", [1.0], 1, "2024-01-01")], "hash string, vector array<float>, dimensions int, createdAt string").withColumn("createdAt", F.col("createdAt").cast("timestamp"))
    put = store.cache_put(cache, cache.withColumn("createdAt", F.lit("2025-01-01").cast("timestamp")).withColumn("vector", F.array(F.lit(2.0).cast("float"))))
    (r,) = put.collect()
    assert r.vector == [2.0] and r.createdAt.year == 2024
    entry = spark.createDataFrame([("i", "f", "c", "m", 3, 1, "2024-01-01", "2024-01-01", None)], schemas.DEAD_LETTERS.replace("timestamp", "string"))
    entry = entry.select(*[F.col(c).cast("timestamp") if c.endswith("At") else F.col(c) for c in entry.columns])
    again = dead_letters.enqueue(entry, entry.withColumn("id", F.lit("j")).withColumn("errorMessage", F.lit("n")).withColumn("recoveryAttempts", F.lit(0)))
    (r,) = again.collect()
    assert (r.id, r.errorMessage, r.recoveryAttempts) == ("i", "n", 1)
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    files = spark.createDataFrame([("f", "c")], "filePath string, contentHash string")
    outcome = lambda **k: dead_letters.sweep(entry, files, now, **k).first().outcome
    assert outcome() == "retried" and outcome(healthy=False) == "skipped"
    bad = spark.createDataFrame([("f", False)], "filePath string, ok boolean")
    assert outcome(results=bad) == "kept" and outcome(results=bad, attempts=2) == "abandoned"
    assert dead_letters.sweep(entry, files.limit(0), now).first().outcome == "purged"
    assert dead_letters.after_sweep(dead_letters.sweep(entry, files, now, bad), now).first().recoveryAttempts == 2


def test_engine(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", "import os\n\n\ndef find(x):\n    return x\n"), ("b.txt", "text", "hello find me")], "filePath string, language string, content string")
    e = Engine(spark, files, ChunkStore(spark, str(tmp_path / "s"), 64), Settings())
    assert e.reindex()["status"] == "complete"
    assert e.index_status()["totalFiles"] == 2 and e.index_status()["totalChunks"] == 3
    assert e.semantic_search("hello find me", 1).first().filePath == "b.txt"
    assert [(r.filePath, r.lineNumber) for r in e.grep_search("find").collect()] == [("a.py", 4), ("b.txt", 1)]
    found = e.hybrid_search("hello find me", include_snippet=True).results.collect()
    assert found[0].chunk.filePath == "b.txt" and found[0].source == "hybrid" and found[0].snippet == "hello find me"
    assert e.get_context("a.py", 4, 4).first().content == "def find(x):"
    batch = spark.createDataFrame([(1, "deleted", "b.txt", None), (2, "modified", "a.py", None)], "seq long, type string, filePath string, contentHash string")
    e.apply_events(batch)
    assert e.index_status()["totalFiles"] == 1
    e._running.acquire()
    assert e.reindex()["status"] == "already_running"
    assert Settings.load({"dimensions": "7", "window": "x"}, {"LOOMDEX_DIMENSIONS": "9"}).dimensions == 9
