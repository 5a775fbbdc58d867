"""Limits, retries, caches, registries, degraded searches and the store's versions."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions import globs, limits, vectors
from loomdex.operators import events, metrics
from loomdex.operators.store import Change, ChunkStore
from loomdex.plans.engine import Engine, Settings


def test_arguments():
    assert limits.search_arguments("x", 100, 1000, 50)["context_lines"] == 20
    for bad in (("", 1), (" ", 1), ("x", 0), ("x", 101), ("x", True), ("x" * 10_001, 1)):
        with pytest.raises(limits.InvalidArgument):
            limits.search_arguments(*bad)


def test_retries():
    assert list(limits.delays(4, 1.0, 3.0)) == [1.0, 2.0, 3.0]
    assert all(0 <= x <= 2.0 for x in limits.delays(3, 1.0, jitter=random.Random(1)))
    waited, tries = [], []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no")
        return "done"

    assert limits.with_retries(fails, 3, sleep=waited.append) == "done" and waited == [1.0, 2.0]
    with pytest.raises(KeyError):
        limits.with_retries(lambda: {}["x"], 3, retriable=lambda e: not isinstance(e, KeyError), sleep=waited.append)
    assert len(waited) == 2


def test_lru():
    c = limits.LruCache(2)
    assert [c.get(k, lambda k=k: k * 2) for k in (1, 2, 1, 3, 2)] == [2, 4, 2, 6, 4]
    assert (c.hits, c.misses, c.evicted, len(c)) == (1, 4, 2, 2)
    none = limits.LruCache(0)
    none.get(1, lambda: 1)
    assert len(none) == 0


def test_registry():
    r = metrics.Registry()
    r.register("n", "counter", "told")
    r.register("h", "histogram", bounds=(1.0, 2.0))
    r.add("n", 2, kind="a")
    r.add("n", kind="a")
    for v in (0.5, 1.5, 9.0):
        r.add("h", v)
    got = {(m, tuple(sorted(labels.items()))): v for _, _, _, labels, m, v in r.rows()}
    assert got == {("n", (("kind", "a"),)): 3.0, ("h_bucket", (("le", "1.0"),)): 1, ("h_bucket", (("le", "2.0"),)): 2, ("h_bucket", (("le", "+Inf"),)): 3, ("h_sum", ()): 11.0, ("h_count", ()): 3}
    with pytest.raises(ValueError):
        r.add("n", -1)


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.ts", ["a.ts", "b/c/a.ts"], ["a.tsx"]), ("/a/*.ts", ["a/x.ts"], ["b/a/x.ts", "a/b/x.ts"]), ("a/**/x", ["a/x", "a/b/c/x"], ["x"]), ("{a,b}.[ch]", ["a.c", "d/b.h"], ["c.c", "a.x"]), ("[!a].c", ["b.c"], ["a.c"])])
def test_line_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in [*yes, *no]], "p string")
    assert {r.p for r in rows.where(globs.line_glob_filter(F.col("p"), [glob])).collect()} == set(yes)


def test_hidden_and_excluded_paths(spark):
    rows = spark.createDataFrame([("a.py",), (".git/a.py",), ("b/.x",), ("b/a.py",)], "p string")
    found = lambda *g, **k: {r.p for r in rows.where(globs.line_glob_filter(F.col("p"), g, **k)).collect()}
    assert found() == {"a.py", "b/a.py"} and found("!b/**") == {"a.py"} and len(found(hidden=True)) == 4


def test_null_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), (None,), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(vectors.cosine_arrow([1.0, 0.0])("v")).collect()] == [1.0, None, 0.0]


def chunk_rows(spark, rows):
    made = spark.createDataFrame(rows, "id string, filePath string, content string")
    return made.select("id", "filePath", "content", F.lit("text").alias("language"), F.lit(None).cast("string").alias("symbolName"), F.lit("file").alias("symbolKind"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"), F.lit("h").alias("hash"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"))


def test_store_versions(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), 2, capacity=4)
    s.rebuild(chunk_rows(spark, [(f"f{i}:1", f"f{i}", "x") for i in range(20)]), expected=20)
    other = ChunkStore(spark, str(tmp_path / "s"), 2, capacity=4)
    before = {b: list(h["parts"]) for b, h in s.tables.buckets("chunks").items()}
    assert len(before) == 8
    s.upsert(chunk_rows(spark, [("f3:9", "f3", "y")]))
    assert sum(before[b] != h["parts"] for b, h in s.tables.buckets("chunks").items()) == 1  # only that file's bucket
    assert other.rows().count() == 20  # a reader keeps its version
    with pytest.raises(RuntimeError):
        other.upsert(chunk_rows(spark, [("f4:9", "f4", "y")]))
    other.refresh()
    assert {r.id for r in other.rows(["f3", "f5"]).collect()} == {"f3:9", "f5:1"}
    for i in range(4):
        s.upsert(chunk_rows(spark, [(f"f0:{i}", "f0", "y")]))
    assert s.compact_when_idle("t", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)) is None
    assert s.compact_when_idle("t", datetime(2024, 1, 1), datetime(2024, 1, 2), force=True)["compacted"] and s.stats()["totalFiles"] == 20
    s.tables.keep_seconds = 0
    s.tables.expire()
    held = {x[0].split("/")[0] for h in s.tables.buckets("chunks").values() for x in h["parts"]}
    assert {n for n in s.tables.folder.names() if n.startswith("d-")} == held and s.rows().count() == 20


def engine(spark, tmp_path, **more):
    files = spark.createDataFrame([("a.txt", "text", "one find"), ("d/b.txt", "text", "two find"), ("d/c.txt", "text", "x" * 50)], schemas.FILES)
    return Engine(spark, files, ChunkStore(spark, str(tmp_path / "s"), 64), Settings(max_file_bytes=20), **more)


def test_a_failing_leg_is_empty(spark, tmp_path):
    told = []
    e = engine(spark, tmp_path, hook=lambda what, values: told.append(what))
    assert e.reindex(now="t1")["status"] == "complete"
    assert e.index_status()["totalFiles"] == 2 and e.index_status()["skippedFiles"] == 1 and e.store.counters.lastIndexedAt == "t1"
    e.embedder = (e.embedder[0], lambda text: [1.0])  # of the wrong length
    found = e.hybrid_search("find", fixed=True)
    assert set(found.failed) == {"semantic"} and {r.chunk.filePath for r in found.results.collect()} == {"a.txt", "d/b.txt"} and told == ["index", "search"]


def test_completion_and_deletion(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.reindex(now="t1")
    entry = spark.createDataFrame([("i", "d/b.txt", "c", "m", 3, 1, None, None, None)], schemas.DEAD_LETTERS)
    e.store.tables.commit({"dead_letters": Change(entry)})
    assert e.reindex(now="t2")["status"] == "incomplete" and e.store.counters.lastIndexedAt == "t1" and e.index_status()["lastError"] == "1 files failed to index"
    e.apply_events(spark.createDataFrame([(1, "deleted", "d", None)], "seq long, type string, filePath string, contentHash string"))
    assert [r.filePath for r in e.store.rows().collect()] == ["a.txt"] and e.dead_letters.count() == 0
    assert e.tree.where("startswith(path, 'd')").count() == 0
    assert e.reindex(full=True, now="t3")["status"] == "complete" and e.store.counters.lastFullScanAt == "t3"


def test_drain_and_start(spark, tmp_path):
    batch = spark.createDataFrame([(i, "modified", f"f{i}", None) for i in range(9)], "seq long, type string, filePath string, contentHash string")
    seen = []

    def apply(part):
        paths = [r.filePath for r in part.collect()]
        seen.append(paths)
        if "f4" in paths:
            raise OSError("locked")

    failed, error = events.drain(batch, apply, 3)
    assert sorted(p for x in seen for p in x) == [f"f{i}" for i in range(9)] and str(error) == "locked"
    assert "f4" in {r.filePath for r in failed.collect()}
    assert events.drain(batch, lambda part: None) == (None, None)
    e = engine(spark, tmp_path)
    changes = spark.createDataFrame([(1, "deleted", "a.txt", None, datetime(2024, 1, 1))], "seq long, type string, filePath string, contentHash string, detectedAt timestamp")
    assert e.start(changes, F.lit("2024-01-02").cast("timestamp"), "t")["followed"] == "changes"
    assert [r.filePath for r in e.store.rows().collect()] == ["d/b.txt"]
