"""Stored tables: what a commit writes, what readers see, splits, leases, batches that come again, and index runs on them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions import vectors
from loomdex.operators import dead_letters, embedding, merkle
from loomdex.operators.store import ChunkStore
from loomdex.operators.tables import Change, Spec, Tables, bucket_of, directory
from loomdex.plans.engine import Engine, SearchFailed, Settings

SPEC = Spec("t", "k string, v string", "k", "k")


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), "k string, v string")


def held(tables, state=None):
    return sorted((r.k, r.v) for r in tables.read("t", state=state).collect())


def make(spark, path, **how):
    return Tables(spark, str(path), [SPEC], **how)


def test_directory_of_uneven_depths():
    buckets = ["1-0", "2-1", "3-3", "3-7"]
    assert directory(buckets) == ["1-0", "2-1", "1-0", "3-3", "1-0", "2-1", "1-0", "3-7"]


def test_a_commit_writes_what_changed(spark, tmp_path):
    """One row into stores of 100 and 1,000 rows: the same bytes, but for digits of numbers in the log."""
    written = []
    for n in (100, 1000):
        t = make(spark, tmp_path / str(n), capacity=20)
        t.commit({"t": Change(rows(spark, ((f"k{i}", "x" * 200) for i in range(n))), whole=True, expected=n)})
        before = t.folder.bytes()
        t.commit({"t": Change(rows(spark, [("k7", "new")]))})
        written.append(t.folder.bytes() - before)
        assert t.read("t", rows(spark, [("k7", "")])).collect()[0].v == "new" and t.state.live("t") == n
    assert abs(written[0] - written[1]) < 32


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    """Upserts, deletions, replacements of all and merges with splits, read back also by a reader that starts from the log."""
    rng, want, t = random.Random(3), {}, make(spark, tmp_path, capacity=12)
    for step in range(20):
        new = {f"k{rng.randrange(60)}": f"v{step}" for _ in range(rng.randrange(0, 14))}
        gone = [f"k{rng.randrange(60)}" for _ in range(rng.randrange(0, 5))]
        whole = step == 11
        done = t.commit({"t": Change(rows(spark, new.items()), None if whole else spark.createDataFrame([(k,) for k in gone], "k string"), whole)})["t"]
        old = want
        want = {} if whole else {k: v for k, v in old.items() if k not in gone}
        want = want | new
        if not whole:
            dead = {k for k in old if k in gone or k in new}
            assert done == {"came": len(new), "dead": len(dead), "keys": len(dead), "new": len(new.keys() - old.keys()), "left": len([k for k in dead if k not in new])}
        if step % 4 == 3:
            t.compact("t")
        assert t.state.live("t") == len(want)
    assert held(t) == sorted(want.items()) == held(make(spark, tmp_path))
    assert len({len(b.split("-")[0]) for b in t.buckets("t")}) >= 1 and len(t.buckets("t")) > 1
    names = t.folder.names("log")
    assert any(".state" in n for n in names)


def test_only_a_bucket_that_outgrows_is_split(spark, tmp_path):
    t = make(spark, tmp_path, capacity=30)
    t.commit({"t": Change(rows(spark, ((f"k{i}", "x") for i in range(80))))})
    assert t.compact("t") == 1 and len(t.buckets("t")) == 4
    name = sorted(t.buckets("t"))
    first = name[0]
    inside = [f"n{i}" for i in range(400)]
    of = {r.k: r.b for r in rows(spark, ((k, "") for k in inside)).select("k", bucket_of(F.col("k"), name).alias("b")).collect()}
    t.commit({"t": Change(rows(spark, ((k, "x") for k in inside if of[k] == first)))})
    assert t.compact("t") == 1
    depths = {b: int(b.split("-")[0]) for b in t.buckets("t")}
    assert sorted(set(name) - {first}) == sorted(b for b, d in depths.items() if d == 2) and max(depths.values()) > 2
    assert t.state.live("t") == 80 + sum(b == first for b in of.values()) == t.read("t").count()
    # A key's rows lie in one bucket, and only its files are read.
    read = t.read("t", rows(spark, [("k5", "")]))
    assert {f.split("__bucket=")[1].split("/")[0] for f in read.inputFiles()} == {r.b for r in rows(spark, [("k5", "")]).select(bucket_of(F.col("k"), t.buckets("t")).alias("b")).collect()}


def test_a_bucket_of_one_key_is_not_split_for_ever(spark, tmp_path):
    t = make(spark, tmp_path, capacity=4)
    t.commit({"t": Change(rows(spark, (("same", str(i)) for i in range(20))))})
    assert t.compact("t") == 1 and len(t.buckets("t")) == 1 and t.worn("t") == set() and t.compact("t") == 0


def test_readers_and_leases(spark, tmp_path):
    clock = Clock()
    t = make(spark, tmp_path, keep_seconds=60, clock=clock)
    t.commit({"t": Change(rows(spark, [("a", "1"), ("b", "1")]))})
    reader = make(spark, tmp_path, clock=clock)
    frame = reader.read("t")
    with reader.lease(1000) as state:
        for i in range(3):
            clock.now += 30
            t.commit({"t": Change(rows(spark, [("a", str(i))]), whole=True)})
            t.expire()
        clock.now += 100
        t.expire()
        assert sorted((r.k, r.v) for r in frame.collect()) == [("a", "1"), ("b", "1")] == held(reader, state)
    assert t.expire() and len([n for n in t.folder.names() if n.startswith("d-")]) == 1
    assert held(t) == [("a", "2")]
    lost = reader.lease(10)
    lost.__enter__()  # a reader that never comes back
    clock.now += 11
    assert t._leased() == set()


def test_versions_stay_for_their_time(spark, tmp_path):
    clock = Clock()
    t = make(spark, tmp_path, keep_seconds=80, clock=clock)
    for i in range(3):
        t.commit({"t": Change(rows(spark, [("a", str(i))]), whole=True)})
        clock.now += 25
    assert t.expire() == [] and held(t, t.at(1)) == [("a", "0")]
    clock.now += 10
    assert len(t.expire()) == 1 and held(t, t.at(2)) == [("a", "1")]


def test_two_writers(spark, tmp_path):
    """A writer that has written but not committed keeps its folders; the slower commit fails and leaves nothing."""
    clock = Clock()
    a, b = (make(spark, tmp_path, keep_seconds=0, clock=clock) for _ in range(2))
    edits, _, folders = b.stage("t", Change(rows(spark, [("b", "1")])))
    a.commit({"t": Change(rows(spark, [("a", "1")]))})
    clock.now = b.folder.changed(folders[0])
    a.commit({"t": Change(rows(spark, [("a", "2")]), whole=True)})
    a.expire()
    assert set(folders) <= set(a.folder.names())
    with pytest.raises(RuntimeError, match="faster"):
        b._commit(edits, {}, None)
    names = a.folder.names()
    with pytest.raises(RuntimeError, match="faster"):
        b.commit({"t": Change(rows(spark, [("b", "1")]))})
    assert a.folder.names() == names and held(a) == [("a", "2")]
    clock.now += 90_000
    assert set(folders) & set(a.expire()) == set(folders)


def test_a_batch_comes_again(spark, tmp_path):
    t = make(spark, tmp_path)
    for number, v in ((1, "one"), (3, "three"), (3, "again"), (2, "late")):
        done = t.commit({"t": Change(rows(spark, [("a", v)]))}, {"n": number}, ("feed", number))
        assert (done is None) == (v in ("again", "late"))
    assert held(t) == [("a", "three")] and t.state.counters == {"n": 3} and t.state.version == 2
    other = make(spark, tmp_path)
    assert other.commit({"t": Change(rows(spark, [("a", "x")]))}, batch=("feed", 3)) is None
    assert other.commit({"t": Change(rows(spark, [("b", "x")]))}, batch=("other", 0))["t"]["new"] == 1


def test_cache_rows(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), 1)
    entry = lambda h, day: (h, [1.0], 1, day)
    table = lambda rows: spark.createDataFrame(rows, "hash string, vector array<float>, dimensions int, createdAt string").withColumn("createdAt", F.col("createdAt").cast("timestamp"))
    s.add_to_cache(table([entry("a", "2024-01-01"), entry("b", "2024-01-05"), entry("c", "2024-01-09")]))
    s.add_to_cache(table([entry("a", "2024-01-02")]))
    assert s.prune_cache(F.lit("2024-01-10").cast("timestamp"), 3) == 2
    assert s.delete_from_cache(spark.createDataFrame([("c",), ("z",)], "hash string")) == 1 and s.cache().count() == 0
    s.add_to_cache(table([entry("d", "2024-01-01")]))
    assert s.clear_cache() == 1 and s.cache().count() == 0


# ---------------------------------------------------------------- the tree


def tree_of(files, spark):
    return {tuple(r) for r in merkle.build(spark.createDataFrame(sorted(files.items()), "path string, hash string"), "sha256").collect()}


def test_tree_changes_at_depth_twelve(spark):
    deep = "/".join("abcdefghijk")
    files = {f"{deep}/x{i}": f"h{i}" for i in range(3)} | {f"a/b/y{i}": "h" for i in range(3)} | {"top": "t", "q/w/e/1": "1", "q/w/e/r/2": "2"}
    nodes = merkle.build(spark.createDataFrame(sorted(files.items()), "path string, hash string"), "sha256")
    changed = spark.createDataFrame([(f"{deep}/x1", "new"), ("n/e/w", "w")], "path string, hash string")
    gone = spark.createDataFrame([("a/b/y1",), ("nowhere",)], "path string")
    moves = spark.createDataFrame([("q/w", f"{deep}/q"), ("top", "z/top")], "oldPath string, newPath string")
    after = merkle.update(nodes, changed, gone, "sha256", moves)
    want = {k: v for k, v in files.items() if k not in ("a/b/y1", "top") and not k.startswith("q/")}
    want |= {f"{deep}/x1": "new", "n/e/w": "w", f"{deep}/q/e/1": "1", f"{deep}/q/e/r/2": "2", "z/top": "t"}
    assert {tuple(r) for r in after.collect()} == tree_of(want, spark)
    lines = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    # A few lines for each of the old tree's levels; what was changed is read from where it was written.
    assert lines(after) < 8 * lines(nodes)


def test_descent_opens_only_what_differs(spark):
    files = {f"p{i}/d{j}/f{k}": f"{i}{j}{k}" for i in range(6) for j in range(4) for k in range(3)}
    other = dict(files)
    del other["p0/d0/f0"]
    other |= {"p1/d1/f1": "changed", "p9/new": "n", "p2/d2": "now a file"}
    for k in range(3):
        del other[f"p2/d2/f{k}"]
    a, b = (merkle.build(spark.createDataFrame(sorted(x.items()), "path string, hash string"), "sha256") for x in (files, other))
    opened = []

    def counting(nodes):
        read = merkle.children_in(nodes)

        def children(parents):
            opened.append({r[0] for r in parents.collect()})
            return read(parents)

        return children

    got = {tuple(r) for r in merkle.descend(spark, counting(a), counting(b)).collect()}
    plain = {tuple(r) for r in merkle.diff(*(x.where("not isDirectory") for x in (a, b))).where("change <> 'unchanged'").collect()}
    assert got == plain and len(got) == 7
    assert set().union(*opened) == {"", "p0", "p0/d0", "p1", "p1/d1", "p2", "p2/d2", "p9"}
    assert merkle.descend(spark, merkle.children_in(a), merkle.children_in(a)).count() == 0


# ---------------------------------------------------------------- index runs

FLAT = embedding.Batches(lambda texts: [[1.0] * 8 for _ in texts], 8)
EVENTS = "seq long, type string, filePath string, contentHash string"


def engine(spark, path, files, call=FLAT, **more):
    table = spark.createDataFrame([(p, "text", c) for p, c in files.items()], schemas.FILES)
    return Engine(spark, table, ChunkStore(spark, str(path), 8), Settings(dimensions=8), (call, lambda text: [1.0] * 8), **more)


def with_files(e, files):
    e.files = e.spark.createDataFrame([(p, "text", c) for p, c in files.items()], schemas.FILES)


def event(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENTS)


def nodes_of(e):
    return {tuple(r) for r in e.tree.collect()}


def fresh_nodes(e):
    from loomdex.functions.hashing import content_hash

    return {tuple(r) for r in merkle.build(e.files.select(F.col("filePath").alias("path"), content_hash(F.col("content")).alias("hash"))).collect()}


def test_batches_cost_the_same_one_after_the_other(spark, tmp_path):
    files = {f"p{i % 3}/f{i}": f"text {i}" for i in range(12)}
    e = engine(spark, tmp_path / "s", files)
    e.reindex()
    jobs, plans = [], []
    ran = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for k in range(6):
        files[f"p{k % 3}/f{k}"] = f"changed {k}"
        with_files(e, files)
        before = ran()
        e.apply_events(event(spark, ("modified", f"p{k % 3}/f{k}", None)), ("feed", k))
        jobs.append(ran() - before)
        plans.append(e.tree._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert max(jobs[1:]) < 1.3 * min(jobs[1:]) and max(plans) < 15  # with delete vectors or just merged
    version = e.store.tables.state.version
    assert e.apply_events(event(spark, ("deleted", "p0", None)), ("feed", 5))["again"] and e.store.tables.state.version == version
    assert nodes_of(e) == fresh_nodes(e) and e.index_status()["totalFiles"] == 12


def test_a_run_indexes_only_what_changed(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def call(texts):
        for t in texts:
            (seen / str(abs(hash(t)))).write_text(t)
        return [[1.0] * 8 for _ in texts]

    files = {"a": "one", "d/b": "two", "d/c": "three"}
    e = engine(spark, tmp_path / "s", files, embedding.Batches(call, 8))
    assert e.reindex(now="t1")["newFiles"] == 3
    for f in seen.iterdir():
        f.unlink()
    files |= {"d/b": "other", "e/x": "new"}
    del files["a"]
    with_files(e, files)
    with e.store.lease() as state:
        assert e.reindex(now="t2") == {"deleted": 2, "newFiles": 1, "status": "complete"}
        assert {r.filePath for r in e.store.rows(state=state).collect()} == {"a", "d/b", "d/c"}  # a reader over the run
    assert sorted(f.read_text() for f in seen.iterdir()) == ["new", "other"]
    assert {(r.filePath, r.content) for r in e.store.rows().collect()} == set(files.items()) and nodes_of(e) == fresh_nodes(e)
    assert e.index_status()["progress"] == {"phase": "idle", "files": 2, "done": 2}


def test_failed_texts_become_dead_letters(spark, tmp_path):
    def call(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[1.0] * 8 for _ in texts]

    files = {f"f{i}": f"text {i}" for i in range(5)} | {"x/bad": "a bad text"}
    e = engine(spark, tmp_path / "s", files, embedding.Batches(call, 8))
    assert e.reindex(now="2024-01-01T00:00:00Z")["status"] == "incomplete"
    (letter,) = e.dead_letters.collect()
    assert (letter.filePath, letter.errorMessage, letter.recoveryAttempts) == ("x/bad", "refused", 0) and letter.attempts >= 3
    assert {r.filePath for r in e.store.rows().collect()} == {f"f{i}" for i in range(5)}
    assert "x/bad" not in {r.path for r in e.tree.collect()} and e.index_status()["lastError"] == "1 files failed to index"
    assert e.sweep("2024-01-01T01:00:00Z") == {"retried": 0, "purged": 0, "skipped": 0, "abandoned": 0}
    assert e.dead_letters.first().recoveryAttempts == 1
    e.embedder = (FLAT, e.embedder[1])
    e.health = lambda: False
    assert e.sweep("2024-01-01T01:00:00Z")["skipped"] == 1
    e.health = lambda: True
    assert e.sweep("2024-01-01T01:00:00Z")["retried"] == 1
    assert e.dead_letters.count() == 0 and e.store.rows(["x/bad"]).count() == 1 and nodes_of(e) == fresh_nodes(e)
    assert e.reindex(now="2024-01-02T00:00:00Z")["status"] == "complete"


def test_no_dead_letter_is_lost(spark, tmp_path):
    def call(texts):
        raise ValueError("refused")

    n = dead_letters.CAPACITY + 5
    e = engine(spark, tmp_path / "s", {f"f{i}": "x" for i in range(n)}, embedding.Batches(call, 8))
    e.reindex(now="2024-01-01T00:00:00Z")
    assert e.dead_letters.count() == n
    e.settings.max_dead_letters = 7
    e._trim_letters()
    assert e.dead_letters.count() == 7


def test_wrong_vectors(spark, tmp_path):
    short = embedding.Batches(lambda texts: [[1.0] * 8 for _ in texts[1:]], 8)
    e = engine(spark, tmp_path / "s", {"a": "one", "b": "two"}, short)
    assert e.reindex(now="2024-01-01T00:00:00Z")["status"] == "incomplete" and {r.errorMessage for r in e.dead_letters.collect()} == {"embedding count mismatch: expected 1, got 0"}
    e = engine(spark, tmp_path / "t", {"a": "one"}, embedding.Batches(lambda texts: [[1.0] * 3 for _ in texts], 8))
    with pytest.raises(Exception, match="3 dimensions, not 8"):
        e.reindex()
    assert e.index_status()["totalFiles"] == 0 and "dimensions" in e.index_status()["lastError"]


def test_a_batch_retries_its_texts_alone():
    calls = []

    def call(texts):
        calls.append(list(texts))
        if len(calls) == 1 or "bad" in texts:
            raise OSError("busy")
        return [[1.0] for _ in texts]

    got = list(embedding.Batches(call, 1, size=3, attempts=2).rows(list("abcd"), ["x", "bad", "y", "z"]))
    assert [(h, e) for h, _, e, _ in got] == [("a", None), ("b", "busy"), ("c", None), ("d", None)]
    assert calls == [["x", "bad", "y"]] * 2 + [["x"], ["bad"], ["bad"], ["y"], ["z"]]


def test_a_search_fails_if_both_legs_do(spark, tmp_path):
    e = engine(spark, tmp_path / "s", {"a": "find me"})
    e.reindex()
    e.embedder = (FLAT, lambda text: [1.0])
    assert set(e.hybrid_search("find").failed) == {"semantic"}
    with pytest.raises(SearchFailed):
        e.hybrid_search("find", grep_pattern="(")
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 101}, {"query": "x", "context_lines": -1}):
        with pytest.raises(ValueError):
            e.hybrid_search(**bad)
    with pytest.raises(Exception, match="root|traversal|leaves"):
        e.hybrid_search("x", file_pattern="../secret/*")


def test_embedding_by_column_still_works(spark, tmp_path):
    files = spark.createDataFrame([("a", "text", "one")], schemas.FILES)
    e = Engine(spark, files, ChunkStore(spark, str(tmp_path / "s"), 64), Settings(), (vectors.embed_sha256, vectors.embed_query))
    assert e.reindex()["status"] == "complete" and e.semantic_search("one", 1).first().score == pytest.approx(1.0)


def test_a_range_that_ends_before_it_starts(spark, tmp_path):
    e = engine(spark, tmp_path / "s", {"a": "1\n2\n3"})
    assert e.get_context("a", 2, 3).first().content == "2\n3" and e.get_context("a", 9, 7).first().content == "3"
    with pytest.raises(ValueError, match=r"Invalid line range: startLine \(3\) is greater than endLine \(2\)"):
        e.get_context("a", 9, 2)
    assert e.get_context("none", 3, 1).count() == 0
