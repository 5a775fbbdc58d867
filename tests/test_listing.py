"""Folders listed by level, and their changes followed into an index."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions import text
from loomdex.operators import embedding, merkle
from loomdex.operators.store import ChunkStore
from loomdex.plans.engine import Engine, Settings
from loomdex.sources.listing import Feed, list_files


def put(root, path, content):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(content)
    stamp = put.stamp = getattr(put, "stamp", 1_700_000_000_000_000_000) + 1_000_000_000
    os.utime(root / path, ns=(stamp, stamp))


def test_ignored_folders_are_not_opened(spark, tmp_path):
    for path in ("a.py", "src/b.py", "src/deep/er/c.py", "node_modules/x/y.js", "src/build/z.o", "keep.log", "drop.log", ".env"):
        put(tmp_path, path, path)
    (tmp_path / "empty").mkdir()
    opened = []
    got = list_files(spark, str(tmp_path), ["node_modules", "build", "*.log", "!keep.log"], opened.extend).collect()
    assert {r.filePath: r.size for r in got} == {p: len(p) for p in ("a.py", "src/b.py", "src/deep/er/c.py", "keep.log")}
    assert set(opened) == {"", "src", "empty", "src/deep", "src/deep/er"}
    assert list_files(spark, str(tmp_path / "empty")).count() == 0 == list_files(spark, str(tmp_path / "nowhere")).count()
    assert {r.filePath for r in list_files(spark, f"file://{tmp_path}", ["*.log"]).collect()} >= {"a.py", "node_modules/x/y.js"}


def events_of(feed, since):
    return sorted((r.type, r.filePath) for r in feed.events(since).collect())


def test_a_feed_of_listings(spark, tmp_path):
    root = tmp_path / "root"
    for path in ("a", "d/b", "d/c"):
        put(root, path, path)
    feed = Feed(spark, str(root), str(tmp_path / "feed"))
    first = feed.poll()
    assert events_of(feed, 0) == [("added", "a"), ("added", "d/b"), ("added", "d/c")] and feed.poll() is None
    put(root, "d/b", "other")
    os.rename(root / "a", root / "moved")
    os.remove(root / "d" / "c")
    second = feed.poll()
    got = feed.events(first)
    assert events_of(feed, first) == [("added", "moved"), ("deleted", "a"), ("deleted", "d/c"), ("modified", "d/b")]
    assert [(r.oldPath, r.newPath) for r in merkle.rename_pairs(got).collect()] == [("a", "moved")]
    # The same as the difference of two trees of the listings.
    trees = [merkle.children_in(merkle.build(feed.tables.read("listing", state=feed.tables.at(v)).select(F.col("filePath").alias("path"), "hash"))) for v in (first, second)]
    assert sorted((r.change, r.path) for r in merkle.descend(spark, *trees).collect()) == events_of(feed, first)
    again = Feed(spark, str(root), str(tmp_path / "feed"))
    assert again.poll() is None and events_of(again, first) == events_of(feed, first)


def test_an_index_follows_a_folder(spark, tmp_path):
    root = tmp_path / "root"
    for path in ("a.txt", "d/b.txt", "d/c.txt"):
        put(root, path, f"text of {path}")
    feed = Feed(spark, str(root), str(tmp_path / "feed"))
    flat = embedding.Batches(lambda texts: [[1.0] * 8 for _ in texts], 8)
    e = Engine(spark, spark.createDataFrame([], schemas.FILES), ChunkStore(spark, str(tmp_path / "s"), 8), Settings(dimensions=8), (flat, lambda text: [1.0] * 8))
    numbers = []

    def apply(events, number):
        numbers.append(number)
        found = feed.contents(events)
        e.files = found.select("filePath", text.parser_language(F.col("filePath")).alias("language"), F.decode("content", "UTF-8").alias("content"))
        return e.apply_events(events, number)

    done = feed.follow(apply, polls=1)
    vectors = {r.filePath: r.id for r in e.store.rows().collect()}
    assert set(vectors) == {"a.txt", "d/b.txt", "d/c.txt"}
    put(root, "n/new.txt", "new")
    os.rename(root / "a.txt", root / "n" / "a.txt")
    os.remove(root / "d" / "c.txt")
    assert feed.follow(apply, done, polls=2, sleep=lambda s: None) > done and len(numbers) == 2
    assert {r.filePath for r in e.store.rows().collect()} == {"d/b.txt", "n/a.txt", "n/new.txt"} == {r.path for r in e.tree.where("not isDirectory").collect()}
    assert e.apply_events(feed.events(done), numbers[-1])["again"]
