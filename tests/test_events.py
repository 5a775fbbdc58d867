from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomdex.operators import events
from loomdex.sources import files as sources
from loomdex.streaming import events as streams


def make(spark, rows):
    df = spark.createDataFrame(rows, "seq long, type string, filePath string, at double")
    return df.select("seq", "type", "filePath", F.lit(None).cast("string").alias("contentHash"), F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("detectedAt"))


@pytest.mark.parametrize(("types", "want"), [(["added", "deleted"], None), (["added", "modified"], "added"), (["modified", "deleted"], "deleted"), (["deleted", "added"], "modified"), (["deleted", "modified"], "modified"), (["added", "deleted", "added"], "added")])
def test_pairs(spark, types, want):
    got = events.coalesce(make(spark, [(i, t, "f", 1.0) for i, t in enumerate(types)])).collect()
    assert [r.type for r in got] == ([want] if want else [])


def test_gap(spark):
    got = events.sessions(make(spark, [(1, "added", "f", 1.0), (2, "modified", "f", 1.1), (3, "modified", "f", 1.201)])).orderBy("seq").collect()
    assert [r.session for r in got] == [1, 1, 2]


def test_flood(spark):
    flood = spark.range(12_000).select(F.col("id").alias("seq"), F.lit("modified").alias("type"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filePath"))
    s = events.queue_summary(events.backpressure(flood)).first()
    assert tuple(s) == (5000, 7000, "overflow")
    with pytest.raises(ValueError):
        events.backpressure(flood, 10, 11)


def test_retry_and_lanes(spark):
    df = spark.createDataFrame([(1, "modified", "ENOENT: gone"), (2, "modified", "boom"), (3, "reindex", "ENOENT"), (4, "added", None)], "seq long, type string, error string")
    assert sorted(r.seq for r in events.retry(df).collect()) == [2, 3]
    assert [r.seq for r in events.lanes(df).collect()] == [3, 1, 2, 4]


def test_scan_and_load(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "b.js").write_text("y")
    (tmp_path / "big.txt").write_bytes(b"z" * 100)
    found = sources.load(sources.scan(spark, str(tmp_path)), max_bytes=50).collect()
    assert {(r.filePath, r.language, r.content, r.skipped) for r in found} == {("src/a.py", "python", "x = 1\n", False), ("big.txt", "text", None, True)}
    assert sources.scan_events(sources.scan(spark, str(tmp_path))).where("type = 'added' and contentHash is not null").count() == 2


def test_folder_reader(tmp_path):
    (tmp_path / "a").write_text("1")
    reader = streams.FolderReader({"path": str(tmp_path)})
    start = reader.initialOffset()
    (tmp_path / "b").write_text("2")
    (tmp_path / "a").unlink()
    (tmp_path / ".env").write_text("s")
    rows, end = reader.read(start)
    assert [r[:3] for r in rows] == [(1, "deleted", "a"), (2, "added", "b")]
    assert [r[:3] for r in reader.readBetweenOffsets(start, end)] == [(1, "deleted", "a"), (2, "added", "b")]
