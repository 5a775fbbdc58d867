"""Trigram signatures, series dealt by ranges, and the queue machine as a stream."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.operators import chunking, events, metrics, near, search, trigrams
from loomdex.plans import streams
from loomdex.streaming import events as live


def codes(text):
    return {ord(a) << 14 | ord(b) << 7 | ord(c) for a, b, c in zip(text, text[1:], text[2:])}


@pytest.mark.parametrize(
    ("pattern", "stretches"),
    [
        ("hello", ["hello"]),
        ("HeLLo w", ["hello w"]),
        ("(foo|bar)bazes", ["bazes"]),
        ("(ab)cdef", ["cdef"]),
        ("abc?def", ["ab", "def"]),
        ("(?:abcd)+x", ["abcd"]),
        ("(?:abcd)*x", []),
        ("abc[xy]defg", ["abc", "defg"]),
        ("a{2,3}bcd", ["bcd"]),
        (r"abc\.def", ["abc.def"]),
        (r"\bword\b", ["word"]),
        (r"na.ve caf.", ["ve caf"]),
        ("ab", []),
        (r"\Qabc.d\E", []),
        (r"\p{L}abc", []),
        ("(?x) a b c d", []),
        ("(unclosed", []),
        ("[a&&b]cdef", []),
    ],
)
def test_required_trigrams(pattern, stretches):
    assert set(trigrams.required(pattern)) == set().union(*map(codes, stretches), set())


def test_literals_are_taken_as_they_are():
    assert set(trigrams.required("a.c(d", True)) == codes("a.c(d") and trigrams.required("é1é", True) == []


def test_a_signature_holds_every_trigram():
    rng = random.Random(1)
    for size in (0, 2, 3, 50, 3000, 40_000):
        text = "".join(rng.choice("abcdefghij \n") for _ in range(size))
        words = trigrams.signature(text.encode())
        bits = len(words) * 64
        held = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
        assert held[trigrams._spots(np.array(sorted(codes(text)), np.int64), bits)].all()
        assert bits & (bits - 1) == 0 and held.sum() < bits / 2


CASES = [("needle", True, False), ("NEEDLE", True, False), ("Needle", True, True), ("ne{2}d[a-l]e+ in", False, False), ("x|y", False, False), ("k", True, False), ("elv 1", True, False), ("größe", True, False), ("hay.*stack", False, True), ("zebra", True, False), (r"\d+ needles?", False, False)]


@pytest.mark.parametrize(("pattern", "fixed", "exact"), CASES)
def test_indexed_search_equals_the_plain_one(spark, pattern, fixed, exact):
    rng = random.Random(2)
    words = ["needle", "Needle in", "hay", "stack", "Kelv", "GRÖSSE", "größe", "x", "12 needles", "ΣΑΣ", ""]
    rows = [(f"p{i % 4}/f{i}", "text", None if i == 7 else "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) + f" {i}" for _ in range(rng.randrange(4)))) for i in range(60)]
    files = spark.createDataFrame(rows, schemas.FILES)
    signed = trigrams.signatures(files)
    for patterns in (None, ["p1/**"]):
        plain = search.grep(chunking.explode_lines(files), pattern, patterns, exact, 50, fixed).collect()
        assert trigrams.grep(files, signed, pattern, patterns, exact, 50, fixed).collect() == plain


def test_files_without_the_trigrams_are_not_split(spark):
    files = spark.createDataFrame([(f"f{i}", "text", f"number {i} " + ("needle" if i % 50 == 0 else "straw") * 30) for i in range(500)], schemas.FILES)
    assert trigrams.candidates(trigrams.signatures(files), "needle", fixed=True).count() <= 15
    assert trigrams.candidates(trigrams.signatures(files), "[a-z]").count() == 500


# ---------------------------------------------------------------- series


def test_one_series_in_many_ranges(spark):
    rng = random.Random(4)
    rows, value = [], {}
    for i in range(400):
        s = rng.choice(["hot"] * 8 + ["b", None])
        value[s] = 0.0 if rng.random() < 0.05 else value.get(s, 0.0) + rng.random()
        rows.append((s, 1000 + i // 3, i, None if rng.random() < 0.02 else value[s]))
    samples = spark.createDataFrame(rows, "series string, ts long, n long, value double").repartition(5)
    plain = metrics.counter_delta(samples, ["series"], order=["n"])
    dealt = metrics.counter_delta_ranged(samples, ["series"], order=["n"])
    assert sorted(map(tuple, dealt.select("n", "delta").collect())) == sorted(map(tuple, plain.select("n", "delta").collect()))
    assert metrics.counter_delta_ranged(samples.limit(0), ["series"], order=["n"]).count() == 0


def test_a_long_series_is_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        samples = spark.range(4000).select(F.lit("one").alias("series"), F.col("id").alias("ts"), F.col("id").cast("double").alias("value"))
        got = metrics.counter_delta_ranged(samples, ["series"])
        assert got.where("delta <> 1 and ts > 0").count() == 0
        sizes = [r["count"] for r in samples.repartitionByRange("series", "ts").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


# ---------------------------------------------------------------- the queue as a stream

QUEUE = "queue string, seq long, type string, filePath string"


def some_events(n=300):
    rng = random.Random(6)
    return [(f"q{rng.randrange(3)}", i, rng.choice(["modified"] * 12 + ["scan_started", "scan_finished", "drained"]), f"f{rng.randrange(9)}") for i in range(n)]


@pytest.mark.parametrize(("most", "scan_at"), [(4, 4), (6, 5), (20, 20)])
def test_queues_over_many_micro_batches(spark, tmp_path, most, scan_at):
    rows = some_events()
    table = spark.createDataFrame(rows, QUEUE)
    for k in range(4):  # a file is a micro-batch
        table.where(F.col("seq").between(75 * k, 75 * k + 74)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.with_state_store(spark, lambda: live.replay(spark, live.machine_stream(source, most, scan_at)))
    want = events.machine(table, most, scan_at)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_queue_left_in_overflow_asks_for_a_scan(spark, tmp_path):
    table = spark.createDataFrame([("q", i, "modified", f"f{i}") for i in range(3)] + [("calm", 0, "modified", "f")], QUEUE)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(QUEUE).parquet(str(tmp_path / "in"))

    def run():
        query = live.machine_stream(source, 9, 3, scan_after_ms=500).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
        try:
            end, found = time.time() + 90, []
            while not found and time.time() < end:
                time.sleep(0.5)
                found = spark.table("asked").where("type = 'scan_required'").collect()
            return found
        finally:
            query.stop()

    (row,) = streams.with_state_store(spark, run)
    assert (row.queue, row.state) == ("q", "overflow")
    with pytest.raises(ValueError):
        live.machine_stream(source, 3, 4)


# ---------------------------------------------------------------- nearest rows


def clustered(spark, n=3000, clusters=30, dim=16):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(clusters, dim))
    made = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.15
    rows = [(f"id{i}", f"p{i % 7}", [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    rows += [("zero", "p0", [0.0] * dim), ("null", "p0", None), ("twin", "p9", rows[5][2])]
    return spark.createDataFrame(rows, "id string, filePath string, vector array<float>"), made, centres


def test_nearest_rows_by_pivots(spark, tmp_path):
    rows, made, centres = clustered(spark)
    index = near.build(rows, str(tmp_path / "near"), pivots=40, sample=800)
    opened = []
    for query in (made[5].tolist(), centres[3].tolist(), (-centres[0]).tolist(), [0.0] * 15 + [1.0], [0.0] * 16):
        for k in (1, 10):
            got, report = index.search(query, k)
            assert got.collect() == search.knn(rows, query, k).collect()
            assert report.of_rows == 3003 and report.rows == sum(index.spans[p][0] for p in report.opened)
        opened.append(report.rows / report.of_rows)
    assert opened[0] < 0.3 and opened[1] < 0.3  # near a cluster only its buckets are read
    got, _ = index.search(made[5].tolist(), 10, F.col("filePath") == "p3")
    assert got.collect() == search.knn(rows.where("filePath = 'p3'"), made[5].tolist(), 10).collect()
    everything, report = index.search(made[5].tolist(), 4000)
    assert everything.count() == 3003 and len(report.opened) == len(index.spans)


def test_nearest_rows_of_little(spark, tmp_path):
    rows, _, _ = clustered(spark, 20, 2)
    empty = near.build(rows.limit(0), str(tmp_path / "a"))
    assert empty.search([1.0] * 16, 3)[0].count() == 0
    nothing = near.build(rows.where("id in ('zero', 'null')"), str(tmp_path / "b"))
    assert [r.id for r in nothing.search([1.0] * 16, 3)[0].collect()] == ["zero", "null"]
    same = near.build(rows.withColumn("vector", F.lit([1.0] * 16).cast("array<float>")), str(tmp_path / "c"))
    assert same.search([1.0] * 16, 5)[0].select("filePath").collect() == search.knn(rows.withColumn("vector", F.lit([1.0] * 16)), [1.0] * 16, 5).select("filePath").collect()


def test_silent_nodes_are_evicted(spark, tmp_path):
    """a is silent after the first batch and evicted by the watermark that b's rows move; b has a gap of its own."""
    from datetime import datetime, timedelta

    began = datetime(2024, 1, 1)
    seen = [[("a", "n1", 0), ("a", "n2", 5), ("b", "m", 3)], [("b", "m", 10), ("b", "m", 40), ("c", "o", 41)], [("b", "m", 45)]]
    schema = "port string, node string, seenAt timestamp"
    for batch in seen:
        spark.createDataFrame([(p, n, began + timedelta(seconds=s)) for p, n, s in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.with_state_store(spark, lambda: live.replay(spark, live.liveness_stream(source, 15)))
    at = lambda s: began + timedelta(seconds=s)
    assert sorted(map(tuple, got.collect())) == [("a", "n2", at(5), at(20)), ("b", "m", at(10), at(25))]
