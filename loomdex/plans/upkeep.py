"""Queries of an index as it changes: growing buckets, snapshots, batches that come again, moved subtrees, tree descent,
failed embeddings and change feeds."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import vectors
from loomdex.operators import chunking, embedding, merkle, metrics, near, store, trigrams
from loomdex.plans.catalog import CHUNKS, DIFF, FILES, GREP, QUERY_TEXT, SEMANTIC, chunks, files, query, samples, snapshots
from loomdex.plans.engine import Engine, Settings
from loomdex.plans.service import TREE_FILES, tree_files
from loomdex.scratch import shared_dir, written

NAMED = "content IS NOT NULL AND \"filePath\" IS NOT NULL"


def new_store(spark: SparkSession, dimensions: int = 4, **how) -> store.ChunkStore:
    return store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", dimensions, **how)


def window_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.line_windows(files(spark, d)).where("filePath is not null")
    return rows.withColumn("hash", F.lit("h")).withColumn("vector", F.array_repeat(F.lit(1.0).cast("float"), 4))


def even(rows: DataFrame) -> DataFrame:
    return rows.where(F.regexp_extract("filePath", r"(\d+)\.txt$", 1).cast("long") % 2 == 0)


def grown(spark: SparkSession, d: str) -> store.ChunkStore:
    """A store that starts with half of the files in one bucket and takes the others, replacements and a deletion."""
    rows = window_rows(spark, d)
    held = new_store(spark, capacity=200)
    held.rebuild(even(rows))
    held.upkeep()
    held.apply(rows.join(even(rows).select("filePath").distinct(), "filePath", "left_anti"))
    held.upkeep()
    german = rows.where("language = 'de'")
    held.apply(german.where("startLine = 1").withColumn("id", F.concat("id", F.lit("!"))), german.select("filePath").distinct(), spark.createDataFrame([("src1",)], "path string"))
    return held


GROWN = f"{CHUNKS}, named AS (SELECT * FROM chunks WHERE \"filePath\" IS NOT NULL AND NOT starts_with(\"filePath\", 'src1/')), src1_de AS (SELECT * FROM chunks WHERE starts_with(\"filePath\", 'src1/') AND language = 'de')"


@query("q_store_growth", f"{GROWN} SELECT id, \"filePath\" FROM named WHERE language <> 'de' OR language IS NULL UNION ALL SELECT id || '!', \"filePath\" FROM named WHERE language = 'de' AND \"startLine\" = 1 UNION ALL SELECT id || '!', \"filePath\" FROM src1_de WHERE \"startLine\" = 1")
def _(spark, d):
    held = grown(spark, d)
    held.compact("t", force=True)
    return store.ChunkStore(spark, held.root, 4).rows().select("id", "filePath")


@query("q_store_snapshot", f"{CHUNKS} SELECT id FROM chunks WHERE \"filePath\" IS NOT NULL")
def _(spark, d):
    """What a reader holds that took its version before everything was replaced, deleted and merged."""
    rows = window_rows(spark, d)
    held = new_store(spark)
    held.rebuild(rows)
    with held.lease() as state:
        held.apply(rows.withColumn("id", F.concat("id", F.lit("!"))))
        held.delete_prefix("src1")
        held.compact("t", force=True)
        return held.rows(state=state).select("id")


@query("q_batches_once", f"{CHUNKS} SELECT id || '/2' AS id FROM chunks WHERE \"filePath\" IS NOT NULL")
def _(spark, d):
    """A feed's batches 1, 2, 1 again and 2 again: the second one's rows, whatever the others bring."""
    rows = window_rows(spark, d)
    held = new_store(spark)
    for number, mark in ((1, "/1"), (2, "/2"), (1, "/late"), (2, "/again")):
        held.apply(rows.withColumn("id", F.concat("id", F.lit(mark))), batch=("feed", number))
    return held.rows().select("id")


# ---------------------------------------------------------------- the tree


def levels_sql(leaves: str, depth: int) -> str:
    """The folders d1 to d(depth - 1) of a tree of files (path, hash)."""
    out = []
    for k in range(depth - 1, 0, -1):
        deeper = f" UNION ALL SELECT path, hash FROM d{k + 1}" if k < depth - 1 else ""
        out.append(f"n{k + 1} AS (SELECT path, hash FROM {leaves} WHERE len(string_split(path, '/')) = {k + 1}{deeper})")
        out.append(f"d{k} AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS hash FROM n{k + 1} GROUP BY 1)")
    return ", ".join(out)


DEEP = "moved/a/b/c/d/e/f/g/h"
MOVED = f"{TREE_FILES}, g AS (SELECT CASE WHEN source = 'src1' THEN '{DEEP}/' || path ELSE path END AS path, CASE WHEN doc_id % 50 = 0 AND source <> 'src1' THEN sha256('new ' || path) ELSE hash END AS hash FROM f WHERE NOT starts_with(path, 'src2/en/'))"


@query("q_merkle_move", f"{MOVED}, {levels_sql('g', 12)} " + " UNION ALL ".join(f"SELECT path, hash FROM d{k}" for k in range(1, 12)))
def _(spark, d):
    """Folder hashes after a subtree moved to depth 12, another went and some files changed."""
    base = tree_files(spark, d)
    nodes = merkle.build(base, "sha256")
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    kept = ~F.col("path").startswith("src1/") & ~F.col("path").startswith("src2/en/")
    changed = base.where((number % 50 == 0) & kept).select("path", F.sha2(F.concat(F.lit("new "), "path"), 256).alias("hash"))
    moves = spark.createDataFrame([("src1", f"{DEEP}/src1")], "oldPath string, newPath string")
    return merkle.update(nodes, changed, spark.createDataFrame([("src2/en",)], "path string"), "sha256", moves).where("isDirectory").select("path", "hash")


@query("q_tree_descend", f"{DIFF} SELECT path, change FROM diff WHERE change <> 'unchanged'")
def _(spark, d):
    old, new = (merkle.build(files, "sha256") for files in snapshots(spark, d))
    return merkle.descend(spark, merkle.children_in(old), merkle.children_in(new))


# ---------------------------------------------------------------- index runs


def refuse(texts: list[str]) -> list[list[float]]:
    """An embedder that fails on texts whose digest begins with 0, and with them a whole call."""
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    if any(x[0] < 16 for x in digests):
        raise ValueError("refused")
    return [[b / 255 for b in x[:8]] for x in digests]


def indexed(spark: SparkSession, d: str, embedder=None) -> Engine:
    held = files(spark, d).where("content is not null and filePath is not null")
    settings = Settings(dimensions=8, max_chars=1 << 30, max_file_bytes=1 << 30)
    embed = embedder or embedding.Batches(lambda texts: [[float(len(t) % 7)] * 8 for t in texts], 8)
    return Engine(spark, held, new_store(spark, 8), settings, (embed, vectors.embed_query))


REFUSED = f"{CHUNKS}, bad AS (SELECT DISTINCT \"filePath\" FROM chunks WHERE {NAMED} AND starts_with(sha256(content), '0'))"


@query("q_embed_failures", f"{REFUSED} SELECT \"filePath\", 'refused' AS \"errorMessage\", 0 AS \"recoveryAttempts\" FROM bad")
def _(spark, d):
    """Dead letters of a run whose embedder refuses some texts: their files, whatever shared a batch with them."""
    engine = indexed(spark, d, embedding.Batches(refuse, 8))
    engine.reindex(now="2024-01-01T00:00:00Z")
    return engine.dead_letters.select("filePath", "errorMessage", "recoveryAttempts")


@query("q_indexed_despite_failures", f"{REFUSED} SELECT id FROM chunks WHERE {NAMED} AND \"filePath\" NOT IN (SELECT \"filePath\" FROM bad)")
def _(spark, d):
    engine = indexed(spark, d, embedding.Batches(refuse, 8))
    engine.reindex(now="2024-01-01T00:00:00Z")
    return engine.store.rows().select("id")


@query("q_recovery_sweep", f"{REFUSED} SELECT count(*) FILTER (NOT starts_with(\"filePath\", 'src1/')) AS retried, count(*) FILTER (starts_with(\"filePath\", 'src1/')) AS purged, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS abandoned FROM bad")
def _(spark, d):
    """The sweep after the embedder works again and the files of one folder are gone."""
    engine = indexed(spark, d, embedding.Batches(refuse, 8))
    engine.reindex(now="2024-01-01T00:00:00Z")
    engine.embedder = (embedding.Batches(lambda texts: [[0.5] * 8 for _ in texts], 8), engine.embedder[1])
    engine.files = engine.files.where(~F.col("filePath").startswith("src1/"))
    counts = engine.sweep("2024-01-01T01:00:00Z")
    return spark.createDataFrame([counts], "retried long, purged long, skipped long, abandoned long")


FEED = f"WITH {FILES}, named AS (SELECT * FROM files WHERE {NAMED} AND NOT starts_with(\"filePath\", 'src1/')), fed AS (SELECT CASE WHEN language = 'es' THEN 'moved/' || \"filePath\" ELSE \"filePath\" END AS path FROM named)"


def fed(spark: SparkSession, d: str) -> Engine:
    """An index after three batches of a feed, the second of which came twice: a folder deleted, files changed, files renamed."""
    engine = indexed(spark, d)
    engine.reindex()
    schema = "seq long, type string, filePath string, contentHash string"
    gone = spark.createDataFrame([(1, "deleted", "src1", None)], schema)
    engine.apply_events(gone, ("feed", 1))
    old = engine.files.where(~F.col("filePath").startswith("src1/"))
    engine.files = old.withColumn("content", F.when(F.col("language") == "de", F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")))
    changed = engine.files.where("language = 'de'").select(F.lit(1).cast("long").alias("seq"), F.lit("modified").alias("type"), "filePath", F.lit(None).cast("string").alias("contentHash"))
    for _ in range(2):
        engine.apply_events(changed, ("feed", 2))
    spanish = engine.files.where("language = 'es'").select("filePath", F.xxhash64("filePath").cast("string").alias("contentHash"))
    moved = spanish.select(F.col("filePath").alias("was"), F.concat(F.lit("moved/"), "filePath").alias("filePath"), "contentHash")
    events = spanish.select(F.lit(1).cast("long").alias("seq"), F.lit("deleted").alias("type"), "filePath", "contentHash")
    events = events.unionByName(moved.select(F.lit(2).cast("long").alias("seq"), F.lit("added").alias("type"), "filePath", "contentHash"))
    engine.apply_events(events, ("feed", 3))
    return engine


@query("q_feed", f"{FEED} SELECT path, true AS in_tree, max(n.content <> '' OR n.language = 'de') AS in_rows FROM fed f JOIN named n ON f.path = n.\"filePath\" OR f.path = 'moved/' || n.\"filePath\" GROUP BY 1")
def _(spark, d):
    """The files that the tree and the rows hold after the feed."""
    engine = fed(spark, d)
    nodes = engine.tree.where("not isDirectory").select("path", F.lit(True).alias("in_tree"))
    rows = engine.store.rows().select(F.col("filePath").alias("path"), F.lit(True).alias("in_rows")).distinct()
    return nodes.join(rows, "path", "full_outer").na.fill(False)


# ---------------------------------------------------------------- searches and series


def signed(spark: SparkSession, d: str) -> DataFrame:
    """The files' signatures, stored once."""
    return written(trigrams.signatures(files(spark, d).where("filePath is not null")))


@query("q_grep_indexed", GREP.format("regexp_matches(\"lineText\", '(th|er)[aeiou]nd [a-z]+ing', 'i')", 50))
def _(spark, d):
    return trigrams.grep(files(spark, d), signed(spark, d), "(th|er)[aeiou]nd [a-z]+ing", max_results=50).select("filePath", "lineNumber", "lineText")


@query("q_grep_indexed_literal", GREP.format("contains(lower(\"lineText\"), 'ingly the')", 100))
def _(spark, d):
    return trigrams.grep(files(spark, d), signed(spark, d), "INGLY the", fixed=True).select("filePath", "lineNumber", "lineText")


@query("q_counter_delta_hot", "SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL OR value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 6) AS delta FROM events WINDOW w AS (ORDER BY ts, event_id)")
def _(spark, d):
    """All events as one series."""
    one = samples(spark, d).withColumn("series", F.lit("all"))
    return metrics.counter_delta_ranged(one, ["series"], order=["event_id"]).select("event_id", F.round("delta", 6).alias("delta"))


@query("q_counter_delta_ranged", "SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL OR value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 6) AS delta FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def _(spark, d):
    return metrics.counter_delta_ranged(samples(spark, d), ["event_type"], order=["event_id"]).select("event_id", F.round("delta", 6).alias("delta"))


@query("q_semantic_indexed", f'{SEMANTIC} SELECT id, "filePath", "startLine", "endLine", round(score, 9) AS score FROM scored ORDER BY scored.score DESC, "filePath", id LIMIT 20')
def _(spark, d):
    index = near.build(chunks(spark, d), f"{shared_dir(spark)}/near-{uuid.uuid4().hex}")
    found, _ = index.search(vectors.embed_query(QUERY_TEXT), 20)
    return found.select("id", "filePath", "startLine", "endLine", F.round("score", 9).alias("score"))
