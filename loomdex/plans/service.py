"""Queries of what clients and maintenance do: requests, JSON, queues, nodes, blobs, tree changes and the store's batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions import globs, jsons, limits, vectors
from loomdex.operators import blobs, chunking, dead_letters, events, merkle, metrics, search, store
from loomdex.plans.catalog import CHUNKS, ENTRIES, FILES, LINES, PROBE, VECTORS, chunks, cosine_sql, entries, file_events, files, lines, query, table, tree, url_paths
from loomdex.plans.shared import shared_dir

# ---------------------------------------------------------------- requests and paths


@query("q_line_glob", f"WITH {FILES} SELECT \"filePath\" FROM files WHERE (regexp_full_match(\"filePath\", '(.*/)?[^/]*[135]\\.txt') OR regexp_full_match(\"filePath\", 'src1/(en|fr)/.*')) AND NOT regexp_full_match(\"filePath\", 'src2/.*')")
def _(spark, d):
    return files(spark, d).where(globs.line_glob_filter(F.col("filePath"), ["*[135].txt", "/src1/{en,fr}/**", "!src2/**"])).select("filePath")


@query("q_ignore_negated", "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT page_id, path AS \"filePath\" FROM p WHERE NOT (regexp_full_match(path, '(.*/)?[^/]*\\.html(/.*)?') AND NOT regexp_full_match(path, '(.*/)?[^/]*1\\.html(/.*)?'))")
def _(spark, d):
    return url_paths(spark, d).where(~globs.ignored(F.col("filePath"), ["*.html", "!*1.html"]))


ODD_PATHS = "SELECT event_id, ['a/b', '/a', '../x', 'a/../b', 'a/..b', 'b/..'][event_id % 6 + 1] AS p FROM events"


@query("q_paths_inside", f"SELECT event_id, p AS path FROM ({ODD_PATHS}) WHERE NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..')")
def _(spark, d):
    p = F.get(F.array(*[F.lit(x) for x in ("a/b", "/a", "../x", "a/../b", "a/..b", "b/..")]), (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select("event_id", p.alias("path")).where(globs.inside(F.col("path")))


@query("q_filter_values", "SELECT event_id, NOT regexp_matches(v, '[\\x00-\\x1f]') AS valid FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'x' || chr(10) ELSE 'é–ß €' END AS v FROM events)")
def _(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, "a b").when(F.col("event_id") % 3 == 1, "x\n").otherwise("é–ß €")
    return table(spark, d, "events").select("event_id", globs.valid_filter_value(v).alias("valid"))


@query("q_size_guard", f'WITH {FILES} SELECT "filePath", strlen(content) > 2000 AS skipped, CASE WHEN strlen(content) <= 2000 THEN sha256(content) END AS digest FROM files WHERE content IS NOT NULL')
def _(spark, d):
    from loomdex.sources.files import load

    raw = files(spark, d).where("content is not null").select("filePath", F.col("content").cast("binary").alias("content"))
    return load(raw, 2000).select("filePath", "skipped", F.sha2("content", 256).alias("digest"))


BODY_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no query' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'no files' WHEN 4 THEN 'query too long' ELSE 'too large' END AS error FROM events"""


@query("q_body_errors", BODY_SQL)
def _(spark, d):
    made = ('{"query": "a", "files": ["x"]}', '{"query": " ", "files": []}', "{nothing", '{"query": "a"}')
    body = F.coalesce(F.get(F.array(*[F.lit(x) for x in made]), (F.col("event_id") % 6).cast("int")), F.concat(F.lit('{"files": [], "query": "'), F.repeat(F.lit("x"), F.when(F.col("event_id") % 6 == 4, 10_001).otherwise(1 << 20)), F.lit('"}')))
    return table(spark, d, "events").select("event_id", limits.body_error(body).alias("error"))


REST = f'{CHUNKS}, {VECTORS}, scored AS (SELECT *, {cosine_sql("vector", vectors.embed_query("the of and"))} AS score FROM embedded WHERE starts_with("filePath", \'src1/\'))'


@query("q_rest_search", f'{REST} SELECT CAST(row_number() OVER (ORDER BY score DESC, "filePath", id) AS INTEGER) AS rank, "filePath" AS file, sha256(content) AS digest FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, "filePath", id) <= 20')
def _(spark, d):
    given = chunks(spark, d).where(F.col("filePath").startswith("src1/"))
    return search.rest_rows(given, "the of and").select("rank", "file", F.sha2("content", 256).alias("digest"))


# ---------------------------------------------------------------- JSON


@query("q_json_vectors", f"SELECT vec_id, round({cosine_sql('embedding', PROBE)}, 6) AS score FROM embeddings WHERE vec_id % 7 <> 0")
def _(spark, d):
    e = table(spark, d, "embeddings")
    stored = e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.lit("[1.0, oops")).otherwise(jsons.vector_json(vectors.doubles(F.col("embedding")))).alias("json"))
    return jsons.parse_vectors(stored)[0].select("vec_id", F.round(vectors.cosine(F.col("vector"), PROBE), 6).alias("score"))


@query("q_json_vectors_corrupt", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0")
def _(spark, d):
    stored = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 14 == 0, F.lit("[1.0, oops")).when(F.col("vec_id") % 7 == 0, F.lit(None)).otherwise(jsons.vector_json("embedding")).alias("json"))
    return jsons.parse_vectors(stored)[1].select("vec_id")


@query("q_match_lines", f'WITH {FILES}, {LINES} SELECT "filePath", "lineNumber", "lineText", CAST(strpos("lineText", \'the\') - 1 AS INTEGER) AS start FROM lines WHERE contains("lineText", \'the\') AND "lineNumber" % 2 = 0')
def _(spark, d):
    hit = lines(spark, d).where(F.col("lineText").contains("the"))
    at = (F.instr("lineText", "the") - 1).alias("start")
    sub = F.array(F.struct(F.struct(F.lit("the").alias("text")).alias("match"), at, (at + 3).alias("end")))
    data = F.struct(F.struct(F.concat(F.lit("./"), F.col("filePath")).alias("text")).alias("path"), F.struct(F.concat("lineText", F.lit("\n")).alias("text")).alias("lines"), F.col("lineNumber").alias("line_number"), sub.alias("submatches"))
    record = F.to_json(F.struct(F.when(F.col("lineNumber") % 2 == 0, "match").otherwise("context").alias("type"), data.alias("data")))
    raw = hit.select(F.explode(F.array(record, F.lit('{"type":"match","data":'), F.lit("?"))).alias("value"))
    return jsons.parse_matches(raw).select("filePath", "lineNumber", "lineText", F.col("submatches")[0]["start"].alias("start"))


@query("q_result_json", "SELECT event_id, '{\"id\":\"' || event_id || '\",\"kind\":\"' || event_type || '\",\"none\":null}' AS json FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return jsons.result_json(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("none"))).select(F.get_json_object("json", "$.id").cast("long").alias("event_id"), "json")


# ---------------------------------------------------------------- queues


def queue_rows(events):
    n = F.col("event_id")
    kind = F.when(n % 97 == 0, "scan_started").when(n % 97 == 40, "scan_finished").when(n % 31 == 0, "drained").otherwise("modified")
    return events.select((n % 16).alias("queue"), n.alias("seq"), kind.alias("type"), (n % 61).cast("string").alias("filePath"))


def queue_events(spark, d):
    return queue_rows(table(spark, d, "events"))


MACHINE = """WITH RECURSIVE e AS (SELECT event_id % 16 AS queue, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'scan_started' WHEN event_id % 97 = 40 THEN 'scan_finished' WHEN event_id % 31 = 0 THEN 'drained' ELSE 'modified' END AS type, CAST(event_id % 61 AS VARCHAR) AS p, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS i FROM events),
r AS (SELECT queue, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS BOOLEAN) AS accepted, 'normal' AS state, CAST([] AS VARCHAR[]) AS held FROM (SELECT DISTINCT queue FROM e)
UNION ALL SELECT r.queue, e.i, e.seq, e.type, e.type <> 'modified' OR (r.state = 'normal' AND (list_contains(r.held, e.p) OR len(r.held) < 20)),
CASE WHEN e.type = 'scan_started' THEN 'full_scan' WHEN e.type = 'scan_finished' THEN 'normal' WHEN e.type = 'drained' OR r.state <> 'normal' THEN r.state WHEN NOT list_contains(r.held, e.p) AND len(r.held) >= 11 THEN 'overflow' ELSE r.state END,
CASE WHEN e.type = 'scan_started' OR (e.type = 'drained' AND r.state = 'normal') THEN [] WHEN e.type <> 'modified' OR r.state <> 'normal' OR list_contains(r.held, e.p) OR len(r.held) >= 20 THEN r.held ELSE list_append(r.held, e.p) END
FROM r JOIN e ON e.queue = r.queue AND e.i = r.i + 1)
SELECT CAST(queue AS VARCHAR) AS queue, seq, type, accepted, state FROM r WHERE i > 0"""


@query("q_queue_machine", MACHINE)
def _(spark, d):
    return events.machine(queue_events(spark, d), 20, 12)


@query("q_lanes", "SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS lane FROM events")
def _(spark, d):
    e = file_events(spark, d).withColumn("type", F.when(F.col("type") == "added", "reindex").otherwise(F.col("type")))
    return events.lanes(e).select("seq", "lane")


@query("q_retry", "SELECT event_id AS seq FROM events WHERE event_id % 3 = 1 OR (event_id % 3 = 2 AND event_type = 'signup')")
def _(spark, d):
    error = F.when(F.col("seq") % 3 == 1, "database is locked").when(F.col("seq") % 3 == 2, "ENOENT: no such file")
    e = file_events(spark, d).withColumn("type", F.when(F.col("type") == "added", "reindex").otherwise(F.col("type"))).withColumn("error", error)
    return events.retry(e).select("seq")


HELD = "WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS p FROM events WHERE ts < TIMESTAMP '2024-01-05'), g AS (SELECT p, min(seq) AS f, max(seq) AS l FROM e GROUP BY p), k AS (SELECT * FROM g ORDER BY f LIMIT 5)"


@query("q_hold_back", f"{HELD} SELECT e.seq, k.l IS NOT NULL AND e.seq = k.l AS released, (SELECT count(*) > 5 FROM g) AS missed FROM e LEFT JOIN k ON k.p = e.p")
def _(spark, d):
    return events.hold_back(file_events(spark, d), F.lit("2024-01-05").cast("timestamp"), 5).select("seq", "released", "missed")


# ---------------------------------------------------------------- nodes and metrics


@query("q_node_eviction", "SELECT user_id AS port, max(ts) AS \"seenAt\", max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND AS alive FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("port"), F.col("event_type").alias("node"), F.col("ts").alias("seenAt"))
    now = F.lit(e.agg(F.max("seenAt").cast("string")).first()[0]).cast("timestamp_ntz")
    return metrics.evict(metrics.nodes(e), now, 86_400).select("port", "seenAt", "alive")


@query("q_metrics_scrape", "SELECT CAST(user_id AS VARCHAR) AS node, event_type AS name, round(value, 2) AS value FROM events WHERE event_id % 5 < 3")
def _(spark, d):
    n = F.col("event_id") % 5
    metric = F.to_json(F.struct(F.col("user_id").cast("string").alias("node"), F.array(F.struct(F.col("event_type").alias("name"), F.lit("gauge").alias("type"), F.col("value"))).alias("metrics")))
    answers = table(spark, d, "events").select(F.when(n < 3, metric).when(n == 3, F.lit('{"node": "x", "metrics": "down"}')).alias("value"))
    return metrics.scrape(answers).select("node", "name", F.round("value", 2).alias("value"))


@query("q_label_sum", "SELECT event_type, round(sum(CASE WHEN user_id % 2 = 0 THEN value END), 2) AS even FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").withColumn("labels", F.create_map(F.lit("side"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
    return e.groupBy("event_type").agg(F.round(metrics.label_sum(e, "side", "even"), 2).alias("even"))


# ---------------------------------------------------------------- blobs, dead letters, tree


@query("q_blobs", "WITH b AS (SELECT DISTINCT sha256(text) AS hash, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) SELECT hash, CAST(size AS BIGINT) AS size FROM b WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 0)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    empty = spark.createDataFrame([], blobs.SCHEMA)
    half = blobs.put(blobs.put(empty, docs.where("doc_id % 4 = 0")), docs.where("doc_id % 2 = 0"))
    return blobs.delete(half, docs.where("doc_id % 10 = 0 and content is not null").select(F.sha2("content", 256).alias("hash"))).select("hash", "size")


@query("q_blobs_in_use", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND lang = 'fr'")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("text").alias("content"))
    every = blobs.put(spark.createDataFrame([], blobs.SCHEMA), docs)
    return blobs.collect_garbage(every, docs.where("lang = 'fr' and content is not null").select(F.sha2("content", 256).alias("hash"))).select("hash")


@query("q_dlq_remove", f"{ENTRIES} SELECT id FROM e WHERE NOT (p = 'f1' OR starts_with(p, 'f1/') OR p = 'f2/x' OR starts_with(p, 'f2/x/'))".replace("e WHERE", "(SELECT *, 'f' || (rn % 5) || '/' || ['x', 'y'][rn % 2 + 1] AS p FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM e)) WHERE"))
def _(spark, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy().orderBy("id"))
    e = entries(spark, d).withColumn("rn", n).withColumn("filePath", F.concat(F.lit("f"), (F.col("rn") % 5).cast("string"), F.lit("/"), F.get(F.array(F.lit("x"), F.lit("y")), (F.col("rn") % 2).cast("int"))))
    gone = spark.createDataFrame([("f1",), ("f2/x",)], "path string")
    return dead_letters.remove_all(e, gone).select("id")


TREE_FILES = "WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS hash, doc_id, source, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"
LEVELS = "l2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS hash FROM g GROUP BY 1), l1 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS hash FROM l2 GROUP BY 1)"


def tree_files(spark, d):
    return files(spark, d).where("content is not null and language is not null and not startswith(filePath, '/')").select(F.col("filePath").alias("path"), F.sha2("content", 256).alias("hash"))


@query("q_delete_subtrees", f"{TREE_FILES} SELECT path FROM f WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src2/en/')")
def _(spark, d):
    return merkle.delete_subtrees(tree_files(spark, d), spark.createDataFrame([("src1",), ("src2/en/",)], "path string")).select("path")


@query("q_merkle_update", f"{TREE_FILES}, g AS (SELECT path, CASE WHEN doc_id % 50 = 0 THEN sha256('new ' || path) ELSE hash END AS hash FROM f WHERE NOT starts_with(path, 'src1/') UNION ALL SELECT 'src1/en/new.txt', sha256('fresh')), {LEVELS} SELECT path, hash FROM l2 UNION ALL SELECT path, hash FROM l1")
def _(spark, d):
    base = tree_files(spark, d)
    nodes = merkle.build(base, "sha256")
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    changed = base.where((number % 50 == 0) & ~F.col("path").startswith("src1/")).select("path", F.sha2(F.concat(F.lit("new "), "path"), 256).alias("hash"))
    changed = changed.unionByName(spark.createDataFrame([("src1/en/new.txt",)], "path string").select("path", F.sha2(F.lit("fresh"), 256).alias("hash")))
    return merkle.update(nodes, changed, spark.createDataFrame([("src1",)], "path string"), "sha256").where("isDirectory").select("path", "hash")


@query("q_prune_empty", f"{TREE_FILES}, k AS (SELECT * FROM f WHERE lang <> 'de') SELECT DISTINCT source || '/' || lang AS path FROM k UNION SELECT DISTINCT source FROM k")
def _(spark, d):
    nodes = merkle.build(tree_files(spark, d), "sha256")
    return merkle.prune_empty(nodes.where("isDirectory or not contains(path, '/de/')")).where("isDirectory").select("path")


@query("q_rename_node", "SELECT DISTINCT CASE WHEN source = 'src1' THEN 'moved/to' ELSE source END AS path, CASE WHEN source = 'src1' THEN 'moved' END AS parent FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    nodes = merkle.rename_node(merkle.build(tree_files(spark, d), "sha256"), "src1", "moved/to", "h")
    return nodes.where("isDirectory and (parentPath is null or path = 'moved/to')").select("path", F.col("parentPath").alias("parent"))


# ---------------------------------------------------------------- the store

BATCH = f"{CHUNKS}, old AS (SELECT * FROM chunks WHERE \"filePath\" IS NOT NULL), moved AS (SELECT replace(id, 'src2/en/', 'm/') AS id, replace(\"filePath\", 'src2/en/', 'm/') AS p FROM old WHERE starts_with(\"filePath\", 'src2/en/')), kept AS (SELECT id, \"filePath\" AS p FROM old WHERE NOT starts_with(\"filePath\", 'src2/en/') AND NOT starts_with(\"filePath\", 'src1/')  AND language <> 'de'), fresh AS (SELECT id || '!' AS id, \"filePath\" AS p FROM old WHERE language = 'de' AND \"startLine\" = 1 AND NOT starts_with(\"filePath\", 'src2/en/'))"


@query("q_store_batch", f"{BATCH} SELECT id, p AS \"filePath\" FROM moved UNION ALL SELECT id, p FROM kept UNION ALL SELECT id, p FROM fresh")
def _(spark, d):
    rows = chunking.line_windows(files(spark, d)).where("filePath is not null").withColumn("hash", F.lit("h")).withColumn("vector", F.array_repeat(F.lit(1.0).cast("float"), 4))
    held = store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 4)
    held.rebuild(rows)
    paths = held.rows().select("filePath").distinct()
    renames = paths.where("startswith(filePath, 'src2/en/')").select(F.col("filePath").alias("oldPath"), F.replace("filePath", F.lit("src2/en/"), F.lit("m/")).alias("newPath"))
    german = rows.where("language = 'de'")
    held.apply(german.where("startLine = 1").withColumn("id", F.concat("id", F.lit("!"))), german.select("filePath").distinct(), spark.createDataFrame([("src1",)], "path string"), renames)
    return held.rows().select("id", "filePath")


@query("q_cache_store", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    held = store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 2)
    new = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash")).distinct()
    made = new.select("hash", F.array_repeat(F.lit(0.5).cast("float"), 2).alias("vector"), F.lit(2).alias("dimensions"), F.lit("2024-01-01").cast("timestamp").alias("createdAt"))
    held.save_cache(store.cache_put(spark.createDataFrame([], schemas.EMBEDDING_CACHE), made))
    return store.ChunkStore(spark, held.root, 2).cache().select("hash")
