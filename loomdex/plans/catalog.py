"""Every operator as a query over the tables of a folder, and the same as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import globs, text, vectors
from loomdex.functions.hashing import content_hash
from loomdex.operators import chunking, context, dead_letters, events, merkle, metrics, search, store
from loomdex.sources.files import documents_as_files, read_range

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERY_TEXT, GREP_TEXT = "the of and", "the of"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_files(table(spark, d, "documents"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_windows(files(spark, d)).withColumn("vector", vectors.embed_sha256(F.col("content")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.explode_lines(files(spark, d))


# Shared SQL: files, their lines, and line windows with the test embedding.
FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS \"filePath\", lang AS language, text AS content, doc_id FROM documents)"
LINES = "lines AS (SELECT \"filePath\", language, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS \"lineNumber\", unnest(l) AS \"lineText\" FROM (SELECT *, CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS l FROM files WHERE content IS NOT NULL) WHERE len(l) > 0)"


def windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""split AS (SELECT "filePath", language, CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS l FROM files),
win AS (SELECT *, unnest(generate_series(0, greatest(1, CAST(ceil((len(l) - {overlap}) / {step}.0) AS BIGINT)) - 1)) AS w FROM split WHERE len(l) > 0),
ranged AS (SELECT *, CAST({step} * w + 1 AS INTEGER) AS "startLine", CAST(least({step} * w + {size}, len(l)) AS INTEGER) AS "endLine" FROM win),
chunks AS (SELECT "filePath" || ':' || "startLine" || '-' || "endLine" || ':file-' || (w + 1) AS id, "filePath", array_to_string(l["startLine":"endLine"], chr(10)) AS content, language, CAST(NULL AS VARCHAR) AS "symbolName", 'file' AS "symbolKind", "startLine", "endLine" FROM ranged)"""


CHUNKS = f"WITH {FILES}, {windows_sql(50, 10)}"
DIGIT = "(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
BYTE = f"({DIGIT.format(h='h', i='2 * (i % 32) + 1')} * 16 + {DIGIT.format(h='h', i='2 * (i % 32) + 2')})"
VECTORS = f"hashed AS (SELECT *, sha256(content) AS h FROM chunks), embedded AS (SELECT *, list_transform(generate_series(0, 63), lambda i: CAST({BYTE} AS DOUBLE) / 255) AS vector FROM hashed)"


def cosine_sql(column: str, q: list[float]) -> str:
    literal = "[" + ", ".join(f"{x!r}::DOUBLE" for x in q) + "]"
    return f"list_cosine_similarity({column}::DOUBLE[], {literal})"


QUERY_VECTOR = vectors.embed_query(QUERY_TEXT)
SEMANTIC = f"{CHUNKS}, {VECTORS}, scored AS (SELECT *, {cosine_sql('vector', QUERY_VECTOR)} AS score FROM embedded)"
CHUNK_COLUMNS = 'id, "filePath", content, language, "symbolName", "symbolKind", "startLine", "endLine"'
#: A fixed query of 64 components for the embeddings table.
PROBE = [((7 * i) % 13 - 6) / 13 for i in range(64)]


# ---------------------------------------------------------------- chunks


@query("q_line_explode", f'WITH {FILES}, {LINES} SELECT "filePath", "lineNumber", "lineText" FROM lines')
def _(spark, d):
    return lines(spark, d).select("filePath", "lineNumber", "lineText")


@query("q_chunk_line_windows", f"{CHUNKS} SELECT {CHUNK_COLUMNS} FROM chunks")
def _(spark, d):
    return chunking.line_windows(files(spark, d))


@query("q_chunk_small_overlap", f"WITH {FILES}, {windows_sql(20, 5)} SELECT {CHUNK_COLUMNS} FROM chunks")
def _(spark, d):
    return chunking.line_windows(files(spark, d), 20, 5)


@query("q_chunk_split_max_chars")
def _(spark, d):
    return chunking.split_max_chars(chunking.line_windows(files(spark, d)))


@query("q_chunk_files")
def _(spark, d):
    return chunking.chunk_files(files(spark, d))


@query("q_embed_sha256", f"{CHUNKS}, {VECTORS} SELECT id, list_sum(vector) AS total, vector[1] AS first, vector[64] AS last FROM embedded".replace("list_sum(vector)", "round(list_sum(vector), 9)"))
def _(spark, d):
    v = F.col("vector")
    total = F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 9)
    return chunks(spark, d).select("id", total.alias("total"), v[0].alias("first"), v[63].alias("last"))


# ---------------------------------------------------------------- similarity


def knn_rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


@query("q_cosine_topk", f"SELECT vec_id, label, round({cosine_sql('embedding', PROBE)}, 9) AS score FROM embeddings ORDER BY {cosine_sql('embedding', PROBE)} DESC, vec_id LIMIT 20")
def _(spark, d):
    return search.knn(knn_rows(spark, d), PROBE, 20, ties=("vec_id",)).select("vec_id", "label", F.round("score", 9).alias("score"))


@query("q_cosine_topk_arrow", f"SELECT vec_id, label, round({cosine_sql('embedding', PROBE)}, 9) AS score FROM embeddings ORDER BY {cosine_sql('embedding', PROBE)} DESC, vec_id LIMIT 20")
def _(spark, d):
    return search.knn(knn_rows(spark, d), PROBE, 20, ties=("vec_id",), arrow=True).select("vec_id", "label", F.round("score", 9).alias("score"))


@query("q_cosine_topk_filtered", f"SELECT vec_id, label, round({cosine_sql('embedding', PROBE)}, 9) AS score FROM embeddings WHERE label = 3 ORDER BY {cosine_sql('embedding', PROBE)} DESC, vec_id LIMIT 10")
def _(spark, d):
    return search.knn(knn_rows(spark, d).where("label = 3"), PROBE, 10, ties=("vec_id",)).select("vec_id", "label", F.round("score", 9).alias("score"))


@query("q_cosine_zero_vector", f"WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT -1, list_transform(generate_series(1, 64), lambda i: 0.0::DOUBLE)) SELECT vec_id, round(CASE WHEN list_sum(list_transform(v, lambda x: abs(x))) = 0 THEN 0.0 ELSE {cosine_sql('v', PROBE)} END, 9) AS score FROM r")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    zero = spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.0), 64).alias("v"))
    return rows.unionByName(zero).select("vec_id", F.round(vectors.cosine(F.col("v"), PROBE), 9).alias("score"))


@query("q_knn_per_label", f"SELECT label, rank, vec_id, round(score, 9) AS score FROM (SELECT label, vec_id, {cosine_sql('embedding', PROBE)} AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY {cosine_sql('embedding', PROBE)} DESC, vec_id) AS INTEGER) AS rank FROM embeddings) WHERE rank <= 3")
def _(spark, d):
    from pyspark.sql.window import Window

    scored = knn_rows(spark, d).withColumn("score", vectors.cosine(F.col("vector"), PROBE))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("label", "rank", "vec_id", F.round("score", 9).alias("score"))


@query("q_vector_check", "SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS usable FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & vectors.finite(F.col("embedding"))).alias("usable"))


@query("q_semantic_search", f'{SEMANTIC} SELECT id, "filePath", "startLine", "endLine", round(score, 9) AS score, \'semantic\' AS source FROM scored ORDER BY scored.score DESC, "filePath", id LIMIT 20')
def _(spark, d):
    return search.semantic_search(chunks(spark, d), QUERY_TEXT).select("id", "filePath", "startLine", "endLine", F.round("score", 9).alias("score"), "source")


@query("q_semantic_language", f'{SEMANTIC} SELECT id, round(score, 9) AS score FROM scored WHERE language = \'fr\' ORDER BY scored.score DESC, "filePath", id LIMIT 10')
def _(spark, d):
    return search.semantic_search(chunks(spark, d), QUERY_TEXT, 10, language="fr").select("id", F.round("score", 9).alias("score"))


@query("q_semantic_glob", f'{SEMANTIC} SELECT id, round(score, 9) AS score FROM scored WHERE regexp_full_match("filePath", \'src1[^/]*/en/.*\') OR regexp_full_match("filePath", \'src2/[^/]/.*\') ORDER BY scored.score DESC, "filePath", id LIMIT 20')
def _(spark, d):
    return search.semantic_search(chunks(spark, d), QUERY_TEXT, patterns=["src1*/en/**", "src2/?/**", " "]).select("id", F.round("score", 9).alias("score"))


@query("q_semantic_oversample_glob", f'{SEMANTIC}, top AS (SELECT * FROM scored ORDER BY score DESC, "filePath", id LIMIT 100) SELECT id, round(score, 9) AS score FROM top WHERE regexp_full_match("filePath", \'.*/en/[^/]*\\.txt\') ORDER BY top.score DESC, "filePath", id LIMIT 20')
def _(spark, d):
    return search.semantic_search(chunks(spark, d), QUERY_TEXT, patterns=["**/en/*.txt"], oversample=True).select("id", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- line search


GREP = f'WITH {FILES}, {LINES} SELECT "filePath", "lineNumber", "lineText" FROM lines WHERE {{}} ORDER BY "filePath", "lineNumber" LIMIT {{}}'


@query("q_grep_literal", GREP.format("contains(lower(\"lineText\"), 'the of')", 100))
def _(spark, d):
    return search.grep(lines(spark, d), "the of", fixed=True).select("filePath", "lineNumber", "lineText")


@query("q_grep_case", GREP.format("contains(\"lineText\", 'The ')", 100))
def _(spark, d):
    return search.grep(lines(spark, d), "The ", fixed=True, case_sensitive=True).select("filePath", "lineNumber", "lineText")


@query("q_grep_regex", GREP.format("regexp_matches(\"lineText\", '(th|er)[aeiou]nd [a-z]+ing', 'i')", 50))
def _(spark, d):
    return search.grep(lines(spark, d), "(th|er)[aeiou]nd [a-z]+ing", max_results=50).select("filePath", "lineNumber", "lineText")


@query("q_grep_glob", GREP.format("starts_with(\"filePath\", 'src3/') AND contains(lower(\"lineText\"), 'the')", 100))
def _(spark, d):
    return search.grep(lines(spark, d), "the", ["src3/**"], fixed=True).select("filePath", "lineNumber", "lineText")


@query("q_grep_submatches", f'WITH {FILES}, {LINES}, hit AS (SELECT "filePath", "lineNumber", "lineText" FROM lines WHERE contains(lower("lineText"), \'thing\') ORDER BY "filePath", "lineNumber" LIMIT 100) SELECT "filePath", "lineNumber", len(regexp_extract_all("lineText", \'thing\', 0, \'i\')) AS n, strlen(string_split(lower("lineText"), \'thing\')[1]) AS start FROM hit')
def _(spark, d):
    found = search.submatches(search.grep(lines(spark, d), "thing", fixed=True).select("filePath", "lineNumber", "lineText"), "thing", fixed=True)
    return found.select("filePath", "lineNumber", F.size("submatches").cast("long").alias("n"), F.col("submatches")[0]["start"].cast("long").alias("start"))


HYBRID = f"""{SEMANTIC.replace("WITH " + FILES, "WITH " + FILES + ", " + LINES)},
sem AS (SELECT {CHUNK_COLUMNS}, score, row_number() OVER (ORDER BY score DESC, "filePath", id) - 1 AS pos FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, "filePath", id) <= 20),
hits AS (SELECT *, row_number() OVER (ORDER BY "filePath", "lineNumber") - 1 AS pos FROM (SELECT "filePath", "lineNumber", "lineText" FROM lines WHERE contains(lower("lineText"), '{GREP_TEXT}') ORDER BY "filePath", "lineNumber" LIMIT 20)),
aligned AS (SELECT h."filePath", h."lineNumber", h."lineText", h.pos, s.id, s."startLine", s."endLine" FROM hits h LEFT JOIN LATERAL (SELECT * FROM sem s WHERE s."filePath" = h."filePath" AND h."lineNumber" BETWEEN s."startLine" AND s."endLine" ORDER BY s.pos LIMIT 1) s ON true),
legs AS (SELECT id, "filePath", "startLine", "endLine", 'semantic' AS source, 0 AS leg, pos FROM sem
UNION ALL SELECT coalesce(id, "filePath" || ':' || "lineNumber"), "filePath", coalesce("startLine", "lineNumber"), coalesce("endLine", "lineNumber"), 'grep', 1, pos FROM aligned),
fused AS (SELECT id, any_value("filePath") AS "filePath", any_value("startLine") AS "startLine", any_value("endLine") AS "endLine", round(sum(1.0::DOUBLE / (60 + pos + 1)), 12) AS score, count(*) AS hits, arg_min(source, leg * 1000 + pos) AS first_source, min(leg * 1000 + pos) AS seen FROM legs GROUP BY id),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, "filePath", seen) AS INTEGER) AS rank, id, "filePath", "startLine", "endLine", score, CASE WHEN hits > 1 THEN 'hybrid' ELSE first_source END AS source FROM fused QUALIFY row_number() OVER (ORDER BY score DESC, "filePath", seen) <= 20)"""


def hybrid(spark, d):
    return search.hybrid_search(chunks(spark, d), lines(spark, d), QUERY_TEXT, GREP_TEXT).select("rank", "chunk.id", "chunk.filePath", "chunk.startLine", "chunk.endLine", "score", "source")


@query("q_hybrid_search", f'{HYBRID} SELECT rank, id, "filePath", "startLine", "endLine", score, source FROM ranked')
def _(spark, d):
    return hybrid(spark, d)


@query("q_grep_to_chunk", f'{HYBRID} SELECT "filePath", "lineNumber", coalesce(id, "filePath" || \':\' || "lineNumber") AS id FROM aligned')
def _(spark, d):
    semantic = search.positioned(search.semantic_search(chunks(spark, d), QUERY_TEXT), F.desc("score"), "filePath", "id")
    hits = search.positioned(search.grep(lines(spark, d), GREP_TEXT, max_results=20, fixed=True), "filePath", "lineNumber")
    joined = search.lines_to_chunks(hits, semantic).select("pos", "chunk.id")
    return hits.select("filePath", "lineNumber", "pos").join(joined, "pos").select("filePath", "lineNumber", "id")


@query("q_rrf_fuse", f"{HYBRID} SELECT source, count(*) AS n, round(sum(score), 9) AS total FROM ranked GROUP BY source")
def _(spark, d):
    return hybrid(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("score"), 9).alias("total"))


@query("q_hybrid_snippets", f"""{HYBRID}, sized AS (SELECT r.rank, r.id, string_split(f.content, chr(10)) AS l, greatest(1, r."startLine" - 3) AS s, r."endLine" + 3 AS e FROM ranked r JOIN files f ON f."filePath" = r."filePath")
SELECT rank, id, CAST(s AS INTEGER) AS "snippetStartLine", CAST(least(len(l), e) AS INTEGER) AS "snippetEndLine", array_to_string(l[s:least(len(l), e)], chr(10)) AS snippet FROM sized""")
def _(spark, d):
    return context.snippets(hybrid(spark, d), files(spark, d)).select("rank", "id", "snippetStartLine", "snippetEndLine", "snippet")


ISLANDS = """WITH flagged AS (SELECT *, CASE WHEN coalesce(max(e) OVER (PARTITION BY p ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 < s THEN 1 ELSE 0 END AS new FROM ranges),
isl AS (SELECT p, s, e, sum(new) OVER (PARTITION BY p ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
one AS (SELECT p, island, max(e) - min(s) + 1 AS n FROM isl GROUP BY p, island) SELECT p AS "filePath", count(*) AS islands, CAST(sum(n) AS BIGINT) AS lines FROM one GROUP BY p"""


@query("q_snippet_line_count", ISLANDS.replace("WITH flagged", "WITH ranges AS (SELECT user_id AS p, event_id % 97 AS s, event_id % 97 + event_id % 7 AS e FROM events), flagged"))
def _(spark, d):
    e = table(spark, d, "events")
    return context.merged_lines(e.select(F.col("user_id").alias("filePath"), (F.col("event_id") % 97).alias("startLine"), (F.col("event_id") % 97 + F.col("event_id") % 7).alias("endLine")))


CONTEXT = "WITH " + FILES + ", n AS (SELECT \"filePath\", string_split(content, chr(10)) AS l FROM files), r AS (SELECT *, CAST(len(l) AS INTEGER) AS \"totalLines\", {s} AS s, {e} AS e FROM n) SELECT \"filePath\", \"totalLines\", CAST(s AS INTEGER) AS \"startLine\", CAST(e AS INTEGER) AS \"endLine\", array_to_string(l[s:e], chr(10)) AS content FROM r WHERE s <= e"


@query("q_context_eager", CONTEXT.format(s="greatest(1, least(3, len(l)))", e="greatest(1, least(8, len(l)))"))
def _(spark, d):
    return context.get_context(files(spark, d), 3, 8)


@query("q_context_deferred", CONTEXT.format(s="greatest(1, least(5, len(l)))", e="least(greatest(1, least(5, len(l))) + 19, len(l))"))
def _(spark, d):
    return context.get_context(files(spark, d), start=5, deferred=True)


@query("q_context_tail", CONTEXT.format(s="greatest(1, greatest(1, least(30, len(l))) - 19)", e="greatest(1, least(30, len(l)))"))
def _(spark, d):
    return context.get_context(files(spark, d), end=30, deferred=True)


@query("q_read_range", f'WITH {FILES} SELECT "filePath", array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS part FROM files WHERE len(string_split(content, chr(10))) >= 2')
def _(spark, d):
    f = files(spark, d).where(F.size(text.lines(F.col("content"))) >= 2)
    return f.select("filePath", read_range(F.col("content"), F.lit(2), F.lit(4)).alias("part"))


# ---------------------------------------------------------------- predicates


URL_PATH = "regexp_replace(url, '^https?://', '')"


def url_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("filePath"))


@query("q_ignore_filter", f"WITH p AS (SELECT page_id, {URL_PATH} AS path FROM pages) SELECT page_id, path AS \"filePath\" FROM p WHERE NOT regexp_full_match(path, '(.*/)?(a[^/]*|[^/]*\\.html)(/.*)?')")
def _(spark, d):
    return url_paths(spark, d).where(~globs.ignored(F.col("filePath"), ["./a*/", "*.html", " "]))


@query("q_prefix_filter", f"WITH p AS (SELECT page_id, {URL_PATH} AS path FROM pages) SELECT page_id, path AS \"filePath\" FROM p WHERE starts_with(path, 'www')")
def _(spark, d):
    return url_paths(spark, d).where(search.chunk_filter(prefix="www"))


@query("q_in_filter", f'WITH {FILES} SELECT "filePath", language FROM files WHERE "filePath" IN (\'src0/en/0.txt\', \'src1/en/1.txt\', \'src2/fr/2.txt\', \'src3/de/3.txt\')')
def _(spark, d):
    return files(spark, d).where(search.chunk_filter(paths=["src0/en/0.txt", "src1/en/1.txt", "src2/fr/2.txt", "src3/de/3.txt"])).select("filePath", "language")


@query("q_glob_filter", f"WITH {FILES} SELECT \"filePath\" FROM files WHERE regexp_full_match(\"filePath\", 'src[^/]/(.*)/[^/]*7\\.txt')")
def _(spark, d):
    return files(spark, d).where(globs.glob_filter(F.col("filePath"), ["src?/**/*7.txt"])).select("filePath")


LANGUAGE_SQL = "CASE " + " ".join(f"WHEN lower(regexp_extract(p, '\\.([^./]+)$', 1)) = '{k}' THEN '{v}'" for k, v in text.LANGUAGE_OF.items()) + " ELSE 'unknown' END"
PARSER_SQL = "CASE " + " ".join(f"WHEN p LIKE '%{e}' THEN '{k}'" for k, es in text.PARSED.items() for e in es) + " ELSE 'text' END"
ENDINGS = "['ts', 'py', 'go', 'tsx', 'JS', 'md', 'hpp', 'xyz', 'sh', 'tar.gz']"


@query("q_language_infer", f"WITH f AS (SELECT doc_id, source || '/' || doc_id || '.' || {ENDINGS}[doc_id % 10 + 1] AS p FROM documents) SELECT p AS \"filePath\", {LANGUAGE_SQL} AS by_extension, {PARSER_SQL} AS by_parser FROM f")
def _(spark, d):
    endings = F.array(*[F.lit(x) for x in ("ts", "py", "go", "tsx", "JS", "md", "hpp", "xyz", "sh", "tar.gz")])
    f = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.get(endings, (F.col("doc_id") % 10).cast("int"))).alias("filePath"))
    return f.select("filePath", text.extension_language(F.col("filePath")).alias("by_extension"), text.parser_language(F.col("filePath")).alias("by_parser"))


MESSAGES = ("Invalid line range: 3-1", "already_running", "Dimension 3 is not 4", "ENOENT: /home/u/x", "Permission denied", "SQLite is locked", "fetch failed /tmp/x", "boom ../../up")
CODE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{c}'" for c, p in text.ERROR_WORDS) + " ELSE 'INTERNAL_ERROR' END"


@query("q_error_classify", "WITH e AS (SELECT event_id, [" + ", ".join(f"'{m}'" for m in MESSAGES) + f"][event_id % 8 + 1] AS m FROM events) SELECT event_id, {CODE_SQL} AS code, CASE WHEN regexp_matches(m, '(?i)/(home|users|tmp|var|etc|opt)/|[a-z]:\\\\|\\.\\./') AND NOT regexp_matches(m, '(?i)fetch failed|econnrefused|econnreset|etimedout|https?://') THEN 'Internal server error (potential path leak prevented)' ELSE m END AS message FROM e")
def _(spark, d):
    m = F.get(F.array(*[F.lit(x) for x in MESSAGES]), (F.col("event_id") % 8).cast("int"))
    e = table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", text.error_code(F.col("m")).alias("code"), text.redact(F.col("m")).alias("message"))


@query("q_path_functions", f"""WITH {FILES} SELECT "filePath", regexp_replace("filePath", '/[^/]*$', '') AS parent, list_last(string_split("filePath", '/')) AS name, [string_split("filePath", '/')[1], array_to_string(string_split("filePath", '/')[1:2], '/')] [2] AS second, CAST(length("filePath") AS INTEGER) AS units FROM files""")
def _(spark, d):
    p = F.col("filePath")
    return files(spark, d).select("filePath", text.dirname(p).alias("parent"), text.basename(p).alias("name"), F.get(text.ancestors(p), 1).alias("second"), text.utf16_length(p).alias("units"))


@query("q_duration_format", "SELECT event_id, CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) || 'ms' ELSE format('{:.1f}', v / 1000.0) || 's' END AS shown FROM (SELECT event_id, event_id * 100 % 2500 AS v FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", text.duration(F.col("event_id") * 100 % 2500).alias("shown"))


# ---------------------------------------------------------------- store


OLD_NEW = f"{CHUNKS}, old AS (SELECT c.* FROM chunks c WHERE c.\"startLine\" >= 1), fresh AS (SELECT id, \"filePath\", 'new ' || content AS content, language, \"symbolName\", \"symbolKind\", \"startLine\", \"endLine\" FROM chunks WHERE language = 'de' AND \"startLine\" = 1)"


def fresh(spark, d):
    return chunking.line_windows(files(spark, d)).where("language = 'de' and startLine = 1").withColumn("content", F.concat(F.lit("new "), "content"))


@query("q_upsert_replace", f'{OLD_NEW}, out AS (SELECT * FROM old WHERE "filePath" NOT IN (SELECT "filePath" FROM fresh) UNION ALL SELECT * FROM fresh) SELECT id, language, sha256(content) AS digest FROM out')
def _(spark, d):
    out = store.upsert(chunking.line_windows(files(spark, d)), fresh(spark, d))
    return out.select("id", "language", F.sha2("content", 256).alias("digest"))


@query("q_delete_prefix", f"{CHUNKS} SELECT id FROM chunks WHERE NOT (\"filePath\" = 'src1' OR starts_with(\"filePath\", 'src1/'))")
def _(spark, d):
    return store.delete_prefix(chunking.line_windows(files(spark, d)), "src1").select("id")


@query("q_rename_paths", f"""{CHUNKS}, moves AS (SELECT "filePath" AS o, 'moved/' || "filePath" AS n FROM files WHERE language = 'es') SELECT coalesce(m.n, c."filePath") AS "filePath", coalesce(m.n || substr(c.id, length(c."filePath") + 1), c.id) AS id FROM chunks c LEFT JOIN moves m ON c."filePath" = m.o""")
def _(spark, d):
    moves = files(spark, d).where("language = 'es'").select(F.col("filePath").alias("oldPath"), F.concat(F.lit("moved/"), "filePath").alias("newPath"))
    return store.rename(chunking.line_windows(files(spark, d)), moves).select("filePath", "id")


@query("q_new_files", f'{OLD_NEW} SELECT DISTINCT \'x/\' || "filePath" AS "filePath" FROM fresh')
def _(spark, d):
    affected = fresh(spark, d).select(F.concat(F.lit("x/"), "filePath").alias("filePath")).unionByName(fresh(spark, d).select("filePath"))
    return store.new_files(affected, files(spark, d))


@query("q_fragmentation", "SELECT user_id % 10 AS store, count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'error') AS stale, round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (event_type = 'error') / count(*)::DOUBLE END, 12) AS ratio FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("store")).agg(F.count_if(F.col("event_type") != "error").alias("rows"), F.count_if(F.col("event_type") == "error").alias("stale"))
    return g.select("store", "rows", "stale", F.round(store.fragmentation(F.col("rows"), F.col("stale")), 12).alias("ratio"))


def hashed_files(spark, d):
    return files(spark, d).select("filePath", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def cache(spark, d):
    known = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).distinct()
    return known.select("hash", F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(1).alias("dimensions"), F.lit("2024-01-01").cast("timestamp").alias("createdAt"))


CACHE = f"WITH {FILES}, h AS (SELECT \"filePath\", sha256(content) AS hash FROM files), cache AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0), looked AS (SELECT h.*, c.hash IS NOT NULL AS hit FROM h LEFT JOIN cache c ON h.hash = c.hash)"


@query("q_embedding_cache_miss", f"{CACHE} SELECT DISTINCT hash FROM looked WHERE NOT hit")
def _(spark, d):
    return store.cache_misses(store.cache_lookup(hashed_files(spark, d), cache(spark, d))).select("hash")


@query("q_files_with_misses", f'{CACHE} SELECT DISTINCT "filePath" FROM looked WHERE NOT hit')
def _(spark, d):
    return store.files_with_misses(store.cache_lookup(hashed_files(spark, d), cache(spark, d)))


@query("q_cache_prune", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("createdAt"))
    return store.cache_prune(e, day(spark, d, 0), 5).select("event_id")


@query("q_merge_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return store.latest(e, ["user_id"], F.col("event_id"))


# ---------------------------------------------------------------- hash tree


@query("q_content_hash")
def _(spark, d):
    return files(spark, d).select("filePath", content_hash(F.col("content")).alias("hash"))


TREE = f"""WITH {FILES}, leaf AS (SELECT "filePath" AS path, sha256(content) AS hash, regexp_replace("filePath", '/[^/]*$', '') AS parent FROM files),
l2 AS (SELECT parent AS path, sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS hash, regexp_replace(parent, '/[^/]*$', '') AS up FROM leaf GROUP BY parent),
l1 AS (SELECT up AS path, sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS hash FROM l2 GROUP BY up)"""


def tree(spark, d, digest="sha256"):
    f = hashed_files(spark, d).withColumnRenamed("filePath", "path")
    return merkle.build(f, digest)


@query("q_merkle_dirs", f'{TREE} SELECT path, hash, up AS "parentPath" FROM l2 UNION ALL SELECT path, hash, NULL FROM l1')
def _(spark, d):
    return tree(spark, d).where("isDirectory").select("path", "hash", "parentPath")


@query("q_merkle_root", f"{TREE} SELECT sha256(string_agg(length(path) || ':' || path || ':' || hash, '' ORDER BY path)) AS \"rootHash\" FROM l1")
def _(spark, d):
    return merkle.root_hash(tree(spark, d), "sha256")


@query("q_merkle_root_xxh64")
def _(spark, d):
    return merkle.root_hash(merkle.build(files(spark, d).select(F.col("filePath").alias("path"), content_hash(F.col("content")).alias("hash"))))


@query("q_merkle_subtree", f"WITH {FILES} SELECT path FROM (SELECT \"filePath\" AS path FROM files UNION SELECT regexp_replace(\"filePath\", '/[^/]*$', '') FROM files UNION SELECT source FROM documents) WHERE path = 'src1' OR starts_with(path, 'src1/')")
def _(spark, d):
    return merkle.subtree(tree(spark, d), "src1").select("path")


@query("q_merkle_children", "SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE source = 'src1'")
def _(spark, d):
    return merkle.children(tree(spark, d), "src1").select("path")


def snapshots(spark, d):
    f = hashed_files(spark, d).withColumnRenamed("filePath", "path").withColumn("n", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))
    old = f.where("n % 5 <> 0").select("path", "hash")
    new = f.where("n % 7 <> 0").select("path", F.when(F.col("n") % 11 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    return old, new


DIFF = f"WITH {FILES}, o AS (SELECT \"filePath\" AS path FROM files WHERE doc_id % 5 <> 0), n AS (SELECT \"filePath\" AS path, doc_id % 11 = 0 AS changed FROM files WHERE doc_id % 7 <> 0), diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN changed THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.path = n.path)"


@query("q_snapshot_diff", f"{DIFF} SELECT path, change FROM diff")
def _(spark, d):
    return merkle.diff(*snapshots(spark, d))


@query("q_reconciliation", f"{DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM diff")
def _(spark, d):
    return merkle.reconciliation(merkle.diff(*snapshots(spark, d)))


def rename_events(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, "deleted").otherwise("added").alias("type"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filePath"), F.sha2(F.col("text").cast("binary"), 256).alias("contentHash"))


RENAMES = "WITH e AS (SELECT doc_id AS seq, doc_id % 2 = 0 AS gone, source || '/' || doc_id AS p, sha256(text) AS h FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY h, gone ORDER BY seq) AS n FROM e), pairs AS (SELECT o.p AS \"oldPath\", c.p AS \"newPath\", o.seq AS \"oldSeq\", c.seq AS \"newSeq\" FROM k o JOIN k c ON o.h = c.h AND o.n = c.n AND o.gone AND NOT c.gone)"


@query("q_rename_pairs", f'{RENAMES} SELECT "oldPath", "newPath", "oldSeq", "newSeq" FROM pairs')
def _(spark, d):
    return merkle.rename_pairs(rename_events(spark, d)).select("oldPath", "newPath", "oldSeq", "newSeq")


@query("q_rename_rest", f'{RENAMES} SELECT seq FROM e WHERE seq NOT IN (SELECT "oldSeq" FROM pairs) AND seq NOT IN (SELECT "newSeq" FROM pairs)')
def _(spark, d):
    e = rename_events(spark, d)
    return merkle.apply_renames(e, e)[1].select("seq")


@query("q_orphan_gc", f'WITH {FILES}, l AS (SELECT DISTINCT doc_id FROM labels) SELECT "filePath" AS path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM l)')
def _(spark, d):
    docs = table(spark, d, "documents")
    there = documents_as_files(docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")).select(F.col("filePath").alias("path"))
    return merkle.collect_orphans(tree(spark, d), there)[0]


@query("q_prune_parents", f"WITH {FILES}, kept AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT regexp_replace(\"filePath\", '/[^/]*$', '') AS path FROM kept UNION SELECT split_part(\"filePath\", '/', 1) FROM kept")
def _(spark, d):
    docs = table(spark, d, "documents")
    there = documents_as_files(docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")).select(F.col("filePath").alias("path"))
    return merkle.collect_orphans(tree(spark, d), there)[1].where("isDirectory").select("path")


# ---------------------------------------------------------------- events


TYPE_SQL = "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END"


def file_events(spark, d, stream=None):
    e = stream if stream is not None else table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").cast("string").alias("filePath"), F.col("props").alias("contentHash"), F.col("ts").cast("timestamp").alias("detectedAt"))


GAP_S = 3600
SESSIONS = f"WITH e AS (SELECT event_id AS seq, {TYPE_SQL} AS type, CAST(user_id AS VARCHAR) AS p, ts FROM events), f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {GAP_S} SECOND THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY p ORDER BY ts, seq)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY p ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)"


@query("q_event_sessions", f'{SESSIONS} SELECT p AS "filePath", session, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM s GROUP BY p, session')
def _(spark, d):
    s = events.sessions(file_events(spark, d), GAP_S * 1000)
    return s.groupBy("filePath", "session").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


STEP = "CASE WHEN acc IS NULL THEN t WHEN acc = 'added' AND t = 'deleted' THEN NULL WHEN acc = 'added' AND t = 'modified' THEN 'added' WHEN acc = 'deleted' AND t IN ('added', 'modified') THEN 'modified' ELSE t END"
FOLDED = f"g AS (SELECT p, session, list(type ORDER BY seq) AS ts, max(seq) AS seq FROM s GROUP BY p, session), folded AS (WITH RECURSIVE r AS (SELECT p, session, ts, seq, 1 AS i, ts[1] AS acc FROM g UNION ALL SELECT p, session, ts, seq, i + 1, {STEP.replace('t WHEN', 'ts[i + 1] WHEN').replace('AND t ', 'AND ts[i + 1] ').replace('ELSE t END', 'ELSE ts[i + 1] END')} FROM r WHERE i < len(ts)) SELECT p, session, seq, acc, len(ts) AS n FROM r WHERE i = len(ts))"


@query("q_event_coalesce", f'{SESSIONS}, {FOLDED} SELECT p AS "filePath", session, seq, acc AS type, n AS events FROM folded WHERE acc IS NOT NULL')
def _(spark, d):
    return events.coalesce(file_events(spark, d), GAP_S * 1000).select("filePath", "session", "seq", "type", F.col("events").cast("long").alias("events"))


@query("q_backpressure", "WITH f AS (SELECT user_id, min(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 LIMIT 20), l AS (SELECT CASE WHEN count(*) >= 20 THEN max(seq) END AS m FROM f) SELECT event_id AS seq, m IS NULL OR event_id <= m AS accepted, CASE WHEN m IS NOT NULL AND event_id >= m THEN 'overflow' ELSE 'normal' END AS state FROM events, l")
def _(spark, d):
    return events.backpressure(file_events(spark, d), 40, 20).select("seq", "accepted", "state")


@query("q_queue_summary", "WITH f AS (SELECT user_id, min(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 LIMIT 10), l AS (SELECT CASE WHEN count(*) >= 10 THEN max(seq) END AS m FROM f) SELECT count(DISTINCT user_id) FILTER (m IS NULL OR event_id <= m) AS queued, count(*) FILTER (event_id > m) AS dropped, CASE WHEN bool_or(event_id >= m) THEN 'overflow' ELSE 'normal' END AS state FROM events, l")
def _(spark, d):
    return events.queue_summary(events.backpressure(file_events(spark, d), 20, 10))


# ---------------------------------------------------------------- dead letters


def entries(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("filePath"), F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("contentHash"),
        F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("errorMessage"), F.lit(3).alias("attempts"), (F.col("event_id") % 6).cast("int").alias("recoveryAttempts"), at.alias("createdAt"), at.alias("updatedAt"), F.lit(None).cast("timestamp").alias("lastRetryAt"),
    )


ENTRIES = "WITH e AS (SELECT 'e' || event_id AS id, CAST(user_id AS VARCHAR) AS p, 'h' || (event_id % 3) AS h, 'failed ' || event_id AS m, event_id % 6 AS a, ts, event_id, user_id FROM events WHERE event_type = 'error')"


def day(spark, d, days):
    return F.lit(table(spark, d, "events").agg((F.max("ts").cast("timestamp") - F.make_dt_interval(F.lit(days))).cast("string")).first()[0]).cast("timestamp")


@query("q_dlq_ttl", f"{ENTRIES} SELECT id FROM e WHERE NOT ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def _(spark, d):
    return entries(spark, d).where(~dead_letters.expired(day(spark, d, 0))).select("id")


@query("q_dlq_trim", f"{ENTRIES} SELECT id FROM e ORDER BY ts DESC, id DESC LIMIT 25")
def _(spark, d):
    return dead_letters.trim(entries(spark, d), 25).select("id")


@query("q_dlq_latest_error", f'{ENTRIES} SELECT p AS "filePath", arg_max(m, (ts, id)) AS "errorMessage" FROM e GROUP BY p')
def _(spark, d):
    return dead_letters.latest_errors(entries(spark, d)).select("filePath", "errorMessage")


SWEEP = f"{ENTRIES}, now AS (SELECT max(ts) - INTERVAL 5 DAY AS t FROM events), o AS (SELECT id, a, CASE WHEN ts < (SELECT t FROM now) - INTERVAL 24 HOUR THEN 'purged' WHEN user_id % 2 = 1 OR h <> 'h' || (user_id % 3) THEN 'purged' WHEN user_id % 5 <> 0 THEN 'retried' WHEN a + 1 >= 5 THEN 'abandoned' ELSE 'kept' END AS outcome FROM e)"


def swept(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    there = u.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("filePath"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("contentHash"))
    results = u.select(F.col("user_id").cast("string").alias("filePath"), (F.col("user_id") % 5 != 0).alias("ok"))
    return dead_letters.sweep(entries(spark, d), there, day(spark, d, 5), results)


@query("q_dlq_sweep", f"{SWEEP} SELECT id, outcome FROM o")
def _(spark, d):
    return swept(spark, d).select("id", "outcome")


@query("q_dlq_after_sweep", f'{SWEEP} SELECT id, CAST(a + 1 AS INTEGER) AS "recoveryAttempts" FROM o WHERE outcome = \'kept\'')
def _(spark, d):
    return dead_letters.after_sweep(swept(spark, d), day(spark, d, 5)).select("id", "recoveryAttempts")


@query("q_dlq_tallies", f"{SWEEP} SELECT count(*) FILTER (outcome = 'retried') AS retried, count(*) FILTER (outcome = 'purged') AS purged, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'abandoned') AS abandoned FROM o")
def _(spark, d):
    return dead_letters.tallies(swept(spark, d))


@query("q_completion_gate", "SELECT count(*) AS \"totalFiles\", 'incomplete' AS status, (SELECT count(*) FROM events WHERE event_type = 'error') || ' files failed to index' AS \"lastError\" FROM documents")
def _(spark, d):
    stats = files(spark, d).agg(F.count("*").alias("totalFiles"))
    return dead_letters.completion(entries(spark, d), stats).select("totalFiles", "status", "lastError")


@query("q_dlq_health", "SELECT event_type, count(*) AS n, CASE WHEN count(*) = 0 THEN 'healthy' WHEN count(*) < 100 THEN 'warning' ELSE 'critical' END AS health FROM events GROUP BY event_type")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", "n", dead_letters.health(F.col("n")).alias("health"))


# ---------------------------------------------------------------- metrics


def samples(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


DELTA = "WITH d AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"


@query("q_counter_delta", f"{DELTA} SELECT event_id, round(delta, 6) AS delta FROM d")
def _(spark, d):
    return metrics.counter_delta(samples(spark, d), ["event_type"], order=["event_id"]).select("event_id", F.round("delta", 6).alias("delta"))


@query("q_rate_by_type", f"{DELTA} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, round(sum(delta), 6) AS increase FROM d GROUP BY 1, 2")
def _(spark, d):
    deltas = metrics.counter_delta(samples(spark, d), ["event_type"], order=["event_id"])
    return metrics.increase(deltas, ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("increase", 6).alias("increase"))


BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
CUMULATIVE = "WITH c AS (SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative FROM events, (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + ", 'infinity'::DOUBLE]) AS le) GROUP BY event_type, le)"


@query("q_hist_buckets", f"{CUMULATIVE} SELECT event_type, CASE WHEN le = 'infinity' THEN '+Inf' ELSE CAST(CAST(le AS INTEGER) AS VARCHAR) END AS le, cumulative FROM c")
def _(spark, d):
    b = metrics.buckets(samples(spark, d), ["event_type"], BOUNDS)
    return b.select("event_type", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string")).alias("le"), "cumulative")


@query("q_hist_quantile", f"{CUMULATIVE}, w AS (SELECT *, coalesce(lag(cumulative) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0.0) AS low, max(cumulative) OVER (PARTITION BY event_type) * 0.95 AS rank FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS n FROM w WHERE cumulative >= rank AND cumulative > 0) SELECT event_type, round(CASE WHEN le = 'infinity' THEN low WHEN cumulative = below THEN low ELSE low + (le - low) * (rank - below) / (cumulative - below) END, 6) AS quantile FROM f WHERE n = 1")
def _(spark, d):
    q = metrics.histogram_quantile(metrics.buckets(samples(spark, d), ["event_type"], BOUNDS), ["event_type"], 0.95)
    return q.select("event_type", F.round("quantile", 6).alias("quantile"))


@query("q_state_onehot", "SELECT event_id, CAST(event_type = 'view' AS INTEGER) AS state_view, CAST(event_type = 'click' AS INTEGER) AS state_click, CAST(event_type = 'error' AS INTEGER) AS state_error FROM events")
def _(spark, d):
    return metrics.state_gauges(samples(spark, d), "event_type", ("view", "click", "error")).select("event_id", "state_view", "state_click", "state_error")


@query("q_avg_duration", "SELECT event_type, count(value) AS n, round(sum(value) / count(value), 6) AS average FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.average(samples(spark, d), ["event_type"]).select("event_type", "n", F.round("average", 6).alias("average"))


@query("q_error_rate", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 9) AS rate FROM events GROUP BY 1")
def _(spark, d):
    g = samples(spark, d).groupBy(F.window("ts", "1 day")["start"].alias("start")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return g.select(F.col("start").cast("timestamp_ntz").alias("start"), "errors", F.round(F.col("errors") / F.col("n"), 9).alias("rate"))


@query("q_gauge_last", "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.last_value(samples(spark, d), ["event_type"], tie="event_id")


@query("q_tool_calls_by_role", "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"), F.count_distinct("conv_id").alias("conversations"))


@query("q_metrics_exposition", "SELECT 'calls_total' AS name, '# HELP calls_total Calls' || chr(10) || '# TYPE calls_total counter' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT 'calls_total{role=\"' || role || '\"} ' || count(*) AS line FROM conversations GROUP BY role)")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("role").agg(F.count("*").cast("double").alias("value"))
    return metrics.exposition(g.select(F.lit("calls_total").alias("name"), F.lit("Calls").alias("help"), F.lit("counter").alias("type"), F.create_map(F.lit("role"), "role").alias("labels"), F.lit(None).cast("string").alias("metricName"), "value"))


@query("q_index_stats", f"{CHUNKS} SELECT 'primary' AS id, count(DISTINCT \"filePath\") AS \"totalFiles\", count(*) AS \"totalChunks\" FROM chunks")
def _(spark, d):
    c = chunking.line_windows(files(spark, d))
    return c.agg(F.count_distinct("filePath").alias("totalFiles"), F.count("*").alias("totalChunks")).select(F.lit("primary").alias("id"), "totalFiles", "totalChunks")
