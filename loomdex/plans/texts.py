"""Checks, classes and formats of values, over the texts, pages and links of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import globs, limits, text
from loomdex.plans.catalog import CODE_SQL, query, table

MESSAGE = "CASE WHEN contains(url, '/fr/') THEN 'fetch failed ' || url WHEN contains(url, '/en/') THEN 'ENOENT: no such file ' || regexp_replace(url, '^https?://', '/var/') WHEN contains(url, '/de/') THEN 'storage is full: ' || substr(html, 1, 80) ELSE 'at ' || regexp_replace(url, '^https?://', '/home/') || ': ' || substr(html, 1, 80) END"


@query("q_error_messages", f"WITH e AS (SELECT page_id, {MESSAGE} AS m FROM pages) SELECT page_id, {CODE_SQL} AS code, CASE WHEN regexp_matches(m, '(?i)/(home|users|tmp|var|etc|opt)/|[a-z]:\\\\|\\.\\./') AND NOT regexp_matches(m, '(?i)fetch failed|econnrefused|econnreset|etimedout|https?://') THEN '{text.REDACTED}' ELSE m END AS message FROM e")
def _(spark, d):
    url, start = F.col("url"), F.substring("html", 1, 80)
    bare = lambda root: F.regexp_replace("url", "^https?://", root)
    m = F.when(url.contains("/fr/"), F.concat(F.lit("fetch failed "), url)).when(url.contains("/en/"), F.concat(F.lit("ENOENT: no such file "), bare("/var/"))).when(url.contains("/de/"), F.concat(F.lit("storage is full: "), start)).otherwise(F.concat(F.lit("at "), bare("/home/"), F.lit(": "), start))
    e = table(spark, d, "pages").select("page_id", m.alias("m"))
    return e.select("page_id", text.error_code(F.col("m")).alias("code"), text.redact(F.col("m")).alias("message"))


@query("q_links_inside", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages), p AS (SELECT page_id, unnest([link, substr(link, 2), '..' || link, substr(link, 2) || '/..' || link, substr(link, 2) || '..']) AS path FROM l) SELECT page_id, path FROM p WHERE NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..')")
def _(spark, d):
    """The paths of all pages' links, as they are and in other forms, that stay inside a root."""
    link = F.col("link")
    bare = F.expr("substring(link, 2)")
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    forms = F.array(link, bare, F.concat(F.lit(".."), link), F.concat(bare, F.lit("/.."), link), F.concat(bare, F.lit("..")))
    return links.select("page_id", F.explode(forms).alias("path")).where(globs.inside(F.col("path")))


@query("q_text_values", "WITH v AS (SELECT doc_id, unnest([text, string_split(text, chr(10))[1], chr(9) || source]) AS v FROM documents) SELECT doc_id, v AS value, regexp_full_match(v, '[\\p{L}\\p{N}\\p{P}\\p{Zs}\\p{S}\\p{M}]*') AS valid FROM v")
def _(spark, d):
    """Whether texts, their first lines and values with a tab could be filter values."""
    made = F.array("text", F.split("text", "\n", -1)[0], F.concat(F.lit("\t"), "source"))
    return table(spark, d, "documents").select("doc_id", F.explode(made).alias("value")).select("doc_id", "value", globs.valid_filter_value(F.col("value")).alias("valid"))


@query("q_length_durations", "SELECT doc_id, CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) || 'ms' ELSE format('{:.1f}', v / 1000.0) || 's' END AS shown FROM (SELECT doc_id, length(text) // 100 * 100 AS v FROM documents)")
def _(spark, d):
    """Texts' lengths, in hundreds, as milliseconds."""
    ms = (F.floor(F.length("text") / 100) * 100).cast("long")
    return table(spark, d, "documents").select("doc_id", text.duration(ms).alias("shown"))


@query("q_text_bodies", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'not JSON' WHEN lang = 'es' OR trim(text) = '' THEN 'no query' WHEN length(text) > 10000 THEN 'query too long' WHEN lang = 'de' THEN 'no files' END AS error FROM documents WHERE text IS NOT NULL AND lang IN ('en', 'de', 'fr', 'es')")
def _(spark, d):
    """Texts as search requests: as a query with files, without files, as they are, or with a blank query."""
    docs = table(spark, d, "documents").where("text is not null and lang in ('en', 'de', 'fr', 'es')")
    asked = F.struct(F.col("text").alias("query"), F.array("source").alias("files"))
    body = F.when(F.col("lang") == "fr", F.concat(F.lit("- "), "text")).when(F.col("lang") == "es", F.to_json(F.struct(F.lit("  ").alias("query"), F.array("text").alias("files")))).when(F.col("lang") == "de", F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.to_json(asked))
    return docs.select("doc_id", limits.body_error(body).alias("error"))
