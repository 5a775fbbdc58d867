"""Semantic, line and hybrid search: lazy plans whose last step is a top-k."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions import globs, text, vectors

TOP_K, MAX_RESULTS, RRF_K, OVERSAMPLE = 20, 100, 60, 5
CHUNK = ("id", "filePath", "content", "language", "symbolName", "symbolKind", "startLine", "endLine")


def chunk_filter(language: str | None = None, symbol_kind: str | None = None, prefix: str | None = None, paths: Sequence[str] | None = None) -> Column:
    """The conjunction of the filters that are given, applied before any score is computed."""
    out = F.lit(True)
    if language is not None:
        out = out & (F.col("language") == language)
    if symbol_kind is not None:
        out = out & (F.col("symbolKind") == symbol_kind)
    if prefix is not None:
        out = out & F.col("filePath").startswith(prefix)
    if paths is not None:
        out = out & F.col("filePath").isin(list(paths))
    return out


def knn(rows: DataFrame, query: Sequence[float], k: int, vector: str = "vector", ties: Sequence[str] = ("filePath", "id"), arrow: bool = False) -> DataFrame:
    """The k rows of largest cosine similarity, exact; ties by the given columns."""
    vectors.check_top_k(k)
    score = vectors.cosine_arrow(query)(vectors.doubles(F.col(vector))) if arrow else vectors.cosine(F.col(vector), query)
    return rows.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(k)


def semantic_search(chunks: DataFrame, query: str, top_k: int = TOP_K, patterns: Iterable[str] | None = None, language: str | None = None, oversample: bool = False, embed=vectors.embed_query, dimensions: int | None = None) -> DataFrame:
    """Chunks by similarity to a query, with score and source.

    Path patterns are applied before the top-k, so k results come back if there are so
    many. With ``oversample`` they are applied to the best ``OVERSAMPLE * k`` instead. A
    query vector of another length than ``dimensions`` is an error.
    """
    given = list(patterns or [])
    match = globs.glob_filter(F.col("filePath"), given)
    rows = chunks.where(chunk_filter(language))
    q = embed(query)
    vectors.check_query(q, dimensions)
    if given and oversample:
        found = knn(rows, q, top_k * OVERSAMPLE).where(match).orderBy(F.desc("score"), "filePath", "id").limit(top_k)
    else:
        found = knn(rows.where(match), q, top_k)
    return found.withColumn("source", F.lit("semantic"))


def grep(lines: DataFrame, pattern: str, patterns: Iterable[str] | None = None, case_sensitive: bool = False, max_results: int = MAX_RESULTS, fixed: bool = False) -> DataFrame:
    """Lines that match a regular expression, or hold a literal with ``fixed``; the first by path and number."""
    if fixed:
        hit = F.col("lineText").contains(pattern) if case_sensitive else F.lower("lineText").contains(pattern.lower())
    else:
        hit = F.col("lineText").rlike(pattern if case_sensitive else f"(?i){pattern}")
    found = lines.where(globs.glob_filter(F.col("filePath"), patterns) & hit)
    return found.orderBy("filePath", "lineNumber").limit(max_results)


def submatches(matches: DataFrame, pattern: str, case_sensitive: bool = False, fixed: bool = False) -> DataFrame:
    """Adds submatches (start, end, match) with UTF-8 byte offsets, left to right without overlap."""
    compiled = re.compile(re.escape(pattern) if fixed else pattern, 0 if case_sensitive else re.IGNORECASE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))
        for batch in batches:
            out = []
            for line in batch.column(batch.schema.get_field_index("lineText")).to_pylist():
                size = (lambda i, s=line: i) if line.isascii() else (lambda i, s=line: len(s[:i].encode()))
                out.append([{"start": size(m.start()), "end": size(m.end()), "match": m[0]} for m in compiled.finditer(line) if m[0]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "submatches"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema) + ", submatches array<struct<start:int,end:int,match:string>>"
    return matches.mapInArrow(run, schema)


def positioned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds pos, the place in a leg from 0. A leg holds at most its top-k rows."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)) - 1)


def lines_to_chunks(matches: DataFrame, semantic: DataFrame) -> DataFrame:
    """Each line match as the best-placed semantic chunk that holds it, else as a chunk of its own line.

    Both sides are results of a top-k, so either is small; the join has the path as key
    and the line range as condition.
    """
    s = semantic.select(F.col("filePath").alias("s_path"), F.col("startLine").alias("s_start"), F.col("endLine").alias("s_end"), F.col("pos").alias("s_pos"), F.struct(*CHUNK).alias("s_chunk"))
    on = (F.col("filePath") == F.col("s_path")) & F.col("lineNumber").between(F.col("s_start"), F.col("s_end"))
    number = F.col("lineNumber").cast("string")
    own = F.struct(
        F.concat_ws(":", "filePath", number).alias("id"), F.col("filePath"), F.col("lineText").alias("content"), text.extension_language(F.col("filePath")).alias("language"),
        F.concat(F.lit("line_"), number).alias("symbolName"), F.lit("unknown").alias("symbolKind"), F.col("lineNumber").alias("startLine"), F.col("lineNumber").alias("endLine"),
    )
    joined = matches.join(s, on, "left").groupBy("filePath", "lineNumber", "lineText", "pos").agg(F.min_by("s_chunk", "s_pos").alias("s_chunk"))
    return joined.select(F.coalesce("s_chunk", own).alias("chunk"), F.lit(1.0).alias("score"), F.lit("grep").alias("source"), "pos")


def fuse(legs: DataFrame, top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (chunk, source, leg, pos): one row per chunk id with summed 1 / (k + pos + 1).

    An id with two contributions or more is ``hybrid``, also when one leg gave both; the
    first payload stays; ties go by path in the order of a locale (``a`` before ``B``),
    then by first appearance.
    """
    order, by_path = F.struct("leg", "pos"), F.collate(F.col("chunk.filePath"), "UNICODE")
    by_id = legs.groupBy(F.col("chunk.id").alias("id")).agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("pos") + 1)), 12).alias("score"),
        F.count("*").alias("hits"),
        F.min_by("chunk", order).alias("chunk"),
        F.min_by("source", order).alias("first_source"),
        F.min(order).alias("seen"),
    )
    best = by_id.orderBy(F.desc("score"), by_path, "seen").limit(top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), by_path, "seen")))
    return ranked.select("rank", "chunk", "score", F.when(F.col("hits") > 1, F.lit("hybrid")).otherwise(F.col("first_source")).alias("source"))


#: What the legs of a hybrid search are.
SEMANTIC_LEG = "id string, filePath string, content string, language string, symbolName string, symbolKind string, startLine int, endLine int, score double, source string"
GREP_LEG = "filePath string, lineNumber int, lineText string"


def fuse_legs(near: DataFrame, lines: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Chunks found by similarity and lines found by pattern, aligned and fused."""
    semantic = positioned(near, F.desc("score"), "filePath", "id")
    aligned = lines_to_chunks(positioned(lines, "filePath", "lineNumber"), semantic)
    left = semantic.select(F.struct(*CHUNK).alias("chunk"), "source", F.lit(0).alias("leg"), "pos")
    return fuse(left.unionByName(aligned.select("chunk", "source", F.lit(1).alias("leg"), "pos")), top_k)


def hybrid_search(chunks: DataFrame, lines: DataFrame, query: str, grep_pattern: str | None = None, top_k: int = TOP_K, patterns: Iterable[str] | None = None, language: str | None = None, fixed: bool = True, embed=vectors.embed_query) -> DataFrame:
    """Semantic and line search, aligned and fused. language filters the semantic leg only."""
    near = semantic_search(chunks, query, top_k, patterns, language, embed=embed)
    return fuse_legs(near, grep(lines, grep_pattern or query, patterns, max_results=top_k, fixed=fixed), top_k)


def rest_rows(chunks: DataFrame, query: str, embed=vectors.embed_query, top_k: int = TOP_K) -> DataFrame:
    """(rank, file, content) of the nearest chunks, as the search over given files answers."""
    found = positioned(semantic_search(chunks, query, top_k, embed=embed), F.desc("score"), "filePath", "id")
    return found.select((F.col("pos") + 1).alias("rank"), F.col("filePath").alias("file"), "content")
