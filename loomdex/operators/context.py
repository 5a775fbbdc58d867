"""Line ranges around results: context, previews, snippets and merged line counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions import text

CONTEXT_LINES, MAX_CONTEXT, PREVIEW = 3, 20, 20


def resolve(total: Column, start: Column | None, end: Column | None) -> tuple[Column, Column]:
    s = F.lit(1) if start is None else text.clamp(start, F.lit(1), total)
    e = total if end is None else text.clamp(end, F.lit(1), total)
    return s.cast("int"), e.cast("int")


def preview_range(total: Column, start: int | None, end: int | None) -> tuple[Column, Column]:
    """Both bounds: that range; one bound: PREVIEW lines from or up to it; none: the first PREVIEW lines."""
    if start is not None and end is not None:
        return resolve(total, F.lit(start), F.lit(end))
    if start is not None:
        s = text.clamp(F.lit(start), F.lit(1), total)
        return s, F.least(s + PREVIEW - 1, total)
    if end is not None:
        e = text.clamp(F.lit(end), F.lit(1), total)
        return F.greatest(F.lit(1), e - PREVIEW + 1), e
    return F.lit(1), F.least(F.lit(PREVIEW), total)


def get_context(files: DataFrame, start: int | None = None, end: int | None = None, deferred: bool = False) -> DataFrame:
    """(filePath, totalLines, startLine, endLine, content); ranges are clamped to the file, and empty ones give no row."""
    rows = files.select("filePath", text.lines(F.col("content")).alias("lines")).withColumn("totalLines", F.size("lines"))
    total = F.col("totalLines")
    s, e = preview_range(total, start, end) if deferred else resolve(total, None if start is None else F.lit(start), None if end is None else F.lit(end))
    rows = rows.withColumn("startLine", s).withColumn("endLine", e).where("startLine <= endLine")
    return rows.select("filePath", "totalLines", "startLine", "endLine", F.array_join(F.slice("lines", F.col("startLine"), F.col("endLine") - F.col("startLine") + 1), "\n").alias("content"))


def snippets(results: DataFrame, files: DataFrame, context: int = CONTEXT_LINES) -> DataFrame:
    """Adds snippet and its line range to results (filePath, startLine, endLine ...); without the file they are null."""
    context = max(0, min(context, MAX_CONTEXT))
    # Results are a top-k: only their files are split into lines.
    contents = files.select(F.col("filePath").alias("f_path"), F.col("content").alias("f_content"))
    joined = results.join(contents, F.col("filePath") == F.col("f_path"), "left").withColumn("f_lines", text.lines(F.col("f_content"))).drop("f_content")
    n = F.size("f_lines")
    s, e = F.greatest(F.lit(1), F.col("startLine") - context), F.least(n, F.col("endLine") + context)
    known = F.col("f_lines").isNotNull()
    joined = joined.withColumn("snippetStartLine", F.when(known, s)).withColumn("snippetEndLine", F.when(known, e))
    cut = F.slice("f_lines", F.col("snippetStartLine"), F.greatest(F.col("snippetEndLine") - F.col("snippetStartLine") + 1, F.lit(0)))
    return joined.withColumn("snippet", F.array_join(cut, "\n")).drop("f_path", "f_lines")


def merged_lines(ranges: DataFrame, path: str = "filePath", start: str = "startLine", end: str = "endLine") -> DataFrame:
    """(path, islands, lines): ranges that overlap or touch are one; how many there are and how many lines they hold."""
    w = Window.partitionBy(path).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w))
    islands = flagged.groupBy(path, "__island").agg((F.max(end) - F.min(start) + 1).alias("__n"))
    return islands.groupBy(path).agg(F.count("*").alias("islands"), F.sum("__n").cast("long").alias("lines"))
