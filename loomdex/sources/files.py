"""Files of a folder, line ranges, and tables read as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import globs, text

#: Files above this many bytes are listed as skipped and not chunked.
MAX_FILE_BYTES = 1 << 20


def scan(spark: SparkSession, root: str, ignore: Iterable[str] = (), max_bytes: int | None = None) -> DataFrame:
    """(filePath, size, modified, content binary) of every file under root that no ignore pattern hides.

    With max_bytes larger files are left out; ``oversized`` lists them.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The size filter is on the reader's own column, so it is pushed down and contents beyond it are not read.
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    start = F.length(F.lit(base))
    named = raw.select(F.substring(path, F.instr(path, base) + start, F.length(path)).alias("filePath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return named.where(~globs.ignored(F.col("filePath"), globs.ignore_list(ignore)))


def oversized(spark: SparkSession, root: str, ignore: Iterable[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(filePath, size) of files above max_bytes; their contents are not read."""
    return scan(spark, root, ignore).where(F.col("size") > max_bytes).select("filePath", "size")


def scan_events(files: DataFrame) -> DataFrame:
    """One ``added`` event for each file, with the content's hash."""
    from loomdex.functions.hashing import content_hash

    return files.select(F.lit("added").alias("type"), "filePath", content_hash(F.col("content")).alias("contentHash"), F.current_timestamp().alias("detectedAt"))


def load(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(filePath, language, content, skipped): decoded text; larger files keep no content."""
    too_large = F.octet_length("content") > max_bytes
    return files.select("filePath", text.parser_language(F.col("filePath")).alias("language"), F.when(~too_large, F.decode("content", "UTF-8")).alias("content"), too_large.alias("skipped"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """(filePath, language, content) of a documents table: source/lang/id.txt."""
    return docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("filePath"), F.col("lang").alias("language"), F.col("text").alias("content"))


def read_range(content: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Lines start to end, both included and clamped to the text; null where start lies behind end."""
    parts = text.lines(content)
    n = F.size(parts)
    s = F.lit(1) if start is None else text.clamp(start, F.lit(1), n)
    e = n if end is None else text.clamp(end, F.lit(1), n)
    return F.when(s <= e, F.array_join(F.slice(parts, s, F.greatest(e - s + 1, F.lit(0))), "\n"))
