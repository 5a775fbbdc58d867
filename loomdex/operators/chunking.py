"""Chunks: overlapping line windows in expressions, and declarations or over-long chunks in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text

SIZE, OVERLAP, MAX_CHARS = 50, 10, 6000
CHUNK = "id string, filePath string, content string, language string, symbolName string, symbolKind string, startLine int, endLine int"


def explode_lines(files: DataFrame) -> DataFrame:
    """(filePath, language, lineNumber from 1, lineText)."""
    rows = files.select("filePath", "language", F.posexplode(text.lines_closed(F.col("content"))).alias("pos", "lineText"))
    return rows.select("filePath", "language", (F.col("pos") + 1).alias("lineNumber"), "lineText")


def line_windows(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` lines, each starting ``size - overlap`` after the last one, until one meets the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    step = size - overlap
    lines = files.select("filePath", "language", text.lines_closed(F.col("content")).alias("lines")).where(F.size("lines") > 0)
    n = F.size("lines")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    each = lines.withColumn("w", F.explode(F.sequence(F.lit(0), count - 1)))
    start, end = F.col("w") * step + 1, F.least(F.col("w") * step + size, n)
    out = each.withColumn("startLine", start).withColumn("endLine", end)
    return out.select(
        F.format_string("%s:%d-%d:file-%d", "filePath", "startLine", "endLine", F.col("w") + 1).alias("id"), "filePath",
        F.array_join(F.slice("lines", F.col("startLine"), F.col("endLine") - F.col("startLine") + 1), "\n").alias("content"), "language",
        F.lit(None).cast("string").alias("symbolName"), F.lit("file").alias("symbolKind"), "startLine", "endLine",
    )


def _units(s: str) -> int:
    return len(s) + sum(1 for c in s if c > "\uffff")


def _cut(line: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` UTF-16 units; a pair of surrogates stays whole unless the limit is 1."""
    out, now, size = [], [], 0
    for c in line:
        n = 2 if c > "\uffff" else 1
        if now and size + n > limit:
            out.append("".join(now))
            now, size = [], 0
        now.append(c)
        size += n
    return [*out, "".join(now)]


def split_long(content: str, start: int, limit: int) -> list[tuple[str, int, int]]:
    """(part, first line, last line): whole lines packed up to ``limit`` units; a longer line is cut and its pieces share its number."""
    if limit <= 0 or _units(content) <= limit:
        return [(content, start, start + content.count("\n"))]
    parts: list[tuple[str, int, int]] = []
    held: list[str] = []
    size = 0
    first = number = start

    def flush() -> None:
        nonlocal held, size
        if held:
            parts.append(("\n".join(held), first, first + len(held) - 1))
        held, size = [], 0

    for number, line in enumerate(content.split("\n"), start):
        n = _units(line)
        if n > limit:
            flush()
            parts.extend((piece, number, number) for piece in _cut(line, limit))
            continue
        if held and size + 1 + n > limit:
            flush()
        if not held:
            first = number
        size += n + (1 if held else 0)
        held.append(line)
    flush()
    return parts


def split_max_chars(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Chunks longer than ``limit`` in parts named ``{name}-part{k}``; ``limit`` 0 means no limit. Only long ones go through Python."""
    columns = ["id", "filePath", "content", "language", "symbolName", "symbolKind", "startLine", "endLine"]
    if limit <= 0:
        return chunks.select(*columns)
    long = text.utf16_length(F.col("content")) > limit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = r["symbolName"] or r["id"].rsplit(":", 1)[-1]
                for k, (content, a, b) in enumerate(split_long(r["content"], r["startLine"], limit), 1):
                    rows.append(r | {"id": f"{r['filePath']}:{a}-{b}:{base}-part{k}", "content": content, "startLine": a, "endLine": b})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    short = chunks.where(~long).select(*columns)
    return short.unionByName(chunks.where(long).select(*columns).mapInArrow(run, CHUNK))


def declarations(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """(filePath, language, type, name, startLine, endLine, content) from each language's parser; a failing parser gives none."""
    from loomdex import schemas
    from loomdex.operators.parsers import PARSERS

    use = PARSERS | (parsers or {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["filePath", "language", "type", "name", "startLine", "endLine", "content"]
        kinds = pa.schema([(n, pa.int32() if n.endswith("Line") else pa.string()) for n in names])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parse = use.get(r["language"])
                try:
                    found = parse(r["content"]) if parse and r["content"] else []
                except Exception:  # noqa: BLE001 - a parser's failure means line windows, whatever it is
                    found = []
                rows += [{"filePath": r["filePath"], "language": r["language"], "type": d.kind, "name": d.name, "startLine": d.start, "endLine": d.end, "content": d.content} for d in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("filePath", "language", "content").mapInArrow(run, schemas.DECLARATIONS)


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, max_chars: int = MAX_CHARS, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Declarations where a parser finds any, line windows otherwise; then over-long ones are split."""
    found = declarations(files, parsers)
    structured = found.select(
        F.format_string("%s:%d-%d:%s", "filePath", "startLine", "endLine", "name").alias("id"), "filePath", "content", "language", F.col("name").alias("symbolName"), F.col("type").alias("symbolKind"), "startLine", "endLine"
    )
    plain = files.join(found.select("filePath").distinct(), "filePath", "left_anti")
    return split_max_chars(structured.unionByName(line_windows(plain, size, overlap)), max_chars)
