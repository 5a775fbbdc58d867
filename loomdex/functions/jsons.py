"""JSON at the engine's edges: stored vectors, line matches of a search program, and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH = "type string, data struct<path:struct<text:string>,line_number:int,lines:struct<text:string>,submatches:array<struct<start:int,end:int,match:struct<text:string>>>>"


def vector_json(vector: Column) -> Column:
    return F.to_json(vector)


def parse_vectors(rows: DataFrame, text: str = "json", into: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors, rows whose text is no JSON array of numbers): corrupt rows are set apart, not errors."""
    parsed = rows.withColumn(into, F.from_json(text, "array<double>"))
    good = F.col(into).isNotNull() & ~F.exists(into, lambda x: x.isNull())
    return parsed.where(F.coalesce(good, F.lit(False))), parsed.where(~F.coalesce(good, F.lit(False))).drop(into)


def parse_matches(lines: DataFrame, text: str = "value") -> DataFrame:
    """(filePath, lineNumber, lineText, submatches) of a search program's JSON lines: matches only, unreadable lines go."""
    m = lines.select(F.from_json(text, MATCH).alias("m")).where("m.type = 'match' and m.data.path.text is not null and m.data.line_number is not null")
    d = F.col("m.data")
    subs = F.transform(d["submatches"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"]["text"].alias("match")))
    return m.select(
        F.regexp_replace(d["path"]["text"], r"^\./", "").alias("filePath"), d["line_number"].alias("lineNumber"), F.regexp_replace(d["lines"]["text"], r"\r?\n$", "").alias("lineText"),
        F.coalesce(subs, F.array().cast("array<struct<start:int,end:int,match:string>>")).alias("submatches"),
    )


def result_json(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object; long numbers are strings, as clients without 64-bit numbers need them."""
    columns = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.LongType) else F.col(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
