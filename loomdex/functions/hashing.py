"""Content hashes: 64-bit xxHash with seed 0 as 16 hex digits, of text, bytes, and large files in part."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files above this size are hashed in part: head and tail of PART bytes, and the size.
LARGE, PART = 2 << 20, 1 << 20


@F.pandas_udf(T.StringType())
def _xxh64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import xxhash

    for s in batches:
        yield s.map(lambda b: None if b is None else xxhash.xxh64(bytes(b)).hexdigest())


def _jvm_xxh64(value: Column) -> Column | None:
    """Catalyst's own xxHash with seed 0 (F.xxhash64 has 42), in generated code; None where this session has no JVM at hand."""
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None or not hasattr(value, "_jc"):
        return None
    try:
        sql = context._jvm.org.apache.spark.sql
        helper = sql.classic.ExpressionUtils
        inside = context._jvm.PythonUtils.toSeq([helper.expression(value._jc)])
        made = helper.column(sql.catalyst.expressions.XxHash64(inside, 0))
    except (AttributeError, TypeError, Py4JError):
        return None
    return type(value)(made)


def content_hash(value: Column) -> Column:
    """Of a string's UTF-8 bytes or of a binary; null for null."""
    data = value.cast("binary")
    made = _jvm_xxh64(data)
    if made is None:
        return _xxh64(data)
    return F.when(data.isNotNull(), F.lpad(F.lower(F.hex(made)), 16, "0"))


def partial_hash(content: Column) -> Column:
    """Of the whole content up to LARGE bytes; above, of head, tail and the size in digits."""
    size = F.octet_length(content)
    ends = F.concat(F.substring(content, 1, PART), F.substring(content, F.greatest(size - PART + 1, F.lit(1)), F.lit(PART)), size.cast("string").cast("binary"))
    return content_hash(F.when(size > LARGE, ends).otherwise(content))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)
