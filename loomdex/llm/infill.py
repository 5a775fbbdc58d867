"""Fill-in-middle: texts cut at two random unit borders and reordered, in memory that does not grow with units.

Units are a word with the white space before it, or white space at a text's end. A first
pass over a text only counts them. Hashes of the key then give two ranks, and a second pass
advances a lazy iterator of matches to the smaller rank and on to the larger; all that is
kept are two offsets. No list of units or offsets is ever made.

Defined cases: a null text is empty; an empty text, or one that holds a sentinel, stays
plain, so that what is cut can be restored without doubt. A null key is hashed as empty.
Very long texts are matched whole. Repeated rows come out alike. Only the named key and
text are read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.llm._words import column, slices

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: The sentinels of prefix, suffix and middle, and the seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, how many are cut, and how many of those get the suffix first.
CUT, SUFFIX_FIRST = 50, 80


@dataclass(frozen=True)
class Rates:
    seed: int = SEED
    cut: int = CUT
    suffix_first: int = SUFFIX_FIRST


def count(text: str) -> int:
    """How many units a text has."""
    return sum(1 for _ in UNIT.finditer(text))


def borders(text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` units of a text end; one pass that stops at the larger rank."""
    units = UNIT.finditer(text)
    a = next(islice(units, low - 1, None)).end() if low else 0
    b = next(islice(units, high - low - 1, None)).end() if high > low else a
    return a, b


def cut(key: object, text: str, rates: Rates = Rates()) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, characters of the prefix, characters of the middle)."""
    n = count(text)
    digest = hashlib.sha256(f"{rates.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= rates.cut or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = borders(text, low, high)
    first, middle, last = text[:a], text[a:b], text[b:]
    if h4 % 100 < rates.suffix_first:
        return n, "spm", f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}", len(first), len(middle)
    return n, "psm", f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}", len(first), len(middle)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rates: Rates = Rates()) -> DataFrame:
    """(key, n, form, output, prefix_chars, middle_chars) of every text; form is plain, psm or spm."""
    schema = StructType([*docs.select(key).schema.fields, *docs.sparkSession.createDataFrame([], "n long, form string, output string, prefix_chars long, middle_chars long").schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            keys, texts = column(part, key), column(part, text)
            made = (cut(k.as_py(), t.as_py() or "", rates) for k, t in zip(keys, texts))
            n, form, output, first, middle = zip(*made)
            values = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64())]
            yield pa.RecordBatch.from_arrays([keys, *values], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from."""
    # A cut text holds no sentinel, and none can begin within another, so the first ones found are those put in.
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "<[PSM]>", 3)
    one, two, middle = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
