"""Frequent entries of a count table without a per-task top list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the histogram for each doubling of the count.
STEPS = 16


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the largest counts, as many whole histogram steps as fit into ``most`` rows.

    Only the histogram, some hundred rows whatever the table's size, comes to the driver;
    what is collected afterwards is bounded by ``most``.
    """
    step = F.floor(F.log2(F.col(n)) * STEPS).cast("int")
    total, cut = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += row["rows"]
        if total > most:
            break
        cut = row["step"]
    return counts.where(F.lit(False) if cut is None else step >= cut)
