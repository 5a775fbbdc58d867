"""Mixing sources to target weights by systematic sampling.

Within each source, documents stand in order of size. Each one's expected copies (its
source's target over its source's size) are summed up along that order from one random
offset, and a document is emitted once for every whole number its step passes. Documents
of like size share the rounding, so a source's total stays near its target, and no
document is emitted more often than ``most`` times. The offset is the best of ``draws``
seeded ones: that whose total comes nearest the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; a source of total size 0 has target 0 and is not taken; equal rows are ranked
among themselves in any order (they are interchangeable); an empty table gives an empty
result. Helper columns carry a prefix of their own, so columns of the input cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm._store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def identity(key: str, source: str, text: str) -> F.Column:
    """A 64-bit identity of a row's key, source and text."""
    parts = [F.col(key), F.col(source), F.col(text)]
    return F.xxhash64(*parts, *(p.isNull() for p in parts))


def targets(sizes: DataFrame, source: str, size: str, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """Adds each source's target to (source, size): weights repeat in code-point order (null last) and share the whole.

    A target stops at ``most`` times its source's size; the excess goes to the others by
    weight. The level at which that ends is found in one pass over the sources in order of
    the share at which they fill up; the table has one row for each source.
    """
    whole = Window.partitionBy()
    filling = Window.partitionBy().orderBy("__full", "__rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    capped = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("__rank", F.row_number().over(Window.partitionBy().orderBy(F.col(source).asc_nulls_last())) - 1)
        .withColumn("__w", w)
        .withColumn("__full", most * F.col(size) / F.col("__w"))
        .withColumn("__total", F.sum(size).over(whole))
        .withColumn("__before", F.coalesce(F.sum(most * F.col(size)).over(capped), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(rest))
        .withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__left"))
        # Sources fill up in order while their cap lies under the level that the rest would share.
        .withColumn("__caps", F.col("__full") < F.col("__level"))
        .withColumn("__end", F.min(F.when(~F.col("__caps"), F.struct("__full", "__rank", "__level"))).over(whole)["__level"])
        .withColumn("target", F.when(F.col("__caps") | F.col("__end").isNull(), (most * F.col(size)).cast("double")).otherwise(F.col("__w") * F.col("__end")))
        .drop("__rank", "__w", "__full", "__total", "__before", "__left", "__level", "__caps", "__end")
    )


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: F.Column | None = None, weights: tuple = WEIGHTS, most: int = 3, seed: int = 17, draws: int = 32) -> DataFrame:
    """(key, source, __id, size, source_size, target, copies): how often the mix takes each document."""
    size = word_count(text) if size is None else size
    slim = docs.select(F.col(key).alias("__key"), F.col(source).alias("__source"), identity(key, source, text).alias("__id"), size.alias("__size"))
    # One range sort over (source, size); rows are numbered in each part, and parts are offset by their counts.
    order = ["__source", "__size", "__shuffled", "__key", "__id"]
    shuffled = F.xxhash64(F.col("__key"), F.lit(seed))
    ranged = slim.withColumn("__shuffled", shuffled).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    parts = ranged.groupBy("__source", "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"), F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    sums = parts.groupBy("__source").agg(F.sum("__sum").alias("source_size"))
    goals = targets(sums, "__source", "source_size", weights, most)
    goals = goals.withColumn("__step", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    plan = parts.alias("p").join(goals.alias("g"), F.col("p.__source").eqNullSafe(F.col("g.__source")))
    plan = plan.select("p.__source", "p.__part", "p.__first", "p.__ahead", "g.source_size", "g.target", "g.__step")
    on = (F.col("d.__part") == F.col("q.__part")) & F.col("d.__source").eqNullSafe(F.col("q.__source"))
    placed = ranged.alias("d").join(plan.alias("q"), on).select("d.*", "source_size", "target", "__step", (F.col("__ahead") + F.col("__row") - F.col("__first")).cast("double").alias("__place"))

    def offset(j: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(j), F.col("__source")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def passed(start: F.Column) -> F.Column:
        # Neighbours share the boundary between them, so what is lost or gained by rounding never adds up.
        n = F.floor((F.col("__place") + 1) * F.col("__step") + start) - F.floor(F.col("__place") * F.col("__step") + start)
        return F.least(n, F.lit(most)).cast("long")

    # Of a few seeded offsets each source takes the one whose total comes nearest its target.
    totals = [F.struct(F.abs(F.sum(passed(offset(j)) * F.col("__size")) - F.first("target")).alias("miss"), F.lit(j).alias("j"), F.first(offset(j)).alias("start")) for j in range(draws)]
    chosen = placed.groupBy("__source").agg((F.least(*totals) if draws > 1 else totals[0])["start"].alias("__start"))
    final = placed.alias("p").join(chosen.alias("s"), F.col("p.__source").eqNullSafe(F.col("s.__source")))
    return final.select(
        F.col("__key").alias(key), F.col("p.__source").alias(source), "__id", F.col("__size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", passed(F.col("__start")).alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the mix takes it (not at all for 0 copies).

    Rows that agree in key, source and text share their copies evenly.
    """
    taken = copies(docs, key, source, text, **options)
    counted = taken.where("copies > 0").groupBy("__id").agg(F.sum("copies").alias("__copies"))
    joined = docs.withColumn("__id", identity(key, source, text)).join(counted, "__id")
    # Of n equal rows with c copies in all, each gives c / n, and the first c % n one more.
    same = Window.partitionBy("__id")
    each = joined.withColumn("__rows", F.count("*").over(same)).withColumn("__i", F.row_number().over(same.orderBy("__id")) - 1)
    each = each.withColumn("__copies", F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__i") < F.col("__copies") % F.col("__rows"), 1).otherwise(0)).where("__copies > 0")
    return each.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
