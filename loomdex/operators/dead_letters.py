"""The dead-letter table: one entry a file, time and attempt limits, and the recovery sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import ancestors
from loomdex.operators.store import under

CAPACITY, TTL_HOURS, MAX_ATTEMPTS = 1000, 24, 5


def enqueue(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """failed (same columns): a file's entry keeps its id, creation time and recovery attempts and takes the new failure."""
    new = failed.alias("n").join(entries.alias("o"), "filePath", "left")
    merged = new.select(*[(F.coalesce(f"o.{c}", f"n.{c}") if c in ("id", "createdAt", "recoveryAttempts") else F.col("filePath") if c == "filePath" else F.col(f"n.{c}")).alias(c) for c in entries.columns])
    return entries.join(failed.select("filePath"), "filePath", "left_anti").select(*entries.columns).unionByName(merged)


def trim(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest entries up to capacity: a top-k, ties by id."""
    return entries.orderBy(F.desc("createdAt"), F.desc("id")).limit(capacity)


def expired(now: Column, hours: int = TTL_HOURS) -> Column:
    return F.col("createdAt") < now - F.make_dt_interval(hours=F.lit(hours))


def remove(entries: DataFrame, prefix: str) -> DataFrame:
    """Without the entries of a deleted file or folder."""
    return entries.where(~under(F.col("filePath"), prefix))


def remove_all(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the entries of any of many deleted files or folders (path)."""
    lead = entries.select("filePath", F.explode(F.array_append(ancestors(F.col("filePath")), F.col("filePath"))).alias("path"))
    hit = lead.join(gone.select("path").distinct(), "path", "left_semi").select("filePath").distinct()
    return entries.join(hit, "filePath", "left_anti")


def latest_errors(entries: DataFrame) -> DataFrame:
    return entries.groupBy("filePath").agg(F.max_by("errorMessage", F.struct("createdAt", "id")).alias("errorMessage"), F.max("createdAt").alias("createdAt"))


def sweep(entries: DataFrame, files: DataFrame, now: Column, results: DataFrame | None = None, healthy: bool = True, hours: int = TTL_HOURS, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds outcome: purged (expired, changed or gone), skipped (embedding down), retried, abandoned or kept.

    files (filePath, contentHash) are those on disk; results (filePath, ok) say which
    reprocessing worked, none meaning all did.
    """
    current = files.select("filePath", F.col("contentHash").alias("currentHash"))
    rows = entries.join(current, "filePath", "left")
    rows = rows.join(results.select("filePath", "ok"), "filePath", "left") if results is not None else rows.withColumn("ok", F.lit(True))
    outcome = (
        F.when(expired(now, hours), "purged")
        .when(F.lit(not healthy), "skipped")
        .when(F.col("currentHash").isNull() | (F.col("currentHash") != F.col("contentHash")), "purged")
        .when(F.coalesce("ok", F.lit(False)), "retried")
        .when(F.col("recoveryAttempts") + 1 >= attempts, "abandoned")
        .otherwise("kept")
    )
    return rows.withColumn("outcome", outcome).select(*entries.columns, "outcome")


def after_sweep(swept: DataFrame, now: Column) -> DataFrame:
    """The entries that stay: skipped ones as they are, failed ones with one attempt more."""
    kept = F.col("outcome") == "kept"
    return (
        swept.where(F.col("outcome").isin("kept", "skipped"))
        .withColumn("recoveryAttempts", F.col("recoveryAttempts") + kept.cast("int"))
        .withColumn("lastRetryAt", F.when(kept, now).otherwise(F.col("lastRetryAt")))
        .drop("outcome")
    )


def tallies(swept: DataFrame) -> DataFrame:
    return swept.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("retried", "purged", "skipped", "abandoned")])


def health(size: Column) -> Column:
    return F.when(size == 0, "healthy").when(size < 100, "warning").otherwise("critical")


def completion(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """stats with status: complete only while no dead letter is left; times of an incomplete run are not taken over."""
    open_ = entries.agg(F.count("*").alias("open"))
    gated = stats.crossJoin(F.broadcast(open_))
    return gated.withColumn("status", F.when(F.col("open") == 0, "complete").otherwise("incomplete")).withColumn("lastError", F.when(F.col("open") > 0, F.format_string("%d files failed to index", F.col("open"))))


def ordered(entries: DataFrame) -> DataFrame:
    return entries.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("createdAt", "id")))
