"""Change events in batch form: sessions, coalescing, and the queue's back-pressure."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEBOUNCE_MS, MAX_QUEUE, FULL_SCAN_AT = 100, 10_000, 5_000


def sessions(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Adds session: a path's events whose neighbours are at most gap_ms apart share a number."""
    w = Window.partitionBy("filePath").orderBy("detectedAt", "seq")
    away = F.unix_micros("detectedAt") - F.lag(F.unix_micros("detectedAt")).over(w)
    return events.withColumn("__new", F.when(away.isNull() | (away > gap_ms * 1000), 1).otherwise(0)).withColumn("session", F.sum("__new").over(w)).drop("__new")


def merge_type(held: Column, came: Column) -> Column:
    """What a held event and the next one of its path become; null cancels both."""
    return (
        F.when(held.isNull(), came)
        .when((held == "added") & (came == "deleted"), F.lit(None).cast("string"))
        .when((held == "added") & (came == "modified"), F.lit("added"))
        .when((held == "deleted") & came.isin("added", "modified"), F.lit("modified"))
        .otherwise(came)
    )


def fold(types: Column) -> Column:
    """The type that an ordered array of types leaves, null if they cancel out."""
    return F.aggregate(types, F.lit(None).cast("string"), merge_type)


def coalesce(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """One event for each session of a path that does not cancel: folded type, payload of the last event."""
    grouped = sessions(events, gap_ms).groupBy("filePath", "session").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "contentHash", "detectedAt"))).alias("e"))
    last = F.element_at("e", -1)
    folded = grouped.withColumn("type", fold(F.transform("e", lambda x: x["type"]))).where("type is not null")
    return folded.select("filePath", "session", last["seq"].alias("seq"), "type", last["contentHash"].alias("contentHash"), last["detectedAt"].alias("detectedAt"), F.size("e").alias("events"))


def backpressure(events: DataFrame, max_queue: int = MAX_QUEUE, full_scan_at: int = FULL_SCAN_AT) -> DataFrame:
    """Adds accepted and state for events of one undrained queue, in order of seq.

    A path's first event makes the queue longer, a later one replaces it. The event that
    fills the queue to ``full_scan_at`` is accepted and puts it into overflow; all later
    ones are dropped. Only the ``full_scan_at`` first paths matter, and they are found by
    a top-k, so no task sorts the whole stream.
    """
    if full_scan_at > max_queue:
        raise ValueError("the full-scan threshold must not exceed the queue's size")
    first = events.groupBy("filePath").agg(F.min("seq").alias("seq")).orderBy("seq").limit(full_scan_at)
    limit = first.agg(F.when(F.count("*") >= full_scan_at, F.max("seq")).alias("limit"))
    return events.crossJoin(F.broadcast(limit)).select(*events.columns, (F.col("limit").isNull() | (F.col("seq") <= F.col("limit"))).alias("accepted"), F.when(F.col("limit").isNotNull() & (F.col("seq") >= F.col("limit")), "overflow").otherwise("normal").alias("state"))


def queue_summary(marked: DataFrame) -> DataFrame:
    """One row: queue size (paths held), dropped events, final state."""
    return marked.agg(
        F.count_distinct(F.when(F.col("accepted"), F.col("filePath"))).alias("queued"), F.count_if(~F.col("accepted")).alias("dropped"), F.max_by("state", "seq").alias("state")
    )


def lanes(events: DataFrame) -> DataFrame:
    """Order of work: reindex requests first, then changes, each by seq."""
    return events.withColumn("lane", F.when(F.col("type") == "reindex", 1).otherwise(2)).orderBy("lane", "seq")


def retry(outcomes: DataFrame) -> DataFrame:
    """Failed events that go back into the queue: all but changes whose file is gone."""
    gone = (F.col("type") != "reindex") & F.col("error").rlike("(?i)enoent|no such file")
    return outcomes.where(F.col("error").isNotNull() & ~gone)


def machine(events: DataFrame, max_queue: int = MAX_QUEUE, full_scan_at: int = FULL_SCAN_AT) -> DataFrame:
    """(queue, seq, type, accepted, state) of each queue's events, with full scans and drains among them.

    A change of a new path lengthens the queue. One that would lengthen it beyond
    ``max_queue``, or brings it to ``full_scan_at``, puts the queue into overflow; the
    latter is accepted, the former dropped, and so is all that follows. ``scan_started``
    empties the queue and sets full_scan, ``scan_finished`` returns to normal, ``drained``
    empties the queue in the normal state. The state of a queue depends on all before, so a
    queue is one task; many queues (projects) run side by side.
    """
    if full_scan_at > max_queue:
        raise ValueError("the full-scan threshold must not exceed the queue's size")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, state, out = set(), "normal", []
        for e in rows.sort_values("seq").itertuples():
            accepted = True
            if e.type == "scan_started":
                held, state = set(), "full_scan"
            elif e.type == "scan_finished":
                state = "normal"
            elif e.type == "drained":
                held = set() if state == "normal" else held
            elif state != "normal":
                accepted = False
            elif e.filePath not in held and len(held) >= max_queue:
                accepted, state = False, "overflow"
            else:
                held.add(e.filePath)
                state = "overflow" if len(held) >= full_scan_at else state
            out.append((e.queue, int(e.seq), e.type, accepted, state))
        return pd.DataFrame(out, columns=["queue", "seq", "type", "accepted", "state"])

    return events.select(F.col("queue").cast("string").alias("queue"), "seq", "type", "filePath").groupBy("queue").applyInPandas(run, "queue string, seq long, type string, accepted boolean, state string")


def hold_back(events: DataFrame, scan_end: Column, most: int = MAX_QUEUE) -> DataFrame:
    """Adds released and missed to the events that came during a first scan (before scan_end).

    The newest event of each of the ``most`` first paths is released after the scan; if
    there are more paths, missed is true on every row and a full scan has to follow.
    """
    during = events.where(F.col("detectedAt") < scan_end)
    paths = during.groupBy("filePath").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    kept = paths.orderBy("first").limit(most).select("filePath", "last", F.lit(True).alias("__kept"))
    missed = paths.agg((F.count("*") > most).alias("missed"))
    rows = during.join(kept, "filePath", "left").crossJoin(F.broadcast(missed))
    return rows.withColumn("released", F.coalesce(F.col("__kept") & (F.col("seq") == F.col("last")), F.lit(False))).drop("__kept", "last")


def drain(batch: DataFrame, apply: Callable[[DataFrame], object], window: int | None = None) -> tuple[DataFrame | None, Exception | None]:
    """Applies a batch in its lanes' order, a window of paths after the other; (events that failed, the first error).

    Every window runs, whatever happens to others. Failed changes come back to be queued
    again, but for those whose file is gone.
    """
    failed, first = [], None
    ordered = lanes(batch)
    for lane in (1, 2):
        rows = ordered.where(F.col("lane") == lane).drop("lane")
        if window is None:
            parts = [rows]
        else:
            # Windows by a path's hash: no path is in two, and no order of all paths is needed.
            n = max(1, -(-rows.select("filePath").distinct().count() // window))
            parts = [rows.where(F.pmod(F.xxhash64("filePath"), F.lit(n)) == i) for i in range(n)]
        for part in parts:
            try:
                if not part.isEmpty():
                    apply(part)
            except Exception as failure:
                first = first or failure
                failed.append(part.withColumn("error", F.lit(str(failure))))
    if not failed:
        return None, None
    every = failed[0]
    for more in failed[1:]:
        every = every.unionByName(more)
    return retry(every), first
