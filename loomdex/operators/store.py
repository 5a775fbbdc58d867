"""The index's tables: chunk rows by file, the hash tree, dead letters and the embedding cache, in one version log.

Pure transformations come first; ``ChunkStore`` applies them as changes of
``loomdex.operators.tables``. No plan overwrites what it reads.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex import schemas
from loomdex.functions import vectors
from loomdex.functions.text import ancestors
from loomdex.operators.tables import Change, Folder, Spec, State, Tables

__all__ = ["Change", "ChunkStore", "Folder"]

MIN_STALE, THRESHOLD = 1, 0.2


def under(path: Column, prefix: str) -> Column:
    """The path itself or anything below it."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def upsert(old: DataFrame, new: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """All rows of affected files (those of ``new`` too) give way to the new rows."""
    paths = new.select("filePath")
    if affected is not None:
        paths = paths.unionByName(affected.select("filePath"))
    return old.join(paths.distinct(), "filePath", "left_anti").unionByName(new.select(*old.columns)).select(*old.columns)


def delete_path(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("filePath") != path)


def delete_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(~under(F.col("filePath"), prefix))


def rename(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (oldPath, newPath): rows move with their vectors, ids follow, and rows already at a target go."""
    moved = renames
    targets = moved.select(F.col("newPath").alias("filePath"))
    kept = rows.join(targets, "filePath", "left_anti")
    joined = kept.join(moved.withColumnRenamed("oldPath", "filePath"), "filePath", "left")
    tail = F.expr("substring(id, length(filePath) + 1)")
    out = joined.withColumn("id", F.when(F.col("newPath").isNotNull() & F.col("id").startswith(F.col("filePath")), F.concat("newPath", tail)).otherwise(F.col("id")))
    return out.withColumn("filePath", F.coalesce("newPath", "filePath")).select(*rows.columns)


def new_files(affected: DataFrame, existing: DataFrame) -> DataFrame:
    return affected.select("filePath").distinct().join(existing.select("filePath"), "filePath", "left_anti")


def latest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """One row for each key, the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(by.desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return latest(both, keys, F.col("__age")).drop("__age")


def fragmentation(rows: Column, stale: Column) -> Column:
    """Stale rows' part of all rows, 0 for an empty store."""
    return F.when(rows + stale == 0, F.lit(0.0)).otherwise(stale / (rows + stale))


def should_compact(rows: int, stale: int, threshold: float = THRESHOLD, min_stale: int = MIN_STALE) -> bool:
    ratio = stale / (rows + stale) if rows + stale else 0.0
    return stale >= min_stale and (stale > 0 if threshold == 0 else ratio >= threshold)


# ---------------------------------------------------------------- embedding cache


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (filePath, hash ...) with vector from the cache, null for a miss."""
    return chunks.join(cache.select("hash", "vector"), "hash", "left")


def cache_misses(looked_up: DataFrame) -> DataFrame:
    """Each missing hash once: a text that several chunks share is embedded once."""
    return looked_up.where("vector is null").dropDuplicates(["hash"])


def files_with_misses(looked_up: DataFrame) -> DataFrame:
    """Files that wait for at least one embedding; when embedding fails they are the failed ones."""
    return looked_up.where("vector is null").select("filePath").distinct()


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace old ones; the time of first insertion stays."""
    both = cache.withColumn("__age", F.lit(0)).unionByName(new.select(*cache.columns).withColumn("__age", F.lit(1)))
    first = F.min("createdAt").over(Window.partitionBy("hash"))
    return latest(both.withColumn("createdAt", first), ["hash"], F.col("__age")).drop("__age").select(*cache.columns)


def cache_prune(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.where(F.col("createdAt") >= now - F.make_dt_interval(days=F.lit(days)))


# ---------------------------------------------------------------- store

STORED = ", ".join(c for c in schemas.CHUNKS.split(", ") if not c.startswith("path_bucket"))
SPECS = (
    Spec("chunks", STORED, "filePath", "filePath"),
    Spec("cache", schemas.EMBEDDING_CACHE, "hash", "hash"),
    # A folder's children share a bucket, so a level of the tree is read by its parents.
    Spec("tree", schemas.MERKLE_NODES, "parentPath", "path"),
    Spec("dead_letters", schemas.DEAD_LETTERS, "filePath", "filePath"),
)


@dataclass
class Counters:
    dimensions: int
    staleCount: int = 0
    totalFiles: int = 0
    lastCompactedAt: str | None = None
    lastIndexedAt: str | None = None
    lastFullScanAt: str | None = None
    lastError: str | None = None


class ChunkStore:
    """Chunk rows and the tables that belong to them at a folder; one writer at a time (``tables.Tables``).

    ``changes`` arguments name changes of the other tables that are committed with the rows.
    """

    def __init__(self, spark: SparkSession, root: str, dimensions: int, **how) -> None:
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions
        self.tables = Tables(spark, root, SPECS, **how)
        if self.counters.dimensions != dimensions:
            raise ValueError(f"store holds vectors of {self.counters.dimensions} dimensions, not {dimensions}")

    @property
    def counters(self) -> Counters:
        return Counters(**{"dimensions": self.dimensions} | self.tables.state.counters)

    def refresh(self) -> None:
        """Takes over the newest version, also another writer's."""
        self.tables.refresh()

    def lease(self, seconds: float = 3600.0):
        """``with store.lease() as state: store.rows(state=state)`` reads one version, whatever is written meanwhile."""
        return self.tables.lease(seconds)

    def rows(self, paths: Iterable[str] | None = None, among: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """All rows, or those of some files (names, or a table's first column); other buckets are not read."""
        if paths is not None:
            paths = list(paths)
            return self.tables.read("chunks", self._paths(paths), state=state).where(F.col("filePath").isin(paths))
        return self.tables.read("chunks", among, state=state)

    def _paths(self, paths: Iterable[str], name: str = "filePath") -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], f"{name} string")

    def _ready(self, new: DataFrame) -> DataFrame:
        return new.withColumn("vector", vectors.or_zero(F.col("vector"), self.dimensions)).withColumn("symbolName", F.coalesce("symbolName", F.lit("")))

    def upsert(self, new: DataFrame, affected: DataFrame | None = None) -> dict:
        return self.apply(new, affected)

    def below(self, gone: DataFrame, state: State | None = None) -> DataFrame:
        """(filePath): the stored files that are, or lie below, the given paths (path).

        With a tree the folders are opened level by level, by their bucket; without one the
        paths of all rows are read.
        """
        gone = gone.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
        if (state or self.tables.state).live("tree"):
            from loomdex.operators import merkle

            nodes = merkle.expand(gone, self.children(state))
            return nodes.where("not isDirectory").select(F.col("path").alias("filePath")).unionByName(gone.select(F.col("path").alias("filePath"))).distinct()
        lead = self.rows(state=state).select("filePath").distinct().select("filePath", F.explode(F.array_append(ancestors(F.col("filePath")), F.col("filePath"))).alias("path"))
        return lead.join(gone, "path", "left_semi").select("filePath").distinct()

    def apply(self, new: DataFrame | None = None, affected: DataFrame | None = None, gone: DataFrame | None = None, renames: DataFrame | None = None, changes: dict[str, Change] | None = None, batch: tuple[str, int] | None = None, finish: tuple[str, bool] | None = None) -> dict | None:
        """One version for a batch: renames (oldPath, newPath), then files and folders that are gone (path), then the files
        of ``affected`` and ``new`` give way to the rows of ``new``. Only the batch's rows and the paths whose older rows
        are dead are written. finish: the time and kind of the run that this ends. None if the batch (source, number) has
        been applied before."""
        leaving = [affected.select("filePath")] if affected is not None else []
        if gone is not None:
            leaving.append(self.below(gone).select("filePath"))
        coming = [self._ready(new).select(*self._columns)] if new is not None else []
        if renames is not None:
            moved = rename(self.rows(among=renames.select("oldPath")), renames.select("oldPath", "newPath"))
            for other in (*leaving, *([new.select("filePath")] if new is not None else [])):
                moved = moved.join(other.distinct(), "filePath", "left_anti")
            coming.append(moved.select(*self._columns))
            leaving.append(renames.select(F.explode(F.array("oldPath", "newPath")).alias("filePath")))
        union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
        change = Change(union(coming), union(leaving))

        def counted(done: dict) -> dict:
            rows = done["chunks"]
            return {"staleCount": self.counters.staleCount + rows["dead"], "totalFiles": self.counters.totalFiles + rows["new"] - rows["left"]} | self._ended(done, finish)

        done = self.tables.commit({"chunks": change} | (changes or {}), counted, batch)
        return None if done is None else {"deleted": done["chunks"]["dead"], "newFiles": done["chunks"]["new"]}

    @property
    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], STORED).columns

    def rebuild(self, new: DataFrame, expected: int = 0, changes: dict[str, Change] | None = None, finish: tuple[str, bool] | None = None) -> dict:
        """A version of new rows alone; until it is written readers have the old one. expected: about how many rows."""
        change = Change(self._ready(new).select(*self._columns), whole=True, expected=expected)
        done = self.tables.commit({"chunks": change} | (changes or {}), lambda done: {"totalFiles": done["chunks"]["new"], "staleCount": 0} | self._ended(done, finish))
        return {"deleted": 0, "newFiles": done["chunks"]["new"]}

    def _delete(self, paths: DataFrame) -> int:
        return self.apply(affected=paths)["deleted"]

    def delete_path(self, path: str) -> int:
        return self._delete(self._paths([path])) if not self.rows([path]).isEmpty() else 0

    def delete_prefix(self, prefix: str) -> int:
        hit = self.below(self._paths([prefix], "path"))
        held = self.rows(among=hit).select("filePath").distinct()
        return 0 if held.isEmpty() else self._delete(held)

    def rename(self, old: str, new: str) -> int:
        n = self.rows([old]).count()
        if n:
            self.apply(renames=self.spark.createDataFrame([(old, new)], "oldPath string, newPath string"))
        return n

    def stats(self) -> dict:
        c, n = self.counters, self.tables.state.live("chunks")
        return {
            "totalChunks": n, "totalFiles": c.totalFiles, "staleCount": c.staleCount, "fragmentationRatio": c.staleCount / (n + c.staleCount) if n + c.staleCount else 0.0, "dimensions": c.dimensions,
            "lastCompactedAt": c.lastCompactedAt, "lastIndexedAt": c.lastIndexedAt, "lastFullScanAt": c.lastFullScanAt, "lastError": c.lastError,
        }

    @staticmethod
    def outcome(open_: int, now: str, full: bool = False) -> dict:
        """What a finished run records: times only while no dead letter is open, otherwise its error with the old times kept."""
        if open_:
            return {"lastError": f"{open_} files failed to index"}
        return {"lastIndexedAt": now, "lastError": None} | ({"lastFullScanAt": now} if full else {})

    def _ended(self, done: dict, finish: tuple[str, bool] | None) -> dict:
        letters = done.get("dead_letters", {"came": 0, "dead": 0})
        return {} if finish is None else self.outcome(self.tables.state.live("dead_letters") + letters["came"] - letters["dead"], *finish)

    def complete(self, dead_letters: DataFrame | None, now: str, full: bool = False) -> str:
        """Records a finished run by the given dead letters."""
        open_ = 0 if dead_letters is None else dead_letters.count()
        self.tables.commit({}, self.outcome(open_, now, full))
        return "incomplete" if open_ else "complete"

    def note(self, error: str | None) -> None:
        if self.counters.lastError != error:
            self.tables.commit({}, {"lastError": error})

    def compact(self, now: str, threshold: float = THRESHOLD, min_stale: int = MIN_STALE, force: bool = False) -> dict:
        """Rewrites the buckets with dead rows or several parts if enough rows are stale, and splits those that are too large."""
        before = self.stats()
        if not force and not should_compact(before["totalChunks"], before["staleCount"], threshold, min_stale):
            return {"compacted": False, "before": before["fragmentationRatio"], "after": before["fragmentationRatio"], "removed": 0}
        mixed = {b for b, held in self.tables.buckets("chunks").items() if held["gone"] or len(held["parts"]) > 1}
        self.tables.compact("chunks", mixed | self.tables.worn("chunks"), {"staleCount": 0, "lastCompactedAt": now})
        return {"compacted": True, "before": before["fragmentationRatio"], "after": 0.0, "removed": before["staleCount"]}

    def upkeep(self) -> int:
        """Rewrites worn buckets of every table; each has few of them after a batch, whatever the tables' size."""
        return sum(self.tables.compact(name) for name in self.tables.specs)

    def compact_when_idle(self, now: str, last_change: datetime, at: datetime, idle_seconds: int = 300, **how) -> dict | None:
        """Compaction if nothing has changed for so long; None if something has."""
        return self.compact(now, **how) if (at - last_change).total_seconds() >= idle_seconds else None

    def reset(self) -> None:
        self.tables.commit({name: Change(whole=True) for name in ("chunks", "tree", "dead_letters")}, asdict(Counters(self.dimensions)))

    # The tables beside the rows belong to the same versions.

    def cache(self, hashes: DataFrame | None = None) -> DataFrame:
        """The embedding cache, or its rows of some hashes (first column)."""
        return self.tables.read("cache", hashes)

    def save_cache(self, cache: DataFrame) -> None:
        """The cache as given, in place of the old one."""
        self.tables.commit({"cache": Change(cache, whole=True)})

    def add_to_cache(self, new: DataFrame) -> None:
        """New vectors replace those of equal hashes; no other row is written."""
        self.tables.commit({"cache": Change(new)})

    def prune_cache(self, now: Column, days: int) -> int:
        """Removes vectors older than so many days; how many."""
        old = self.cache().select("hash", "createdAt").join(cache_prune(self.cache().select("hash", "createdAt"), now, days).select("hash"), "hash", "left_anti")
        return self.tables.commit({"cache": Change(gone=old.select("hash"))})["cache"]["dead"]

    def delete_from_cache(self, hashes: DataFrame) -> int:
        return self.tables.commit({"cache": Change(gone=hashes.select("hash"))})["cache"]["dead"]

    def clear_cache(self) -> int:
        return self.tables.commit({"cache": Change(whole=True)})["cache"]["dead"]

    def children(self, state: State | None = None):
        """Reads the stored tree by folders, as ``merkle.Children``: nodes at the top have parentPath ''."""
        return lambda parents: self.tables.read("tree", parents, state=state)

    def tree(self, state: State | None = None) -> DataFrame:
        """All nodes of the hash tree."""
        return self.tables.read("tree", state=state).withColumn("parentPath", F.nullif("parentPath", F.lit("")))

    @staticmethod
    def tree_change(upserts: DataFrame, gone: DataFrame | None = None, whole: bool = False) -> Change:
        """The tree's change for nodes that come and nodes (path, parentPath) that go, as ``merkle.delta`` gives them."""
        top = lambda rows: rows.withColumn("parentPath", F.coalesce("parentPath", F.lit("")))
        return Change(top(upserts), None if gone is None else top(gone), whole)

    def dead_letters(self) -> DataFrame:
        return self.tables.read("dead_letters")
