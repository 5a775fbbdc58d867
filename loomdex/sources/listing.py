"""Folders listed in tasks, level by level, and the feed of changes between two listings.

A listing opens the folders of a level in parallel tasks; names that an ignore pattern hides
go before the next level, so ignored folders are never opened. It is kept as a table of
``loomdex.operators.tables``, of which each poll commits what differs. The number of that
version is all that a feed has to remember: the changes between two versions can be read
again as long as both are kept, and a change that is applied under its number is applied once.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.globs import ignore_list, ignore_regex
from loomdex.functions.hashing import content_hash
from loomdex.operators.tables import Change, Spec, Tables
from loomdex.scratch import written

ENTRIES = "filePath string, isDirectory boolean, size bigint, stamp bigint"
LISTING = Spec("listing", "filePath string, size bigint, stamp bigint, hash string", "filePath", "filePath")


def _hidden(ignore: Iterable[str]) -> Callable[[str], bool]:
    given = [p.strip() for p in ignore_list(ignore)]
    hide, show = (ignore_regex(p.removeprefix("!") for p in given if p.startswith("!") == kept) for kept in (False, True))
    tests = [re.compile(p) if p else None for p in (hide, show)]
    return lambda path: bool(tests[0] and tests[0].match(path) and not (tests[1] and tests[1].match(path)))


def _open(root: str):
    """A file system and the root's path in it; local paths and any address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def list_files(spark: SparkSession, root: str, ignore: Iterable[str] = (), opened: Callable[[list[str]], None] | None = None) -> DataFrame:
    """(filePath, size, stamp in nanoseconds) of every file under root that no pattern hides.

    ``!pattern`` shows what others hide, if the folders above it are not hidden. Folders that
    vanish while they are listed are empty. opened (for tests) is told each level's folders.
    """
    root, given = root.rstrip("/"), list(ignore)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        hidden, (system, base) = _hidden(given), _open(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for entry in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
                    path = f"{folder}/{entry.base_name}" if folder else entry.base_name
                    if entry.type in (fs.FileType.File, fs.FileType.Directory) and not hidden(path):
                        rows.append((path, entry.type == fs.FileType.Directory, entry.size or 0, entry.mtime_ns or 0))
                if rows:
                    names = ["filePath", "isDirectory", "size", "stamp"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names)

    frontier, levels = spark.createDataFrame([("",)], "filePath string"), []
    while True:
        if opened is not None:
            opened([r.filePath for r in frontier.collect()])
        levels.append(written(frontier.mapInArrow(run, ENTRIES)))
        frontier = levels[-1].where("isDirectory").select("filePath")
        if frontier.isEmpty():
            break
        frontier = frontier.repartition(F.xxhash64("filePath"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("not isDirectory").select("filePath", "size", "stamp")


def read_files(files: DataFrame, root: str, most: int) -> DataFrame:
    """(filePath, content binary) of files; null for those that are gone or above ``most`` bytes. Read in tasks, one file at a time."""
    root = root.rstrip("/")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read(most + 1)
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None if content is None or len(content) > most else content], pa.binary())], ["filePath", "content"])

    return files.select("filePath").mapInArrow(run, "filePath string, content binary")


class Feed:
    """Changes of a folder since the listing of the last poll, kept at a place of its own."""

    def __init__(self, spark: SparkSession, root: str, at: str, ignore: Iterable[str] = (), most: int = 1 << 20, **how) -> None:
        self.spark, self.root, self.ignore, self.most = spark, root, list(ignore), most
        self.tables = Tables(spark, at, [LISTING], **how)

    def poll(self) -> int | None:
        """Lists the folder and commits what differs; the number of the new listing, None if nothing does.

        Only files whose size or time differ are read, for their hashes.
        """
        now = written(list_files(self.spark, self.root, self.ignore))
        held = self.tables.read("listing")
        both = now.alias("n").join(held.alias("o"), "filePath", "full_outer")
        same = F.col("n.size").eqNullSafe(F.col("o.size")) & F.col("n.stamp").eqNullSafe(F.col("o.stamp"))
        differ = written(both.where(~same).select("filePath", F.col("n.size").alias("size"), F.col("n.stamp").alias("stamp"), F.col("o.hash").alias("was")))
        if differ.isEmpty():
            return None
        came = differ.where("stamp is not null")
        hashed = read_files(came, self.root, self.most).select("filePath", content_hash(F.col("content")).alias("hash"))
        rows = came.select("filePath", "size", "stamp").join(hashed, "filePath")
        self.tables.commit({"listing": Change(rows, differ.where("stamp is null").select("filePath"))})
        self.tables.compact("listing")
        return self.tables.state.version

    def events(self, since: int, until: int | None = None) -> DataFrame:
        """(seq, type, filePath, contentHash) between two versions: added, modified and deleted, deletions first."""
        old, new = (self.tables.read("listing", state=self.tables.at(v)) if v != 0 else self.tables.read("listing").limit(0) for v in (since, self.tables.state.version if until is None else until))
        both = new.alias("n").join(old.alias("o"), "filePath", "full_outer")
        kind = F.when(F.col("o.stamp").isNull(), "added").when(F.col("n.stamp").isNull(), "deleted").when(~F.struct("n.size", "n.stamp", "n.hash").eqNullSafe(F.struct("o.size", "o.stamp", "o.hash")), "modified")
        rows = both.select(kind.alias("type"), "filePath", F.coalesce("n.hash", "o.hash").alias("contentHash")).where("type is not null")
        # The order of a deletion and an addition is all that renames ask for.
        return rows.select(F.when(F.col("type") == "deleted", 0).otherwise(1).cast("long").alias("seq"), "type", "filePath", "contentHash")

    def contents(self, events: DataFrame) -> DataFrame:
        """(filePath, content) of the files that came or changed."""
        return read_files(events.where("type <> 'deleted'"), self.root, self.most)

    def follow(self, apply: Callable[[DataFrame, tuple[str, int]], object], done: int = 0, polls: int | None = None, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> int:
        """Polls and hands each listing's changes to ``apply`` with their number; the last number that was applied.

        done: the last number applied before, from which a feed goes on after a failure: what
        came since is one batch then.
        """
        k = 0
        while polls is None or k < polls:
            self.poll()
            if self.tables.state.version > done:
                apply(self.events(done), ("listing", self.tables.state.version))
                done = self.tables.state.version
            k += 1
            if polls is None or k < polls:
                sleep(pause)
        return done
