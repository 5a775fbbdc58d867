"""Keyed tables in growing buckets, changed by deltas under one version log.

A table's rows lie in buckets by the hash of a column. Buckets are those of an extendible
hash: a bucket of depth d holds the hashes that end in its d bits, and one that outgrows
``capacity`` rows is split alone, by its next bits, whatever the others' depth. A commit
writes new rows as a part beside a bucket's older ones, and the keys whose older rows are
dead as a delete vector (key, version); readers drop rows that are older than their key's
vector. So a commit writes what changed, not the buckets that it falls into. Merging
(``compact``) rewrites the buckets that have too many parts or dead rows, or are too large.

The log has one small file for each version with that version's edits, and now and then a
whole state to start reading from. All tables, counters and batch numbers of a version
appear at once. A version's file is created whole and only if it does not exist: by a hard
link on local disks, by a rename that refuses to overwrite elsewhere, which HDFS does
atomically. Object stores without such a rename need a single writer.

Versions stay readable for ``keep_seconds``, and for longer while a lease names them. What
no readable version names is deleted. Folders that no version ever named may belong to a
writer that has not committed yet, so they stay for ``orphan_seconds``.

A batch is named by its source and number. A source's numbers rise; one that is not above
the last committed number changes nothing, so a batch that comes again is applied once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from copy import deepcopy
from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY, MAX_DEPTH = 1 << 18, 24
#: Parts of a bucket, and dead rows as a share of its rows, from which it is rewritten.
MOST_PARTS, DEAD_SHARE = 16, 0.3
#: Versions between two whole states in the log.
STATE_EVERY = 16
#: Versions between two looks for what can be deleted.
EXPIRE_EVERY = 8
KEEP_SECONDS, ORPHAN_SECONDS = 3600.0, 86_400.0

SEQ, BUCKET = "__seq", "__bucket"


class Folder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, below: str = "") -> list[str]:
        at = self._path(below)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def bytes(self, below: str = "") -> int:
        return self._fs.getContentSummary(self._path(below)).getLength()

    def changed(self, name: str) -> float:
        """When a file or folder was last changed, in seconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not exist yet; another writer's file of that name is an error."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                paths = self.spark._jvm.java.nio.file.Paths
                at = [paths.get(self._path(x).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.String, 0)) for x in (name, part)]
                self.spark._jvm.java.nio.file.Files.createLink(*at)
            else:
                refuse = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(part), self._path(name), refuse)
        except Exception as failure:
            if self._fs.exists(self._path(name)):
                raise RuntimeError(f"another writer was faster: {name}") from failure
            raise
        finally:
            self._fs.delete(self._path(part), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Spec:
    """A table: its columns, the column whose hash picks the bucket, and the column whose values are replaced."""

    name: str
    schema: str
    by: str
    key: str


@dataclass
class Change:
    """Of one table: rows that come, replacing those of equal keys, and keys that go (``gone``: columns key and by)."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    #: All older rows go.
    whole: bool = False
    #: No older row has a key of these rows, so none is looked for.
    fresh: bool = False
    #: Rows to expect, for a table's first depth; more or fewer do no harm.
    expected: int = 0


@dataclass
class State:
    version: int = 0
    at: float = 0.0
    #: For each table and bucket (depth-bits): parts [path, rows], delete vectors [path, keys, rows], and whether no
    #: split can part its rows (``one``).
    tables: dict[str, dict[str, dict[str, list]]] = field(default_factory=dict)
    counters: dict = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def follow(self, version: dict) -> None:
        """Takes over a version's edits."""
        self.version, self.at = version["version"], version["at"]
        self.counters |= version["counters"]
        self.batches |= version["batches"]
        for edit in version["edits"]:
            table = self.tables.setdefault(edit["table"], {})
            if edit.get("left"):
                table.pop(edit["bucket"], None)
                continue
            held = table.setdefault(edit["bucket"], {"parts": [], "gone": []})
            held["parts"] += edit.get("parts", [])
            held["gone"] += edit.get("gone", [])
            held["one"] = edit.get("one", held.get("one", False) and not edit.get("parts"))

    def live(self, table: str) -> int:
        held = self.tables.get(table, {}).values()
        return sum(p[1] for b in held for p in b["parts"]) - sum(g[2] for b in held for g in b["gone"])

    def dead(self, table: str) -> int:
        return sum(g[2] for b in self.tables.get(table, {}).values() for g in b["gone"])

    def folders(self) -> set[str]:
        return {x[0].split("/", 1)[0] for t in self.tables.values() for b in t.values() for x in (*b["parts"], *b["gone"])}


def _bits(bucket: str) -> tuple[int, int]:
    depth, bits = bucket.split("-")
    return int(depth), int(bits)


def directory(buckets: Iterable[str]) -> list[str]:
    """The bucket of each ending of the hash, as long as the deepest one's."""
    split = [(*_bits(b), b) for b in buckets]
    size = 1 << max((d for d, _, _ in split), default=0)
    slots = [""] * size
    for depth, bits, name in split:
        for slot in range(bits, size, 1 << depth):
            slots[slot] = name
    return slots


def bucket_of(value: Column, buckets: Iterable[str]) -> Column:
    slots = directory(buckets)
    if len(slots) == 1:
        return F.lit(slots[0])
    return F.get(F.split(F.lit(",".join(slots)), ","), F.hash(value).bitwiseAND(F.lit(len(slots) - 1)))


class Tables:
    """Tables of a folder; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, specs: Iterable[Spec], capacity: int = CAPACITY, keep_seconds: float = KEEP_SECONDS, orphan_seconds: float = ORPHAN_SECONDS, clock=time.time) -> None:
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)
        self.specs = {s.name: s for s in specs}
        self.capacity, self.keep_seconds, self.orphan_seconds, self.clock = capacity, keep_seconds, orphan_seconds, clock
        self.state = State()
        self._known: dict[int, dict] = {}
        self.refresh()

    # ------------------------------------------------------------ log

    def _log(self) -> tuple[list[int], list[int]]:
        """The numbers of the log's versions and of its whole states."""
        names = self.folder.names("log")
        return ([int(n[:12]) for n in names if n.endswith(".json") and ".state" not in n], [int(n[:12]) for n in names if n.endswith(".state.json")])

    def at(self, version: int | None = None) -> State:
        """The state of a version that can still be read, the newest one by default."""
        versions, whole = self._log()
        last = version if version is not None else max(versions, default=0)
        start = max((w for w in whole if w <= last), default=0)
        known = self.state.version if start <= self.state.version <= last else 0
        state = deepcopy(self.state) if known else State(**json.loads(self.folder.read(f"log/{start:012d}.state.json"))) if start else State()
        for n in versions:
            if state.version < n <= last:
                state.follow(self._version(n))
        return state

    def _version(self, n: int) -> dict:
        if n not in self._known:
            self._known[n] = json.loads(self.folder.read(f"log/{n:012d}.json"))
        return self._known[n]

    def refresh(self) -> State:
        """Takes over the newest version, also another writer's."""
        self.state = self.at()
        return self.state

    def _commit(self, edits: list[dict], counters: dict, batch: tuple[str, int] | None) -> None:
        version = {"version": self.state.version + 1, "at": self.clock(), "edits": edits, "counters": counters, "batches": dict([batch]) if batch else {}}
        self.folder.create(f"log/{version['version']:012d}.json", json.dumps(version))
        self.state.follow(version)
        if self.state.version % STATE_EVERY == 0:
            self.folder.create(f"log/{self.state.version:012d}.state.json", json.dumps(self.state.__dict__))
        if self.state.version % EXPIRE_EVERY == 0:
            self.expire()

    # ------------------------------------------------------------ leases

    @contextmanager
    def lease(self, seconds: float = KEEP_SECONDS) -> Iterator[State]:
        """The present state, whose files stay until the lease ends or runs out; see ``read``."""
        state = deepcopy(self.refresh())
        name = f"leases/{state.version:012d}-{int((self.clock() + seconds) * 1000)}-{uuid.uuid4().hex}"
        self.folder.create(name, "")
        try:
            yield state
        finally:
            self.folder.delete(name)

    def _leased(self) -> set[int]:
        out = set()
        for name in self.folder.names("leases"):
            version, ends, *_ = name.split("-")
            if int(ends) / 1000 >= self.clock():
                out.add(int(version))
            else:
                self.folder.delete(f"leases/{name}")
        return out

    def expire(self) -> list[str]:
        """Deletes log files and folders that no readable version needs; names of the folders."""
        versions, whole = self._log()
        if not versions:
            return []
        now, kept = self.clock(), self._leased() | {versions[-1]}
        readable = [v for v in versions if v in kept or self._version(v)["at"] + self.keep_seconds > now]
        start = max((w for w in whole if w <= readable[0]), default=0)
        state = State(**json.loads(self.folder.read(f"log/{start:012d}.state.json"))) if start else State()
        # What any file of the log names, and what the readable versions need.
        named, used = state.folders(), set()
        for v in versions:
            if v > state.version:
                state.follow(self._version(v))
            named |= {x[0].split("/", 1)[0] for e in self._version(v)["edits"] for x in (*e.get("parts", []), *e.get("gone", []))}
            if v in readable:
                used |= state.folders()
        gone = [n for n in self.folder.names() if n.startswith("d-") and n not in used and (n in named or self.folder.changed(n) + self.orphan_seconds <= now)]
        for name in gone:
            self.folder.delete(name)
        # The log is read from a whole state on, so what lies before the one that is needed can go.
        for v in versions:
            if v <= start and v not in readable:
                self.folder.delete(f"log/{v:012d}.json")
                self._known.pop(v, None)
        for w in whole:
            if w < start:
                self.folder.delete(f"log/{w:012d}.state.json")
        return gone

    # ------------------------------------------------------------ rows

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def buckets(self, name: str, state: State | None = None) -> dict[str, dict[str, list]]:
        return (state or self.state).tables.get(name) or {"0-0": {"parts": [], "gone": [], "one": False}}

    def _touched(self, name: str, values: DataFrame, state: State) -> set[str]:
        """Buckets of values (first column): as many rows as there are buckets at most."""
        buckets = self.buckets(name, state)
        if len(buckets) == 1:
            return set(buckets)
        return {r.b for r in values.select(bucket_of(F.col(values.columns[0]), buckets).alias("b")).distinct().collect()}

    def _load(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self._empty(schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, name: str, among: DataFrame | None = None, buckets: Iterable[str] | None = None, state: State | None = None, seq: bool = False) -> DataFrame:
        """A table's rows. among: values of the bucket column (first column); only their buckets' files are read."""
        spec, state = self.specs[name], state or self.state
        held = self.buckets(name, state)
        if among is not None:
            chosen = self._touched(name, among, state)
        else:
            chosen = set(held if buckets is None else buckets)
        live, mixed = ([b for k, b in sorted(held.items()) if k in chosen and bool(b["gone"]) == d] for d in (False, True))
        schema = f"{spec.schema}, {SEQ} bigint"
        rows = self._load(schema, [p[0] for b in live for p in b["parts"]])
        if any(b["parts"] for b in mixed):
            dead = self._load(f"{spec.key} string, {SEQ} bigint", [g[0] for b in mixed for g in b["gone"]]).groupBy(spec.key).agg(F.max(SEQ).alias("__dead"))
            older = self._load(schema, [p[0] for b in mixed for p in b["parts"]]).join(dead, spec.key, "left").where(F.col("__dead").isNull() | (F.col(SEQ) >= F.col("__dead")))
            rows = rows.unionByName(older.drop("__dead"))
        if among is not None:
            rows = rows.join(among.select(F.col(among.columns[0]).alias(spec.by)).distinct(), spec.by, "left_semi")
        columns = self._empty(spec.schema).columns
        return rows.select(*columns, *([SEQ] if seq else []))

    def _write(self, rows: DataFrame, by: str, buckets: Iterable[str]) -> tuple[str, list[str]]:
        """Writes rows by bucket: the folder, and the buckets that have any."""
        name = f"d-{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, bucket_of(F.col(by), buckets))
        # Rebalance keeps a bucket together but splits one that is too large for a task.
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}")
        found = [n.split("=")[1] for n in self.folder.names(name) if n.startswith(f"{BUCKET}=")]
        if not found:
            self.folder.delete(name)
        return name, found

    def _sized(self, name: str, folder: str, schema: str, found: list[str]) -> dict[str, int]:
        """Rows of each bucket of a written folder, from its files alone."""
        if not found:
            return {}
        rows = self.spark.read.schema(f"{schema}, {BUCKET} string").parquet(f"{self.root}/{folder}")
        return {r[BUCKET]: r.n for r in rows.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}

    def stage(self, name: str, change: Change) -> tuple[list[dict], dict, list[str]]:
        """Writes a change's parts and delete vectors: (edits, what they count, folders)."""
        spec, version = self.specs[name], self.state.version + 1
        held, edits, folders = dict(self.buckets(name)), [], []
        if change.whole:
            depth = min(MAX_DEPTH, max(0, ceil(log2(change.expected / self.capacity)))) if change.expected > self.capacity else 0
            edits += [{"table": name, "bucket": b, "left": True} for b in held]
            held = {f"{depth}-{i}": {"parts": [], "gone": [], "one": False} for i in range(1 << depth)}
            edits += [{"table": name, "bucket": b} for b in held]
        elif not self.state.tables.get(name):
            edits += [{"table": name, "bucket": b} for b in held]
        came, written = {}, None
        if change.rows is not None:
            folder, found = self._write(change.rows.select(*self._empty(spec.schema).columns).withColumn(SEQ, F.lit(version).cast("long")), spec.by, held)
            folders += [folder] if found else []
            came = self._sized(name, folder, f"{spec.schema}, {SEQ} bigint", found)
            edits += [{"table": name, "bucket": b, "parts": [[f"{folder}/{BUCKET}={b}", n]]} for b, n in came.items()]
            written = self._load(spec.schema, [f"{folder}/{BUCKET}={b}" for b in came])
        wanted = list(dict.fromkeys((spec.key, spec.by)))
        keys = [x.select(*wanted) for x in (None if change.fresh else written, change.gone) if x is not None and (x is not written or came)]
        tally = {"came": sum(came.values()), "dead": 0, "keys": 0, "new": 0, "left": 0}
        if change.whole:
            tally |= {"dead": self.state.live(name), "keys": written.select(spec.key).distinct().count() if came else 0}
            return edits, tally | {"new": tally["keys"]}, folders
        if not keys:
            return edits, tally | {"new": written.select(spec.key).distinct().count() if came else 0}, folders
        asked = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        asked = asked.groupBy(*wanted).agg(F.lit(True).alias("asked"))
        touched = self._touched(name, asked.select(spec.by), self.state)
        old = self.read(name, buckets=touched).select(*wanted) if any(held[b]["parts"] for b in touched) else self._empty(", ".join(f"{c} string" for c in wanted))
        hit = old.join(asked.select(spec.key), spec.key, "left_semi").groupBy(*wanted).agg(F.count("*").alias("n")).withColumn(SEQ, F.lit(version).cast("long"))
        folder, found = self._write(hit, spec.by, held)
        folders += [folder] if found else []
        stays = (written.select(spec.key).distinct() if came else self._empty(f"{spec.key} string")).withColumn("stays", F.lit(1))
        if found:
            dead = self.spark.read.schema(f"{spec.key} string, n bigint, {SEQ} bigint, {BUCKET} string").parquet(f"{self.root}/{folder}")
            per = dead.join(stays, spec.key, "left").groupBy(BUCKET).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.count("stays").alias("stays")).collect()
            edits += [{"table": name, "bucket": r[BUCKET], "gone": [[f"{folder}/{BUCKET}={r[BUCKET]}", r["keys"], r["rows"]]]} for r in per]
            tally |= {"dead": sum(r["rows"] for r in per), "keys": sum(r["keys"] for r in per), "left": sum(r["keys"] - r["stays"] for r in per)}
            kept = sum(r["stays"] for r in per)
        else:
            kept = 0
        return edits, tally | {"new": (stays.count() if came else 0) - kept}, folders

    def commit(self, changes: dict[str, Change], counters=None, batch: tuple[str, int] | None = None) -> dict[str, dict] | None:
        """Changes of any tables as one version; what each did, or None if the batch has been committed before.

        counters: values to keep with the version, or a function of what the changes did.
        """
        if batch is not None and self.state.batches.get(batch[0], -1) >= batch[1]:
            return None
        edits, done, folders = [], {}, []
        try:
            for name, change in changes.items():
                more, done[name], made = self.stage(name, change)
                edits, folders = edits + more, folders + made
            self._commit(edits, (counters(done) if callable(counters) else counters) or {}, batch)
        except Exception:
            for folder in folders:
                self.folder.delete(folder)
            raise
        return done

    # ------------------------------------------------------------ upkeep

    def worn(self, name: str, most_parts: int = MOST_PARTS, dead_share: float = DEAD_SHARE) -> set[str]:
        """Buckets that are worth rewriting."""
        out = set()
        for bucket, held in self.buckets(name).items():
            rows, dead = sum(p[1] for p in held["parts"]), sum(g[2] for g in held["gone"])
            if len(held["parts"]) > most_parts or dead > dead_share * rows or (rows - dead > self.capacity and _bits(bucket)[0] < MAX_DEPTH and not held["one"]):
                out.add(bucket)
        return out

    def compact(self, name: str, buckets: Iterable[str] | None = None, counters: dict | None = None) -> int:
        """Rewrites buckets (the worn ones by default) as one part each and splits those above the capacity; how many."""
        spec, held = self.specs[name], self.buckets(name)
        chosen = self.worn(name) if buckets is None else set(buckets) & set(held)
        if not chosen and not counters:
            return 0
        rows = {b: sum(p[1] for p in held[b]["parts"]) - sum(g[2] for g in held[b]["gone"]) for b in chosen}
        full = [b for b in chosen if rows[b] > self.capacity]
        # A bucket is split into as many as its rows need, but no more than it has values.
        values = self.read(name, buckets=full).groupBy(bucket_of(F.col(spec.by), held).alias("b")).agg(F.count_distinct(F.hash(spec.by)).alias("n")).collect() if full else []
        values, made = {r.b: r.n for r in values}, []
        for bucket in chosen:
            depth, bits = _bits(bucket)
            deeper = min(MAX_DEPTH, depth + ceil(log2(max(1, min(rows[bucket] / self.capacity, values.get(bucket, 1))))))
            made += [(f"{deeper}-{bits + (i << depth)}", values.get(bucket, 2) == 1) for i in range(1 << (deeper - depth))]
        stays = set(held) - chosen
        folder, found = self._write(self.read(name, buckets=chosen, seq=True), spec.by, stays | {b for b, _ in made})
        sizes = self._sized(name, folder, f"{spec.schema}, {SEQ} bigint", found)
        edits = [{"table": name, "bucket": b, "left": True} for b in chosen]
        edits += [{"table": name, "bucket": b, "one": one, "parts": [[f"{folder}/{BUCKET}={b}", sizes[b]]] if b in sizes else []} for b, one in sorted(made)]
        try:
            self._commit(edits, counters or {}, None)
        except Exception:
            self.folder.delete(folder)
            raise
        return len(chosen)
