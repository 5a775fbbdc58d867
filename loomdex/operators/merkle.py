"""The hash tree over paths: node tables, bottom-up folder hashes, snapshot diff, renames and orphans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions import text
from loomdex.functions.hashing import content_hash, sha256_hex
from loomdex.operators.store import under
from loomdex.scratch import written

HASHES: dict[str, Callable[[Column], Column]] = {"xxh64": content_hash, "sha256": sha256_hex}


def child_key(path: Column, digest: Column) -> Column:
    """What a child adds to its folder's hash: length in UTF-16 units, path and hash."""
    return F.concat_ws(":", text.utf16_length(path).cast("string"), path, digest)


def combine(children: Column, digest: str) -> Column:
    """The hash of an array of (path, hash), in binary order of paths."""
    return HASHES[digest](F.array_join(F.transform(F.array_sort(children), lambda c: child_key(c["path"], c["hash"])), ""))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/", -1))


NODES = ("path", "hash", "parentPath", "isDirectory")

#: The children of folders (first column, '' for the top) in some tree; nodes with parentPath '' at the top.
Children = Callable[[DataFrame], DataFrame]


def children_in(nodes: DataFrame) -> Children:
    """Reads a tree that is one table; a stored tree reads only the buckets of the folders (``ChunkStore.tree``)."""
    held = nodes.select("path", "hash", F.coalesce("parentPath", F.lit("")).alias("parentPath"), "isDirectory")
    return lambda parents: held.join(parents.select(F.col(parents.columns[0]).alias("parentPath")).distinct(), "parentPath", "left_semi").select(*NODES)


def _top(path: Column) -> Column:
    """A path's folder, '' at the top."""
    return F.coalesce(text.dirname(path), F.lit(""))


def _folders(children: DataFrame, digest: str) -> DataFrame:
    """The folders of nodes (parentPath not ''), hashed over these."""
    up = children.where("parentPath <> ''").groupBy("parentPath").agg(F.collect_list(F.struct("path", "hash")).alias("c"))
    return up.select(F.col("parentPath").alias("path"), combine(F.col("c"), digest).alias("hash"), _top(F.col("parentPath")).alias("parentPath"), F.lit(True).alias("isDirectory"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.select("path", "hash", F.nullif("parentPath", F.lit("")).alias("parentPath"), "isDirectory")


def build(files: DataFrame, digest: str = "xxh64") -> DataFrame:
    """(path, hash, parentPath, isDirectory) of all files (path, hash) and the folders above them.

    Deepest level first: each level's folders are one aggregation over that level's nodes,
    written once before the next one reads them.
    """
    leaves = written(files.select("path", "hash", _top(F.col("path")).alias("parentPath"), F.lit(False).alias("isDirectory"), depth(F.col("path")).alias("depth")))
    levels = leaves.agg(F.max("depth").alias("d")).first().d or 0
    made: list[DataFrame] = []
    for d in range(levels, 1, -1):
        level = leaves.where(F.col("depth") == d).select(*NODES)
        made.append(written(_folders(level.unionByName(made[-1]) if made else level, digest).select(*NODES)))
    return _nodes(_union([leaves.select(*NODES), *made]))


def root_hash(nodes: DataFrame, digest: str = "xxh64") -> DataFrame:
    """One row: the hash over nodes without a parent, null for an empty tree."""
    top = nodes.where("parentPath is null").agg(F.collect_list(F.struct("path", "hash")).alias("c"))
    return top.select(F.when(F.size("c") > 0, combine(F.col("c"), digest)).alias("rootHash"))


def expand(folders: DataFrame, children: Children) -> DataFrame:
    """All nodes below folders (path), with root: the folder given. Opened level by level, each written once."""
    frontier, found = folders.select("path", F.col("path").alias("root")), []
    while True:
        below = children(frontier.select("path"))
        level = written(below.join(frontier.select(F.col("path").alias("parentPath"), "root").distinct(), "parentPath").select(*NODES, "root"))
        found.append(level)
        frontier = level.where("isDirectory").select("path", "root")
        if frontier.isEmpty():
            return _union(found)


def delta(children: Children, changed: DataFrame, removed: DataFrame | None = None, moves: DataFrame | None = None, digest: str = "xxh64") -> tuple[DataFrame, DataFrame]:
    """(nodes that come or change, nodes (path, parentPath) that go) when subtrees or files move (oldPath, newPath), paths
    and all below them are removed (path), and files change (path, hash), in this order.

    Moved files keep their hashes under rewritten keys. Then the dirty folders, those above
    anything that came or went, are hashed again: deepest level first, from their stored
    children less what went and the level below, which is written by then. Only children of
    dirty folders and the subtrees that go are read, and the plan of a level does not
    contain those below, so it grows by the depth at most. Folders without children go.
    """
    spark = changed.sparkSession
    parent = _top(F.col("path")).alias("parentPath")
    if removed is None and moves is None:
        gone = spark.createDataFrame([], "path string, hash string, parentPath string, isDirectory boolean, root string")
        files = written(changed.select("path", "hash", parent, F.lit(False).alias("isDirectory")).dropDuplicates(["path"]))
    else:
        clean = lambda c: F.regexp_replace(c, "/+$", "")
        moved = written((moves if moves is not None else spark.createDataFrame([], "oldPath string, newPath string")).select(clean("oldPath").alias("oldPath"), clean("newPath").alias("newPath")).where("oldPath <> newPath").distinct())
        lost = (removed.select(clean("path").alias("path")) if removed is not None else spark.createDataFrame([], "path string")).distinct()
        roots = lost.unionByName(moved.select(F.col("oldPath").alias("path"))).distinct()
        # The named nodes themselves are children of their folders.
        named = children(roots.select(_top(F.col("path")))).join(roots, "path", "left_semi").withColumn("root", F.col("path"))
        gone = written(named.select(*NODES, "root").unionByName(expand(roots, children)))
        came = gone.where("not isDirectory").join(moved.withColumnRenamed("oldPath", "root"), "root")
        came = came.select(F.concat("newPath", F.expr("substring(path, length(root) + 1)")).alias("path"), "hash")
        if removed is not None:
            came = delete_subtrees(came, lost)
        new = changed.select("path", "hash").withColumn("__age", F.lit(1)).unionByName(came.withColumn("__age", F.lit(0)))
        files = written(new.groupBy("path").agg(F.max_by("hash", "__age").alias("hash")).select("path", "hash", parent, F.lit(False).alias("isDirectory")))
    touched = files.select("path").unionByName(gone.where("path = root").select("path"))
    dirty = written(touched.select(F.explode(text.ancestors(F.col("path"))).alias("path")).distinct().withColumn("depth", depth(F.col("path"))))
    away = gone.select("path").unionByName(files.select("path")).unionByName(dirty.select("path"))
    made: list[DataFrame] = []
    for d in range(dirty.agg(F.max("depth").alias("d")).first().d or 0, 0, -1):
        level = dirty.where(F.col("depth") == d).select(F.col("path").alias("parentPath"))
        fresh = files if not made else files.unionByName(made[-1])
        below = children(level).join(away, "path", "left_anti").unionByName(fresh.join(level, "parentPath", "left_semi").select(*NODES))
        made.append(written(_folders(below, digest).select(*NODES)))
    upserts = _union([files.select(*NODES), *made])
    out = gone.select("path", "parentPath").unionByName(dirty.select("path", _top(F.col("path")).alias("parentPath"))).distinct()
    return _nodes(upserts), out.join(upserts, "path", "left_anti")


def update(nodes: DataFrame, changed: DataFrame, removed: DataFrame | None = None, digest: str = "xxh64", moves: DataFrame | None = None) -> DataFrame:
    """The tree after ``delta``'s changes, as one table; only folders above them are hashed again."""
    upserts, gone = map(written, delta(children_in(nodes), changed, removed, moves, digest))
    stays = nodes.select(*NODES).join(upserts.select("path").unionByName(gone.select("path")), "path", "left_anti")
    return stays.unionByName(upserts)


def descend(spark: SparkSession, old: Children, new: Children) -> DataFrame:
    """(path, change) of the files that differ between two trees: added, modified or deleted.

    From the top down; only folders whose hashes differ, or that one tree lacks, are
    opened, so what is read follows the changes and not the trees.
    """
    frontiers, found = [spark.createDataFrame([("",)], "path string")] * 2, []
    while True:
        a, b = (tree(frontier).select("path", F.col("hash").alias(f"{side}_hash"), F.col("isDirectory").alias(f"{side}_folder")) for tree, frontier, side in zip((old, new), frontiers, "ab"))
        level = written(a.join(b, "path", "full_outer").where(~(F.col("a_hash").eqNullSafe(F.col("b_hash")) & F.col("a_folder").eqNullSafe(F.col("b_folder")))))
        was, now = F.coalesce(~F.col("a_folder"), F.lit(False)), F.coalesce(~F.col("b_folder"), F.lit(False))
        found.append(level.where(was | now).select("path", F.when(was & now, "modified").when(was, "deleted").otherwise("added").alias("change")))
        frontiers = [level.where(f"{side}_folder").select("path") for side in "ab"]
        if level.where("a_folder or b_folder").isEmpty():
            return _union(found)


def children(nodes: DataFrame, path: str | None) -> DataFrame:
    return nodes.where(F.col("parentPath").isNull() if path is None else F.col("parentPath") == path).orderBy("path")


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(under(F.col("path"), path)).orderBy("path")


def delete_subtrees(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes that are none of the paths (path) and below none; an equality join of each node's own path and ancestors."""
    lead = nodes.select("path", F.explode(F.array_append(text.ancestors(F.col("path")), F.col("path"))).alias("g"))
    gone = lead.join(paths.select(F.regexp_replace("path", "/+$", "").alias("g")).distinct(), "g", "left_semi").select("path").distinct()
    return nodes.join(gone, "path", "left_anti")


def rename_node(nodes: DataFrame, old: str, new: str, digest: str) -> DataFrame:
    """Moves one node, keeps isDirectory, and takes the given hash and the new parent."""
    hit = F.col("path") == old
    moved = nodes.where(hit).select(F.lit(new).alias("path"), F.lit(digest).alias("hash"), text.dirname(F.lit(new)).alias("parentPath"), "isDirectory")
    return nodes.where(~hit & (F.col("path") != new)).unionByName(moved)


def prune_empty(nodes: DataFrame) -> DataFrame:
    """Drops folders without any file below: those that no file's path leads through."""
    needed = nodes.where("not isDirectory").select(F.explode(text.ancestors(F.col("path"))).alias("path")).distinct()
    return nodes.where("not isDirectory").unionByName(nodes.where("isDirectory").join(needed, "path", "left_semi"))


def collect_orphans(nodes: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphaned file paths, the nodes that stay): files of the tree that are not on disk go, then empty folders."""
    orphans = nodes.where("not isDirectory").join(present.select("path"), "path", "left_anti").select("path")
    return orphans, prune_empty(nodes.join(orphans, "path", "left_anti"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged, for file tables (path, hash)."""
    a = old.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("now"))
    joined = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("modified")
    return joined.select("path", change.alias("change"))


def reconciliation(changes: DataFrame) -> DataFrame:
    """One row of counts by kind of change."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "unchanged")])


def rename_pairs(events: DataFrame) -> DataFrame:
    """(oldPath, newPath, contentHash, oldSeq, newSeq): the k-th deletion with a hash and the k-th addition with it."""
    w = Window.partitionBy("contentHash", "type").orderBy("seq", "filePath")
    known = events.where(F.col("contentHash").isNotNull() & (F.col("contentHash") != "") & F.col("type").isin("deleted", "added")).withColumn("k", F.row_number().over(w))
    gone = known.where("type = 'deleted'").select("contentHash", "k", F.col("filePath").alias("oldPath"), F.col("seq").alias("oldSeq"))
    come = known.where("type = 'added'").select("contentHash", "k", F.col("filePath").alias("newPath"), F.col("seq").alias("newSeq"))
    return gone.join(come, ["contentHash", "k"]).select("oldPath", "newPath", "contentHash", "oldSeq", "newSeq")


def apply_renames(events: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(renames whose old path the store holds, events that no such rename used up)."""
    pairs = rename_pairs(events)
    usable = pairs.join(chunks.select(F.col("filePath").alias("oldPath")).distinct(), "oldPath", "left_semi")
    ends = F.array(*[F.struct(F.col(f"{side}Seq").alias("seq"), F.col(f"{side}Path").alias("filePath")) for side in ("old", "new")])
    used = usable.select(F.explode(ends).alias("x")).select("x.seq", "x.filePath")
    return usable, events.join(used, ["seq", "filePath"], "left_anti").select(*events.columns)
