"""Trees: listings, lookups, manifests, their differences and the directories they imply."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.functions import paths as P
from revlake.operators.staging import cut
from revlake.sources.views import DIRECTORY, EXECUTABLE, REGULAR

SEARCHABLE = (REGULAR, EXECUTABLE)
#: Page sizes of a directory listing: asked for as 0, and at most.
PAGE, LARGEST_PAGE = 1000, 10_000


def clamp_page(asked: int, default: int = PAGE, most: int = LARGEST_PAGE) -> int:
    return default if asked <= 0 else min(asked, most)


def walk_tree(entries: DataFrame, root: str = "") -> DataFrame:
    """Searchable files (regular and executable) at or below ``root``."""
    return entries.where(F.col("mode").isin(*SEARCHABLE) & P.within_scope("path", root))


def walk_paths(entries: DataFrame, root: str = "") -> DataFrame:
    """Everything but directories, links included."""
    return entries.where((F.col("mode") != DIRECTORY) & P.within_scope("path", root))


def with_directories(entries: DataFrame) -> DataFrame:
    """Entries with the directories they imply: ``path, mode, oid, size``."""
    dirs = entries.select(F.explode(P.ancestors_of("path")).alias("path")).distinct()
    return entries.select("path", "mode", "oid", "size").unionByName(dirs.select("path", F.lit(DIRECTORY).alias("mode"), F.lit(None).cast("string").alias("oid"), F.lit(0).cast("long").alias("size")))


def list_directory(entries: DataFrame, directory: str, after: str = "", limit: int = 0) -> DataFrame:
    """One level in tree order, strictly after a sort key: ``name, mode, sort_key``.

    A sub-directory is one row however much lies below it; the aggregation is partial before the shuffle and the
    page is a top-k.
    """
    prefix = directory + "/" if directory else ""
    below = entries.where(P.within_scope("path", directory) & (F.col("path") != directory))
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    name = F.substring_index(rest, "/", 1)
    level = below.groupBy(name.alias("name")).agg(F.max(F.when(F.instr(rest, "/") > 0, DIRECTORY).otherwise(F.col("mode"))).alias("m"), F.bool_or(F.instr(rest, "/") > 0).alias("d"))
    level = level.select("name", F.when(F.col("d"), DIRECTORY).otherwise(F.col("m")).cast("int").alias("mode"), P.sort_key("name", F.col("d") | (F.col("m") == DIRECTORY)).alias("sort_key"))
    return level.where(F.col("sort_key") > after).orderBy("sort_key").limit(clamp_page(limit))


def list_tree(entries: DataFrame, most: int) -> DataFrame:
    """``path, directory, page``: whole directories in depth-first order, a page ending with the directory that fills it.

    A page closes with the directory at which its entries reach ``most``, so where pages close depends on all directories
    before.  Each range of directories tells for every number of entries its first page may already hold (0 to ``most - 1``)
    how many its last page holds and how many pages close; these tables, one a range, are chained in order, and each range
    numbers its pages from where the range before it ended.
    """
    every = with_directories(entries).select("path", P.parent_of("path").alias("directory"))
    counts = every.groupBy("directory").agg(F.count("*").alias("n")).select("directory", "n", F.replace("directory", F.lit("/"), F.lit("\0")).alias("order"))  # a directory before what is below it
    dealt = cut(counts.repartitionByRange("order").select("directory", "n", "order", F.spark_partition_id().cast("long").alias("part")))

    def closings(key, rows):
        held, pages = _closings(rows.sort_by("order").column("n").to_pylist(), most)
        return pa.table({"part": [key[0].as_py()], "held": [held], "pages": [pages]})

    def chain(batches):
        at = page = 0
        for batch in batches:
            starts = []
            for part, held, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts.append({"part": part, "at": at, "page": page})
                at, page = held[at], page + pages[at]
            yield pa.RecordBatch.from_pylist(starts, schema=pa.schema([(c, pa.int64()) for c in ("part", "at", "page")]))

    def number(key, rows):
        rows = rows.sort_by("order")
        at, page = rows.column("at")[0].as_py(), rows.column("page")[0].as_py()
        pages = []
        for n in rows.column("n").to_pylist():
            pages.append(page)
            at += n
            if at >= most:
                at, page = 0, page + 1
        return pa.table({"directory": rows.column("directory"), "page": pa.array(pages, pa.int64())})

    ranges = cut(dealt.groupBy("part").applyInArrow(closings, "part long, held array<long>, pages array<long>"))
    starts = ranges.coalesce(1).sortWithinPartitions("part").mapInArrow(chain, "part long, at long, page long")  # a row per range
    paged = dealt.join(F.broadcast(starts), "part").groupBy("part").applyInArrow(number, "directory string, page long")
    return every.join(paged, "directory").select("path", "directory", "page")


def _closings(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of entries held at first, 0 to ``most - 1``: the entries held at last and the pages closed."""
    held, pages = np.arange(most), np.zeros(most, np.int64)
    closed, state = np.zeros(most, np.int64), np.arange(most)
    for n in sizes:
        held = held + n
        full = held >= most
        if not full.any():
            continue
        pages, held = pages + full, np.where(full, 0, held)
        kinds, to = np.unique(held, return_inverse=True)
        if len(kinds) < len(held):
            # starts that hold the same from here on are followed as one
            closed, state = closed + pages[state], to[state]
            held, pages = kinds, np.zeros(len(kinds), np.int64)
    return held[state], closed + pages[state]


def lookup(entries: DataFrame, paths: list[str]) -> DataFrame:
    """Many point look-ups in input order, a row each: the entry, or why there is none."""
    asked = entries.sparkSession.createDataFrame(list(enumerate(paths)), "pos int, path string")
    found = asked.join(entries.select("path", "mode", "oid", "size"), "path", "left")
    error = F.coalesce(P.condition("path"), F.when(F.col("mode").isNull(), "not found"))
    return found.select("pos", "path", "mode", "oid", "size", error.alias("error")).orderBy("pos")


def build_manifest(entries: DataFrame) -> DataFrame:
    """Searchable files, a row per path, sorted inside partitions so that range filters prune."""
    return walk_tree(entries).select("path", "mode", "blob_key").dropDuplicates(["path"]).sortWithinPartitions("path")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns one manifest into another: ``path, action, oid, mode``; no renames; unsearchable counts as removed."""
    a = old.select("path", F.col("oid").alias("o1"), F.col("mode").alias("m1"))
    b = new.select("path", F.col("oid").alias("o2"), F.col("mode").alias("m2"))
    j = a.join(b, "path", "full_outer").where(~(F.col("o1").eqNullSafe(F.col("o2")) & F.col("m1").eqNullSafe(F.col("m2"))))
    kept = F.col("m2").isin(*SEARCHABLE)
    was = F.col("m1").isin(*SEARCHABLE)
    action = F.when(kept, "upserted").when(was, "removed")
    return j.select("path", action.alias("action"), F.when(kept, F.col("o2")).alias("oid"), F.when(kept, F.col("m2")).alias("mode")).where("action is not null")


def apply_delta(old: DataFrame, changes: DataFrame) -> DataFrame:
    """A manifest with upserts and removals applied: ``path, oid, mode``."""
    kept = old.select("path", "oid", "mode").join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.where("action = 'upserted'").select("path", "oid", "mode"))


def diff(old: DataFrame, new: DataFrame, similar: int | None = None) -> DataFrame:
    """``path, old_path, status, old_mode, new_mode``: A, M, D, T, and R for a rename.

    A rename joins a deletion and an addition of equal content; among several the least paths pair up in order.  With ``similar``
    (hundredths of the larger file; both sides need ``content``) what is left is joined by similarity, and ``similarity`` is told.
    """
    if similar is not None:
        from revlake.operators.renames import with_similar

        return with_similar(diff(old, new), old, new, similar)
    a = old.select("path", F.col("oid").alias("o1"), F.col("mode").alias("m1"))
    b = new.select("path", F.col("oid").alias("o2"), F.col("mode").alias("m2"))
    j = a.join(b, "path", "full_outer").where(~(F.col("o1").eqNullSafe(F.col("o2")) & F.col("m1").eqNullSafe(F.col("m2"))))
    kind = lambda m: F.shiftright(m, 12)
    rank = lambda o: F.row_number().over(Window.partitionBy(o).orderBy("path"))
    gone = j.where("o2 is null").select("path", "o1", "m1", rank("o1").alias("k"))
    come = j.where("o1 is null").select(F.col("path").alias("to"), "o2", "m2", F.row_number().over(Window.partitionBy("o2").orderBy("path")).alias("k2"))
    pairs = gone.join(come, (F.col("o1") == F.col("o2")) & (F.col("k") == F.col("k2")), "full_outer")
    moved = pairs.select(
        F.coalesce("to", "path").alias("path"),
        F.when(F.col("to").isNotNull(), F.col("path")).alias("old_path"),
        F.when(F.col("to").isNull(), "D").when(F.col("path").isNull(), "A").otherwise("R").alias("status"),
        F.col("m1").alias("old_mode"),
        F.col("m2").alias("new_mode"),
    )
    same = j.where("o1 is not null and o2 is not null").select(
        "path", F.lit(None).cast("string").alias("old_path"), F.when(kind("m1") != kind("m2"), "T").otherwise("M").alias("status"), F.col("m1").alias("old_mode"), F.col("m2").alias("new_mode")
    )
    return same.unionByName(moved)


def recursive_counts(entries: DataFrame) -> DataFrame:
    """``path, entries``: files below each directory, at any depth; the root counts all."""
    every = F.concat(F.array(F.lit("")), P.ancestors_of("path"))
    return entries.select(F.explode(every).alias("path")).groupBy("path").agg(F.count("*").alias("entries"))


def front_coded(paths: DataFrame) -> DataFrame:
    """``path, shared, suffix``: each path as what it shares with the one before and the rest.

    The window is per top-level directory, so no task orders the whole table; the first path of each shares nothing.
    """
    before = F.lag("path").over(Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("path"))
    p, q = F.col("path"), F.coalesce("before", F.lit(""))
    n = F.least(F.length(p), F.length(q))
    differs = F.array_position(F.zip_with(F.split(F.substring(p, F.lit(1), n), ""), F.split(F.substring(q, F.lit(1), n), ""), lambda x, y: x == y), False)
    shared = F.when(n == 0, F.lit(0)).when(differs == 0, n).otherwise(differs - 1).cast("int")
    return paths.select("path", before.alias("before")).select("path", shared.alias("shared"), F.substring(p, shared + 1, F.length(p)).alias("suffix"))


def written_tree(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A new tree from a base, upserts and deletes (``path, action, oid, mode``); deleting a directory deletes below it."""
    gone = changes.where("action = 'delete'").select(F.col("path").alias("gone"))
    up = changes.where("action = 'upsert'").select("path", "oid", "mode")
    own = F.concat(P.ancestors_of("path"), F.array("path"))
    hit = base.select("path", F.explode(own).alias("gone")).join(gone, "gone", "left_semi").select("path").distinct()
    kept = base.select("path", "oid", "mode").join(hit, "path", "left_anti").join(up.select("path"), "path", "left_anti")
    return kept.unionByName(up)
