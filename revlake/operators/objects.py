"""Object ids of trees and commits: directories are hashed level by level from the deepest, each from its sorted entries.

A level is one grouping over the directories of that depth; a directory's entries meet in one row, as its object holds them all.
Trees with the same id have the same files below, so a comparison goes down only where ids differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions import history as H
from revlake.functions import paths as P
from revlake.functions.paths import col
from revlake.operators.staging import cut

DIRECTORY = 0o40000


def _hex(text: Column) -> Column:
    return F.hex(text.cast("binary"))


def _object(kind: str, body: Column) -> Column:
    """The id of an object from the hexadecimal digits of its body."""
    head = F.concat(F.lit(f"{kind} "), (F.length(body) / 2).cast("long").cast("string"))
    return F.concat(F.lit("sha1:"), F.sha1(F.unhex(F.concat(_hex(head), F.lit("00"), body))))


def trees(files: DataFrame) -> DataFrame:
    """``path, oid`` of every directory above ``files`` (``path, oid, mode``), the root with an empty path.

    A path that is a file and a directory at once is no tree; no files give the empty root.
    """
    entry = ["dir", "name", "mode", "oid"]
    rows = cut(files.select(P.parent_of("path").alias("dir"), P.file_name("path").alias("name"), F.col("mode").cast("long").alias("mode"), "oid", P.depth("path").alias("depth")))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(1))).first()[0]
    out, below = None, None
    for level in range(deepest, 0, -1):
        own = rows.where(F.col("depth") == level).select(entry)
        if below is not None:
            own = own.unionByName(below.select(P.parent_of("path").alias("dir"), P.file_name("path").alias("name"), F.lit(DIRECTORY).cast("long").alias("mode"), "oid"))
        below = cut(_hashed(own))
        out = below if out is None else out.unionByName(below)
    root = out.sparkSession.createDataFrame([("",)], "path string")
    empty = root.join(out, "path", "left_anti").select("path", _object("tree", F.lit("")).alias("oid"))
    return out.unionByName(empty)


def _hashed(entries: DataFrame) -> DataFrame:
    """``path, oid`` of the directories of ``dir, name, mode, oid``."""
    line = F.concat(_hex(F.concat(F.conv(F.col("mode").cast("string"), 10, 8), F.lit(" "), "name")), F.lit("00"), F.upper(F.element_at(F.split("oid", ":"), 2)))
    key = P.sort_key("name", F.col("mode") == DIRECTORY)
    held = entries.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct(key.cast("binary").alias("key"), line.alias("line")))).alias("lines"))  # one directory's entries
    return held.select(F.col("dir").alias("path"), _object("tree", F.array_join(F.col("lines.line"), "")).alias("oid"))


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path`` of directories whose trees differ, of two tables of ``trees``: the only ones a comparison has to enter."""
    a, b = old.select("path", F.col("oid").alias("o1")), new.select("path", F.col("oid").alias("o2"))
    return a.join(b, "path", "full_outer").where(~F.col("o1").eqNullSafe(F.col("o2"))).select("path")


def commit_oid(tree: Column | str, parents: Column | str, who: dict[str, Column], message: Column | str) -> Column:
    """The id of a commit; ``who`` has ``author_name, author_email, author_secs, author_tz`` and the same of the committer."""

    def line(role: str) -> Column:
        stamp = F.concat(who[f"{role}_secs"].cast("string"), F.lit(" "), H.offset(who[f"{role}_tz"]))
        return F.concat(F.lit(f"{role} "), who[f"{role}_name"], F.lit(" <"), who[f"{role}_email"], F.lit("> "), stamp, F.lit("\n"))

    bare = lambda x: F.element_at(F.split(x, ":"), 2)
    above = F.array_join(F.transform(col(parents), lambda p: F.concat(F.lit("parent "), bare(p), F.lit("\n"))), "")
    return _object("commit", _hex(F.concat(F.lit("tree "), bare(col(tree)), F.lit("\n"), above, line("author"), line("committer"), F.lit("\n"), col(message))))
