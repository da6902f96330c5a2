"""A copy-on-write overlay over a base tree: resolution, merged views, status, commit plans, search placement.

Overlay rows are ``path, present, kind, opaque, oid, mode, size, renamed_from, base_oid, base_mode``.  A path is related to the rows
of its ancestors by exploding the ancestors and joining on equality, so containment never becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.functions import paths as P
from revlake.operators.staging import with_sum_before

REGULAR, SYMLINK, DIRECTORY = 0o100644, 0o120000, 0o40000
#: Fixed: names of vanished paths that are kept for a monitor.
MOST_VANISHED = 4096


def above(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, blocked, masked``: what the overlay rows of proper ancestors do to each path."""
    up = paths.select("path", F.explode(P.ancestors_of("path")).alias("dir"))
    hit = up.join(rows.select(F.col("path").alias("dir"), (~F.col("present") | (F.col("kind") != "directory")).alias("b"), "opaque"), "dir")
    return hit.groupBy("path").agg(F.bool_or("b").alias("blocked"), F.bool_or("opaque").alias("masked"))


def resolve(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, resolution``: ``absent``, ``overlay`` or ``base`` (to be looked up there)."""
    own = rows.select("path", "present")
    j = paths.select("path").distinct().join(above(paths.select("path").distinct(), rows), "path", "left").join(own, "path", "left")
    return j.select(
        "path",
        F.when(F.col("blocked"), "absent").when(F.col("present"), "overlay").when(~F.col("present"), "absent").when(F.col("masked"), "absent").otherwise("base").alias("resolution"),
    )


def merged(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, oid, mode, size, source``: the files of the whole merged tree."""
    from_base = resolve(base, rows).where("resolution = 'base'").join(base.select("path", "oid", "mode", "size"), "path").withColumn("source", F.lit("base"))
    files = rows.where("present and kind <> 'directory'")
    shown = resolve(files, rows).where("resolution = 'overlay'").join(files.select("path", "oid", "mode", "size"), "path").withColumn("source", F.lit("overlay"))
    columns = ["path", "oid", "mode", "size", "source"]
    return from_base.select(*columns).unionByName(shown.select(*columns))


def list_merged(base: DataFrame, rows: DataFrame, directory: str) -> DataFrame:
    """``name, verdict`` of one directory: ``keep`` from the base, ``replace`` and ``extra`` from the overlay, ``hide``."""
    prefix = directory + "/" if directory else ""
    name = F.substring_index(F.substring("path", len(prefix) + 1, 1 << 30), "/", 1)
    inside = P.within_scope("path", directory) & (F.col("path") != directory)
    below = base.where(inside).select(name.alias("name")).distinct().withColumn("in_base", F.lit(True))
    own = rows.where(inside & (P.parent_of("path") == directory)).select(P.file_name("path").alias("name"), "present")
    here = F.when(F.col("present"), F.when(F.col("in_base"), "replace").otherwise("extra")).when(~F.col("present"), "hide").otherwise("keep")
    masked = rows.where((F.col("path") == directory) & F.col("opaque")).limit(1).select(F.lit(True).alias("opaque"))
    j = below.join(own, "name", "full_outer").join(F.broadcast(masked), F.lit(True), "left")  # one row at most
    verdict = F.when(F.col("opaque") & (here == "keep"), "hide").otherwise(here)
    return j.select("name", verdict.alias("verdict"))


def status(rows: DataFrame) -> DataFrame:
    """``path, kind, from, old_mode, new_mode, old_oid, new_oid, new_size``: what the overlay changes, without what was
    written and written back."""
    sources = rows.where("present and renamed_from is not null").select(F.col("renamed_from").alias("path"))
    gone = resolve(sources, rows).where("resolution = 'absent'").select(F.col("path").alias("source"))
    deleted = rows.where("not present and base_oid is not null").join(gone, F.col("path") == F.col("source"), "left_anti")
    nothing = lambda kind: F.lit(None).cast(kind)
    out = deleted.select("path", F.lit("Deleted").alias("kind"), nothing("string").alias("from"), F.col("base_mode").alias("old_mode"), nothing("int").alias("new_mode"), F.col("base_oid").alias("old_oid"), nothing("string").alias("new_oid"), F.lit(0).cast("long").alias("new_size"))
    live = rows.where("present and kind <> 'directory'").join(gone, F.col("renamed_from") == F.col("source"), "left")
    link = lambda m: F.shiftright(m, 12) == SYMLINK >> 12
    kind = (
        F.when(F.col("source").isNotNull(), "Renamed")
        .when(F.col("base_oid").isNull(), "Added")
        .when((F.col("base_mode") == 0o40000) | (link("base_mode") != link("mode")), "TypeChanged")
        .when(F.col("base_oid") != F.col("oid"), "Modified")
        .when(F.col("base_mode") != F.col("mode"), "ModeChanged")
    )
    changed = live.select("path", kind.alias("kind"), F.when(F.col("source").isNotNull(), F.col("renamed_from")).alias("from"), F.col("base_mode").alias("old_mode"), F.col("mode").alias("new_mode"), F.col("base_oid").alias("old_oid"), F.col("oid").alias("new_oid"), F.col("size").alias("new_size"))
    return out.unionByName(changed.where("kind is not null"))


def directory_deletions(rows: DataFrame) -> DataFrame:
    """``path`` of deleted directories that no other row lies below."""
    dirs = rows.where("not present and kind = 'directory'").select("path")
    below = rows.select(F.explode(P.ancestors_of("path")).alias("path")).distinct()
    return dirs.join(below, "path", "left_anti")


def commit_plan(changes: DataFrame, deleted_dirs: DataFrame, base: DataFrame) -> DataFrame:
    """``path, action, oid, mode``: a rename deletes and upserts; a deleted directory deletes each base path below it."""
    steps = F.when(
        F.col("kind") == "Renamed",
        F.array(F.struct(F.col("from").alias("path"), F.lit("delete").alias("action")), F.struct("path", F.lit("upsert").alias("action"))),
    ).otherwise(F.array(F.struct("path", F.when(F.col("kind") == "Deleted", "delete").otherwise("upsert").alias("action"))))
    flat = changes.select(F.explode(steps).alias("s"), "new_oid", "new_mode")
    up = F.col("s.action") == "upsert"
    own = flat.select("s.path", "s.action", F.when(up, F.col("new_oid")).alias("oid"), F.when(up, F.col("new_mode")).alias("mode"))
    below = base.select("path", F.explode(P.ancestors_of("path")).alias("dir")).join(deleted_dirs.select(F.col("path").alias("dir")), "dir").select("path").distinct()
    return own.unionByName(below.select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("oid"), F.lit(None).cast("int").alias("mode")))


def place(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Base matches where the merged tree has them: renamed files move along, touched and masked paths drop out.

    A match follows a rename only where the renamed row still has the base's bytes (``base_bytes``).
    """
    moved = rows.where("present and renamed_from is not null and base_bytes").select(F.col("renamed_from").alias("path"), F.col("path").alias("to"))
    touched = rows.select("path", F.lit(True).alias("touched"))
    masks = rows.where("not present or opaque or kind <> 'directory'").select(F.col("path").alias("dir"))
    up = matches.select("path").distinct().select("path", F.explode(P.ancestors_of("path")).alias("dir"))
    hidden = up.join(masks, "dir", "left_semi").select("path", F.lit(True).alias("hidden")).distinct()
    j = matches.join(moved, "path", "left").join(touched, "path", "left").join(hidden, "path", "left")
    keep = F.col("to").isNotNull() | (F.col("touched").isNull() & F.col("hidden").isNull())
    return j.where(keep).withColumn("path", F.coalesce("to", "path")).drop("to", "touched", "hidden")


def with_base_bytes(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Overlay rows with ``base_bytes``: a renamed file that still has the content its source has in the base."""
    source = base.select(F.col("path").alias("renamed_from"), F.col("oid").alias("source_oid"))
    return rows.join(source, "renamed_from", "left").withColumn("base_bytes", F.coalesce(F.col("oid") == F.col("source_oid"), F.lit(False))).select(*rows.columns, "base_bytes")


def own_files(rows: DataFrame) -> DataFrame:
    """``path`` of the files whose bytes only the overlay has (of rows with ``base_bytes``) and that the merged tree shows."""
    files = rows.where("present and kind = 'file' and not base_bytes")
    return resolve(files, rows).where("resolution = 'overlay'").select("path")


def worktree(index: DataFrame, changes: DataFrame, deleted_dirs: DataFrame) -> DataFrame:
    """``path`` of the files a user sees: the index without what is deleted or moved away, with what is new."""
    gone = changes.where("kind = 'Deleted'").select("path").union(changes.where("kind = 'Renamed'").select("from"))
    dirs = deleted_dirs.select(F.col("path").alias("dir"))
    below = index.select("path", F.explode(P.ancestors_of("path")).alias("dir")).join(dirs, "dir", "left_semi").select("path")
    kept = index.select("path").join(gone, "path", "left_anti").join(below, "path", "left_anti")
    return kept.union(changes.where("kind in ('Added', 'Renamed')").select("path")).distinct()


def monitor_changes(changes: DataFrame, deleted_dirs: DataFrame, vanished: DataFrame) -> DataFrame:
    """``path``: a superset of what changed, directories with a slash behind, for a file monitor."""
    return (
        changes.select("path").union(changes.where("`from` is not null").select("from")).union(deleted_dirs.select(F.concat("path", F.lit("/")))).union(vanished.select("path")).distinct()
    )


def vanished(log: DataFrame, base: DataFrame) -> DataFrame:
    """``path``: paths whose last operation removed them and that the base never had.  ``log`` is ``path, seq, op``."""
    last = log.groupBy("path").agg(F.max_by("op", "seq").alias("op")).where("op = 'remove'")
    return last.select("path").join(base.select("path"), "path", "left_anti")


def vanished_overflow(log: DataFrame, base: DataFrame, most: int = MOST_VANISHED) -> DataFrame:
    """One row, ``overflow``: whether at any time more than ``most`` paths were vanished, so that names were dropped.

    ``log`` is ``path, seq, op`` with no ``seq`` twice; an empty log has not overflown.
    """
    own = log.join(base.select("path"), "path", "left_anti").select("path", "seq", (F.col("op") == "remove").cast("int").alias("gone"))
    step = F.col("gone") - F.coalesce(F.lag("gone").over(Window.partitionBy("path").orderBy("seq")), F.lit(0))
    turns = own.select("seq", step.alias("step")).where("step <> 0")
    return with_sum_before(turns, ["seq"], "step", "before").agg(F.coalesce(F.max(F.col("before") + F.col("step")) > most, F.lit(False)).alias("overflow"))


def monitor_answer(changed: DataFrame, overflow: DataFrame, generation: int, token: str) -> tuple[DataFrame, bool]:
    """``(changed, full_rescan)`` for a caller that saw ``token`` (``generation:sequence``): all must be looked at again
    where it saw another generation or names were dropped."""
    return changed, not token.startswith(f"{generation}:") or overflow.first()["overflow"]


def quota(rows: DataFrame, limit: int) -> DataFrame:
    """One row: ``used`` bytes of local content, and whether they are within the limit."""
    used = F.coalesce(F.sum(F.when(F.col("present") & ~F.col("oid").eqNullSafe(F.col("base_oid")), F.col("size"))), F.lit(0))
    return rows.agg(used.cast("long").alias("used")).withColumn("allowed", F.col("used") <= limit)


def folded(log: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """``key..., now, was``: what the operations of each key make of what it was; both are ``struct<content, mode>`` or null.

    ``log`` is ``key..., seq, op, content`` and, for ``chmod``, ``mode``; ``base`` is ``key..., content`` and, where it has them, modes.
    Every key of the log has a row.
    """
    mode = F.col("mode") if "mode" in log.columns else F.lit(None)
    base_mode = F.col("mode") if "mode" in base.columns else F.lit(REGULAR)
    steps = F.sort_array(F.collect_list(F.struct("seq", "op", "content", mode.cast("int").alias("mode"))))  # one file's operations
    was = base.select(*key, F.struct(F.col("content").cast("string").alias("content"), base_mode.cast("int").alias("mode")).alias("was"))
    rows = log.groupBy(*key).agg(steps.alias("s")).join(was, key, "left")
    held = lambda content, mode: F.struct(content.alias("content"), mode.cast("int").alias("mode"))
    text = lambda c: F.coalesce(c, F.lit(""))

    def step(acc, x):
        absent = acc.isNull()
        file = absent | ~F.coalesce(acc.mode, F.lit(0)).isin(DIRECTORY, SYMLINK)
        own = F.coalesce(acc.mode, F.lit(REGULAR))
        return (
            F.when((x.op == "create") & file, held(text(x.content), F.lit(REGULAR)))
            .when((x.op == "write") & file, held(text(x.content), own))
            .when((x.op == "append") & file, held(F.concat(text(acc.content), text(x.content)), own))
            .when((x.op == "truncate") & file, held(F.lit(""), own))
            .when((x.op == "chmod") & file & ~absent, held(acc.content, F.coalesce(x.mode, own)))
            .when((x.op == "symlink") & absent, held(text(x.content), F.lit(SYMLINK)))
            .when((x.op == "mkdir") & absent, held(F.lit(None).cast("string"), F.lit(DIRECTORY)))
            .when(x.op != "remove", acc)
        )

    return rows.select(*key, F.aggregate("s", F.col("was"), step).alias("now"), "was")


def kind_of(state: str):
    """``directory``, ``symlink``, ``file``, or null of a state that ``folded`` gives."""
    mode = F.col(f"{state}.mode")
    return F.when(mode == DIRECTORY, "directory").when(mode == SYMLINK, "symlink").when(F.col(state).isNotNull(), "file")


def fold_operations(log: DataFrame, base: DataFrame) -> DataFrame:
    """An operation log of one path each (``path, seq, op, content`` and, for ``chmod``, ``mode``) to overlay rows.

    ``create`` and ``write`` set a file's content, ``append`` adds to it, ``truncate`` empties it; each makes the file where there
    is none.  ``symlink`` (its target is the content) and ``mkdir`` need an absent path, ``chmod`` a file, and no content goes
    to a directory or link; what a path does not allow changes nothing.  ``remove`` whites out a base path and forgets any
    other.  Per path the log folds as an ordered array inside Spark; logs with renames are those of :mod:`revlake.operators.oplog`.
    ``base`` is ``path, content`` and, where it has them, modes.
    """
    out = folded(log, base, ["path"]).where("now is not null or was is not null")
    return out.select("path", F.col("now").isNotNull().alias("present"), kind_of("now").alias("kind"), F.col("now.mode").alias("mode"), F.col("now.content").alias("content"), F.coalesce(F.col("now") == F.col("was"), F.lit(False)).alias("unchanged"))
