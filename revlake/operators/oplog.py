"""Operation logs with renames of files and whole directories.

Operations depend on each other across paths only through renames.  So each operation is first told which file it is about: its path
is followed back through the renames before it to where the file was when the log began (or, where another file had been moved away
before, to that path and moment).  That is the file's identity; operations fold by identity, each apart from the others,
and following an identity forward through the renames gives the path it ends at, or the rename that replaced it.
Every row is followed by itself, so a log is spread over the cluster however it jumps between directories; only the renames
go to every task, a counted number of them at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.operators.overlay import folded, kind_of
from revlake.operators.staging import cut

#: Renames that go to every task at a time.
RENAMES = 50_000


class Renames:
    """Renames in order, ``(seq, from, to)``, looked up by the directories of a path."""

    def __init__(self, moves: list[tuple[int, str, str]]):
        self.at: dict[str, list[tuple[int, bool, str]]] = {}
        for seq, source, target in moves:
            self.at.setdefault(source, []).append((seq, False, target))
            self.at.setdefault(target, []).append((seq, True, source))

    def _touching(self, path: str) -> Iterator[tuple[list[tuple[int, bool, str]], str]]:
        """The renames from or to each directory of a path and the path itself, with what of the path lies below."""
        if hit := self.at.get(path):
            yield hit, ""
        cut_ = path.rfind("/")
        while cut_ > 0:
            if hit := self.at.get(path[:cut_]):
                yield hit, path[cut_:]
            cut_ = path.rfind("/", 0, cut_)

    def back(self, path: str, seq: int) -> tuple[str, int, bool]:
        """Where what is at ``path`` before ``seq`` was before these renames; if nothing was, where and since when it is."""
        while True:
            best = None
            for events, rest in self._touching(path):
                k = bisect_left(events, (seq,)) - 1
                if k >= 0 and (best is None or events[k][0] > best[0][0]):
                    best = events[k], rest
            if best is None:
                return path, seq, False
            (seq, into, other), rest = best
            if not into:
                return path, seq, True
            path = other + rest

    def forward(self, path: str, seq: int) -> tuple[str, int, int | None]:
        """Where what is at ``path`` after ``seq`` goes, the last rename that moved it, and the one that replaced it."""
        while True:
            best = None
            for events, rest in self._touching(path):
                k = bisect_right(events, (seq, True, "\U0010ffff"))
                if k < len(events) and (best is None or events[k][0] < best[0][0]):
                    best = events[k], rest
            if best is None:
                return path, seq, None
            (at, into, other), rest = best
            if into:
                return path, seq, at
            path, seq = other + rest, at


def _chunks(log: DataFrame) -> list[list[tuple[int, str, str]]]:
    """The renames in order, some at a time; they are what every task needs."""
    moves = log.where("op = 'rename'").select(F.col("seq").cast("long"), "path", "to").orderBy("seq")
    out: list[list[tuple[int, str, str]]] = [[]]
    for r in moves.toLocalIterator():
        if len(out[-1]) >= RENAMES:
            out.append([])
        out[-1].append((r[0], r[1], r[2]))
    return out


def _followed(rows: DataFrame, chunks: list[list[tuple[int, str, str]]], back: bool) -> DataFrame:
    """``rows`` with the columns that following ``place, since`` through the renames gives; a pass for each chunk."""
    import pyarrow as pa

    names = rows.columns
    state = ["place", "since", "stop"]
    kept = [c for c in names if c not in state]
    for moves in reversed(chunks) if back else chunks:
        shared = rows.sparkSession.sparkContext.broadcast(moves)

        def run(batches, shared=shared):
            renames = Renames(shared.value)
            for batch in batches:
                n = len(kept)
                out = []
                for place, since, stop in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                    if stop is None:
                        if back:
                            place, at, fixed = renames.back(place, since)
                            since, stop = at, at if fixed else None
                        else:
                            place, since, stop = renames.forward(place, since)
                    out.append((place, since, stop))
                columns = zip(*out, strict=True) if out else [[]] * 3
                made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*kept, *state])

        rows = rows.select(*kept, *state)
        rows = rows.mapInArrow(run, rows.schema)
    return rows


def fold_log(log: DataFrame, base: DataFrame) -> DataFrame:
    """Overlay rows of a log of operations that took effect: ``path, present, kind, mode, content, renamed_from, changed, moved``.

    ``log`` is ``path, seq, op, content, to`` and, for ``chmod``, ``mode``, with no ``seq`` (from 0) twice; ``rename`` moves what is at
    ``path``, and all that is below it, to ``to`` and replaces what is there.  The other operations are those of
    ``fold_operations``.  ``base`` is ``path, content`` and, where it has them, modes.  ``changed`` and ``moved`` are the ``seq`` of
    the last operation and rename of the file.  Base files that nothing touched have no row; a base path that ends
    without a file has one that is not present.
    """
    none = F.lit(None).cast("long")
    chunks = _chunks(log)
    ops = log.where("op <> 'rename'")
    traced = _followed(ops.withColumn("place", F.col("path")).withColumn("since", F.col("seq").cast("long")).withColumn("stop", none).drop("path", "to"), chunks, back=True)
    own = cut(traced.withColumn("born", F.coalesce("stop", F.lit(-1).cast("long"))).withColumnRenamed("place", "origin").drop("since", "stop"))
    key = ["origin", "born"]
    files = base.withColumnRenamed("path", "origin").withColumn("born", F.lit(-1).cast("long"))
    last = own.groupBy(*key).agg(F.max("seq").cast("long").alias("changed"))
    touched = folded(own, files, key).join(last, key)
    # base files without an operation may still be moved or replaced with their directory
    mode = F.col("mode").cast("int") if "mode" in base.columns else F.lit(0o100644)
    was = F.struct(F.col("content").cast("string").alias("content"), mode.alias("mode"))
    rest = files.join(own.select(*key).distinct(), key, "left_anti").select(*key, was.alias("now"), was.alias("was"), none.alias("changed"))
    every = touched.select(*key, "now", "was", "changed").unionByName(rest)
    ends = _followed(every.withColumn("place", F.col("origin")).withColumn("since", F.col("born")).withColumn("stop", none), chunks, back=False)
    moved = F.when(F.col("since") > F.col("born"), F.col("since"))
    ends = cut(ends.withColumn("moved", moved).where("changed is not null or moved is not null or stop is not null"))
    live = ends.where("now is not null and stop is null")
    source = F.when((F.col("place") != F.col("origin")) & F.col("was").isNotNull(), F.col("origin"))
    shown = live.select(F.col("place").alias("path"), F.lit(True).alias("present"), kind_of("now").alias("kind"), F.col("now.mode").alias("mode"), F.col("now.content").alias("content"), source.alias("renamed_from"), "changed", "moved")
    # base paths whose file went and where no other one came
    went = ends.where("was is not null and (now is null or stop is not null or place <> origin)").select(F.col("origin").alias("path"), "changed", "moved")
    gone = went.join(shown.select("path"), "path", "left_anti")
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("kind", "string"), ("mode", "int"), ("content", "string"), ("renamed_from", "string"))]
    return shown.unionByName(gone.select("path", F.lit(False).alias("present"), *blank, "changed", "moved"))
