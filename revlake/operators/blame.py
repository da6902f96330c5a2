"""Where the lines of a file come from, without gathering the file's history.

The edit script between two neighbouring versions says for each run of lines of the newer one whether it was there before and where.
Such mappings compose, and composing is associative: every pair of neighbours is compared by itself, wherever in the cluster, and
mappings of neighbouring stretches are joined two by two, so a file of n versions takes log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.staging import cut
from revlake.operators.textdiff import edit_script, split_lines

#: A mapping as runs of lines in order: how many, the version they come from (-1: the older end of the stretch), and the line there.
RUNS = "count array<int>, version array<long>, line array<int>"


def mapping(old: list[str], new: list[str], version: int) -> list[tuple[int, int, int]]:
    """Runs of the lines of ``new``: ``(count, -1, line of old)`` or ``(count, version, line)`` of lines that came with it."""
    out: list[list[int]] = []
    for op, i, j in edit_script(old, new):
        if op != "-":
            v, at = (-1, i) if op == " " else (version, j)
            if out and out[-1][1] == v and out[-1][2] + out[-1][0] == at:
                out[-1][0] += 1
            else:
                out.append([1, v, at])
    return [tuple(r) for r in out]


def composed(older: list[tuple[int, int, int]], newer: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The mapping over both stretches."""
    first = [0]
    for n, _, _ in older:
        first.append(first[-1] + n)
    out: list[list[int]] = []

    def put(n: int, v: int, at: int) -> None:
        if out and out[-1][1] == v and out[-1][2] + out[-1][0] == at:
            out[-1][0] += n
        else:
            out.append([n, v, at])

    from bisect import bisect_right

    for n, v, at in newer:
        if v >= 0:
            put(n, v, at)
            continue
        k = bisect_right(first, at) - 1
        while n:
            inside = at - first[k]
            take = min(n, older[k][0] - inside)
            put(take, older[k][1], older[k][2] + inside)
            n, at, k = n - take, at + take, k + 1
    return [tuple(r) for r in out]


def _arrow(rows: list[tuple], names: list[str], kinds: list, runs: list[list[tuple[int, int, int]]]):
    import pyarrow as pa

    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
    for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32())):
        columns.append(pa.array([[r[i] for r in rs] for rs in runs], pa.list_(kind)))
    return pa.RecordBatch.from_arrays(columns, names=[*names, "count", "version", "line"])


def _neighbours(versions: DataFrame) -> DataFrame:
    """``path, k, version, old, new``: each version that changes its file and the content before it; ``k`` counts from 0."""
    marked = versions.select("path", "version", F.xxhash64("content").alias("mark"), F.length("content").alias("size"))
    w = Window.partitionBy("path").orderBy("version")  # a narrow row for each version of a file
    before = F.struct(F.lag("mark").over(w), F.lag("size").over(w), F.lag("version").over(w).isNull())
    kept = marked.withColumn("changed", ~before.eqNullSafe(F.struct("mark", "size", F.lit(False)))).where("changed")
    order = cut(kept.select("path", "version", F.lag("version").over(w).alias("earlier"), (F.row_number().over(w) - 1).alias("k")))
    own = versions.select("path", "version", F.col("content").alias("new"))
    was = versions.select("path", F.col("version").alias("earlier"), F.col("content").alias("old"))
    return order.join(own, ["path", "version"]).join(was, ["path", "earlier"], "left").select("path", "k", "version", "old", "new")


def blame(versions: DataFrame) -> DataFrame:
    """``path, start, lines, version, orig_start``: for each run of lines of a file's last version, where they come from.

    ``versions`` is ``path, version, content`` with versions in order along first parents; null content is an empty file.
    A version that leaves its file as it was takes no part.
    """
    import pyarrow as pa

    def compare(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            runs = [mapping(split_lines(old or "")[0], split_lines(new or "")[0], version) for _, _, version, old, new in rows]
            yield _arrow([r[:2] for r in rows], ["path", "k"], [pa.string(), pa.int64()], runs)

    def join(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            runs = []
            for r in rows:
                older, newer = (list(zip(*r[i : i + 3], strict=True)) if r[i] is not None else None for i in (2, 5))
                runs.append(composed(older, newer) if newer is not None else older)
            yield _arrow([r[:2] for r in rows], ["path", "k"], [pa.string(), pa.int64()], runs)

    schema = f"path string, k long, {RUNS}"
    rows = versions.select("path", F.col("version").cast("long").alias("version"), F.coalesce("content", F.lit("")).alias("content"))
    now = cut(_neighbours(rows).select("path", F.col("k").cast("long").alias("k"), "version", "old", "new").mapInArrow(compare, schema))
    while not now.where("k > 0").isEmpty():
        half = F.floor(F.col("k") / 2)
        even = now.where("k % 2 = 0").select("path", half.alias("k"), "count", "version", "line")
        odd = now.where("k % 2 = 1").select("path", half.alias("k"), *[F.col(c).alias(f"{c}_") for c in ("count", "version", "line")])
        pairs = even.join(odd, ["path", "k"], "left").select("path", "k", "count", "version", "line", "count_", "version_", "line_")
        now = cut(pairs.mapInArrow(join, schema))
    return _started(now)


def _started(mapped: DataFrame) -> DataFrame:
    """A row for each run, with the line that it starts at."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for path, count, version, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 1
                for n, v, i in zip(count, version, line, strict=True):
                    out.append((path, at, n, v, i + 1))
                    at += n
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "lines", "version", "orig_start"])

    return mapped.select("path", "count", "version", "line").mapInArrow(run, "path string, start long, lines long, version long, orig_start long")
