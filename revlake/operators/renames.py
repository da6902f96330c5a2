"""Renames by similarity: which added file goes on with the content of which deleted one.

A file is its chunks (lines, those above 64 characters in pieces) with the bytes each takes.  Two files are similar by the bytes
of the chunks they share, in hundredths of the larger one.  A pair above the threshold shares so much that it must share one of
the rarest chunks of both, so only those are joined (prefix filtering).

A chunk that few files hold brings all of them together as pairs.  The holders of a common one (a licence line, what a group of copies
shares) are dealt into cells of at most about ``LOT`` files a side, and a task scores the files of a cell against each other, so the
files of a group are moved once for each cell of the other side and not once for each pair.  A pair counts where its
first common chunk is.  Every pair above the threshold is found; their number grows with the square of a group of like files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.staging import FEW, cut, drop, put

#: Fixed limits: hundredths that two files must share, characters of a chunk.
THRESHOLD, CHUNK = 50, 64


def chunks(files: DataFrame) -> DataFrame:
    """``path, chunk, bytes``: the different chunks (by hash) of ``path, content`` and how many bytes of the file each one takes."""
    parts = F.regexp_extract_all("content", F.lit(rf"([^\n]{{0,{CHUNK - 1}}}\n|[^\n]{{1,{CHUNK}}})"), 1)
    rows = files.where("content is not null").select("path", F.explode(parts).alias("part"))
    return rows.groupBy("path", F.xxhash64("part").alias("chunk")).agg(F.sum(F.octet_length("part")).alias("bytes"))


def _profile(rows: DataFrame, name: str, side: str) -> DataFrame:
    """A row for each file with its chunks and their bytes as arrays."""
    held = rows.groupBy(F.col("path").alias(name)).agg(F.array_sort(F.collect_list(F.struct("chunk", "bytes"))).alias("held"))  # one file's chunks
    return held.select(name, F.col("held.chunk").alias(f"{side}_chunk"), F.col("held.bytes").alias(f"{side}_bytes"))


#: Pairs of a chunk that are joined as such, about; files of a side in a cell.
RARE, LOT = 64, 64


def _first_chunks(rows: DataFrame, fan: DataFrame, threshold: int, name: str, size: str) -> DataFrame:
    """Of each file the rarest chunks, until what remains of it is too little for a similar pair."""
    whole = Window.partitionBy("path")  # the chunks of one file
    order = whole.orderBy("fan", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(fan, "chunk", "left").withColumn("fan", F.coalesce("fan", F.lit(0))).withColumn("size", F.sum("bytes").over(whole)).withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    return ranked.where((F.col("size") - F.col("before")) * 100 >= F.col("size") * threshold).where("fan > 0").select(F.col("path").alias(name), "chunk", "fan", F.col("size").alias(size))


def matched(gone: DataFrame, come: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``from, to, score``: one-to-one pairs of files (``path, content``) that share ``threshold`` hundredths of the larger one.

    Empty files are similar to none.
    """
    left, right = put(_profile(chunks(gone), "from", "u")), put(_profile(chunks(come), "to", "v"))
    a, b = (t.select(F.col(name).alias("path"), F.explode(F.arrays_zip(F.col(f"{s}_chunk").alias("chunk"), F.col(f"{s}_bytes").alias("bytes"))).alias("c")).select("path", "c.*") for t, name, s in ((left, "from", "u"), (right, "to", "v")))
    held = a.select("chunk", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("chunk", F.lit(0), F.lit(1)))
    fan = put(held.groupBy("chunk").agg((F.sum("x") * F.sum("y")).alias("fan")).where("fan > 0"))
    p, q = put(_first_chunks(a, fan, threshold, "from", "m")), put(_first_chunks(b, fan, threshold, "to", "n"))
    drop(fan)
    pairs = put(_met(p, q, threshold))
    rare, common = put(_scored(pairs, left, right, threshold)), put(_in_cells(p, q, left, right, threshold))
    drop(pairs, left, right, p, q)
    out = assigned(rare.union(common))
    drop(rare, common)
    return out


def _met(p: DataFrame, q: DataFrame, threshold: int) -> DataFrame:
    """``from, to, larger``: files that meet by a rare chunk and whose sizes allow for a pair."""
    few_ = F.col("fan") <= RARE
    both = p.where(few_).drop("fan").join(q.where(few_).drop("fan"), "chunk").where(F.least("m", "n") * 100 >= F.greatest("m", "n") * threshold)
    return both.groupBy("from", "to").agg(F.max(F.greatest("m", "n")).alias("larger"))


def _shared(x, u, y, v) -> int:
    """The bytes that two files have in common, of their chunks and the bytes these take."""
    import numpy as np

    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(u[i], v[j]).sum())


def _scored(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Those pairs whose files share enough, with the score."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept, scores = [], []
            larger = batch.column(2).to_pylist()
            for k, row in enumerate(zip(*(batch.column(i) for i in (3, 4, 5, 6)), strict=True)):
                shared = _shared(*(v.values.to_numpy(zero_copy_only=False) for v in row))
                if shared * 100 >= larger[k] * threshold:
                    kept.append(k)
                    scores.append(shared * 100 // larger[k])
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.int32())], names=["from", "to", "score"])

    both = pairs.join(left, "from").join(right, "to").select("from", "to", "larger", "u_chunk", "u_bytes", "v_chunk", "v_bytes")
    return both.mapInArrow(run, "from string, to string, score int")


def _in_cells(p: DataFrame, q: DataFrame, left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """``from, to, score`` of the similar files whose first chunk in common, in order of rarity, is a common one."""
    wide = F.col("fan") > RARE
    sides = p.where(wide).select("chunk", F.lit(1).alias("x"), F.lit(0).alias("y")).union(q.where(wide).select("chunk", F.lit(0), F.lit(1))).groupBy("chunk").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    lots = sides.where("x > 0 and y > 0").select("chunk", F.ceil(F.col("x") / LOT).alias("i_lots"), F.ceil(F.col("y") / LOT).alias("j_lots"))

    def deal(rows: DataFrame, files: DataFrame, name: str, own: str, other: str) -> DataFrame:
        first = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("fan", "chunk"))).alias("f")).select(name, F.col("f.chunk").alias("first"))
        at = rows.where(wide).join(lots, "chunk")
        at = at.withColumn(own, F.pmod(F.xxhash64(name), F.col(f"{own}_lots"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_lots") - 1)))
        return at.drop("fan", "i_lots", "j_lots").join(first, name).join(files, name)

    def run(key, gone, come):
        import pyarrow as pa

        out: tuple[list, list, list] = ([], [], [])
        cell = key[0].as_py()
        arrays = lambda t, c: [v.values.to_numpy(zero_copy_only=False) for v in t.column(c).combine_chunks()] if t.num_rows else []
        sides = [list(zip(t.column(n).to_pylist(), t.column(s).to_pylist(), t.column("first").to_pylist(), arrays(t, f"{w}_chunk"), arrays(t, f"{w}_bytes"), strict=True)) for t, n, s, w in ((gone, "from", "m", "u"), (come, "to", "n", "v"))]
        for f, m, before, x, u in sides[0]:
            before = set(before[: before.index(cell)])
            for t, n, others, y, v in sides[1]:
                if min(m, n) * 100 < max(m, n) * threshold or not before.isdisjoint(others):
                    continue
                shared = _shared(x, u, y, v)
                if shared * 100 >= max(m, n) * threshold:
                    for column, value in zip(out, (f, t, shared * 100 // max(m, n)), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["from", "to", "score"])

    cells = ("chunk", "i", "j")
    return deal(p, left, "from", "i", "j").groupBy(*cells).cogroup(deal(q, right, "to", "j", "i").groupBy(*cells)).applyInArrow(run, "from string, to string, score int")


def assigned(pairs: DataFrame) -> DataFrame:
    """``from, to, score``, each file in one pair at most: highest scores first, then the least ``to``, then the least ``from``.

    Pairs that are counted to be few are taken in this order in one task.  Of more, a pair that is the best of both its files is also
    the next one in this order of all that touch them; so a round takes all such pairs at once, and what remains
    without their files goes on.  Of a large group of equal scores a round takes one pair only; what ``ROUNDS`` leave is sorted
    and read through once, by a task that holds the names of the files taken.  The result is the same.
    """
    return _few_assigned(pairs) if pairs.limit(FEW + 1).count() <= FEW else _many_assigned(pairs)


ROUNDS = 4


def _few_assigned(pairs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        gone, come = set(), set()
        for batch in batches:
            out = []
            for f, t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f not in gone and t not in come:
                    gone.add(f)
                    come.add(t)
                    out.append((f, t, s))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["from", "to", "score"])

    ordered = pairs.select("from", "to", F.col("score").cast("int").alias("score")).coalesce(1).sortWithinPartitions(F.desc("score"), "to", "from")
    return put(ordered.mapInArrow(run, "from string, to string, score int"))


def _many_assigned(pairs: DataFrame) -> DataFrame:
    open_, taken = pairs.select("from", "to", F.col("score").cast("int").alias("score")), None
    for _ in range(ROUNDS):
        new, rest = _round(open_)
        drop(open_)
        open_, taken = rest, new if taken is None else taken.union(new)
        if open_.limit(FEW + 1).count() <= FEW:
            break
    last = _few_assigned(open_)
    drop(open_)
    return taken.union(last)


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(taken, rest)`` of the pairs that are the best of both their files."""
    order = F.struct((-F.col("score")).alias("less"), F.col("to").alias("t"), F.col("from").alias("f"))
    by_from = open_.groupBy("from").agg(F.min(order).alias("best")).select("best.*")
    by_to = open_.groupBy("to").agg(F.min(order).alias("best")).select("best.*")
    new = put(by_from.join(by_to, ["less", "t", "f"]).select(F.col("f").alias("from"), F.col("t").alias("to"), (-F.col("less")).alias("score")))
    return new, put(open_.join(new.select("from"), "from", "left_anti").join(new.select("to"), "to", "left_anti").select("from", "to", "score"))


def _kind(mode: str) -> Column:
    return F.shiftright(mode, 12)


def with_similar(changes: DataFrame, old: DataFrame, new: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``changes`` (of a diff with exact renames) and ``similarity``, with deleted and added regular files joined to renames.

    ``old`` and ``new`` are ``path, content``; content that is null (binary, absent) only takes part in exact renames.
    """
    regular = lambda m: _kind(m) == 0o10
    exact = cut(changes.withColumn("similarity", F.when(F.col("status") == "R", 100)))
    gone = exact.where((F.col("status") == "D") & regular("old_mode")).select("path", "old_mode")
    come = exact.where((F.col("status") == "A") & regular("new_mode")).select("path", "new_mode")
    pairs = cut(matched(old.select("path", "content").join(gone, "path"), new.select("path", "content").join(come, "path"), threshold))
    moved = pairs.join(gone.withColumnRenamed("path", "from"), "from").join(come.withColumnRenamed("path", "to"), "to")
    ends = pairs.select(F.col("from").alias("path"), F.lit("D").alias("status")).union(pairs.select("to", F.lit("A")))
    rest = exact.join(ends, ["path", "status"], "left_anti").select(exact.columns)
    return rest.unionByName(moved.select(F.col("to").alias("path"), F.col("from").alias("old_path"), F.lit("R").alias("status"), "old_mode", "new_mode", F.col("score").alias("similarity")))
