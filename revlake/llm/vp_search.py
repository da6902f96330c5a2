"""Nearest neighbours by largest inner product: one vantage-point tree per shard of the vectors.

A vector x gets one more component, ``sqrt(M**2 - |x|**2)`` with M the largest norm, and a query gets 0 there; then
the largest inner product is the least Euclidean distance, and the triangle inequality holds.  A tree halves its points
by their distance to a vantage point and stores the range of distances in each half.  A half is skipped when
``factor`` times the least distance it can hold exceeds the distance of the k-th best point so far: factor 1 is exact,
a larger one skips more.

Shards and query blocks are of bounded size; each pair of a shard and a block is one row of work, and a query's answers
from all shards meet in a top-k.  Equal vectors of a shard are one point with its least ``k + 1`` ids: no more can be
among the k nearest, so this is exact however often a vector repeats.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import stage

LEAF = 128
#: Default pruning factor, the exact one: on vectors without clusters a larger one saves no time and loses ties (README).
FACTOR = 1.0


class VpTree:
    """Points (already augmented, distinct) in tree order; ``nodes`` as tuples of ranges and bounds."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(points, 0, len(points), leaf, rng)
        self.points = points[self.order]

    def _build(self, points: np.ndarray, lo: int, hi: int, leaf: int, rng) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        if hi - lo <= leaf:
            self.nodes[here] = (lo, hi)
            return here
        own = self.order[lo:hi]
        vantage = points[own[int(rng.integers(len(own)))]]
        d = np.sqrt(((points[own] - vantage) ** 2).sum(axis=1))
        place = np.argsort(d, kind="stable")
        self.order[lo:hi], d = own[place], d[place]
        mid = (hi - lo) // 2
        bounds = (d[0], d[mid - 1], d[mid], d[-1])
        inner = self._build(points, lo, lo + mid, leaf, rng)
        outer = self._build(points, lo + mid, hi, leaf, rng)
        self.nodes[here] = (lo, hi, vantage, bounds, inner, outer)
        return here

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the distances and places (in the points given at first) of the ``k`` nearest, -1 if fewer."""
        best = np.full((len(queries), k), np.inf)
        place = np.full((len(queries), k), -1, np.int64)
        norms, own = (queries**2).sum(axis=1), (self.points**2).sum(axis=1)

        def visit(n: int, q: np.ndarray) -> None:
            if not len(q):
                return
            node = self.nodes[n]
            if len(node) == 2:
                lo, hi = node
                d = np.sqrt(np.maximum(norms[q, None] + own[None, lo:hi] - 2 * queries[q] @ self.points[lo:hi].T, 0))
                d = np.concatenate([best[q], d], axis=1)
                at = np.concatenate([place[q], np.broadcast_to(self.order[lo:hi], (len(q), hi - lo))], axis=1)
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[q], place[q] = np.take_along_axis(d, top, axis=1), np.take_along_axis(at, top, axis=1)
                return
            _, _, vantage, (a, b, c, e), inner, outer = node
            d = np.sqrt(((queries[q] - vantage) ** 2).sum(axis=1))

            def open_(sel: np.ndarray, low: float, high: float) -> np.ndarray:
                least = np.maximum(np.maximum(low - d[sel], d[sel] - high), 0)
                return sel[least * factor <= best[q[sel]].max(axis=1) + 1e-7]

            near = d < (b + c) / 2
            first, second = np.flatnonzero(near), np.flatnonzero(~near)
            visit(inner, q[open_(first, a, b)])
            visit(outer, q[open_(second, c, e)])
            visit(outer, q[open_(first, c, e)])
            visit(inner, q[open_(second, a, b)])

        visit(self.root, np.arange(len(queries)))
        return best, place


    def within(self, queries: np.ndarray, far: np.ndarray, factor: float):
        """Query numbers and places, some at a time, of the points no further from a query than its ``far``, up to rounding."""
        norms, own = (queries**2).sum(axis=1), (self.points**2).sum(axis=1)
        most = far**2 + 1e-12 * (norms + own.max(initial=0))
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            n, q = todo.pop()
            node = self.nodes[n]
            if len(node) == 2:
                lo, hi = node
                near = norms[q, None] + own[None, lo:hi] - 2 * queries[q] @ self.points[lo:hi].T <= most[q, None]
                a, b = np.nonzero(near)
                yield q[a], self.order[lo + b]
                continue
            _, _, vantage, (a, b, c, e), inner, outer = node
            d = np.sqrt(((queries[q] - vantage) ** 2).sum(axis=1))
            for child, low, high in ((inner, a, b), (outer, c, e)):
                least = np.maximum(np.maximum(low - d, d - high), 0)
                if len(stay := q[least * factor <= far[q] + 1e-7]):
                    todo.append((child, stay))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v, dim``: the rows that take part; null, empty and zero vectors and null or non-finite parts do not."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, shard_rows: int = 16384, keep: int = 21) -> DataFrame:
    """``dim, shard, tree binary`` from ``id, v, dim``; a row is a shard of about ``shard_rows`` vectors.

    ``keep`` ids are stored of equal vectors of a shard, the least ones; it must be above the k that is searched.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = {r["dim"]: (max(1, -(-r["n"] // shard_rows)), r["m"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("m")).collect()}  # a row per dimension
    if not facts:
        return vectors.select("dim", F.lit(0).alias("shard"), F.lit(None).cast("binary").alias("tree")).limit(0)
    many = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, (n, _) in facts.items()])
    most = {d: m for d, (_, m) in facts.items()}

    def build(key, table):
        dim, shard = key[0].as_py(), key[1].as_py()
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.lexsort(np.vstack([x.T[::-1], ids]))
        once = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]  # an id's rows are all in this shard
        ids, x = ids[once], x[once]
        order = np.lexsort(np.vstack([ids, x.T[::-1]]))  # equal vectors side by side, least ids first
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        start = np.flatnonzero(first)
        held = [ids[a:b][:keep] for a, b in zip(start, [*start[1:], len(ids)], strict=True)]
        x = x[start]
        tree = VpTree(np.hstack([x, np.sqrt(np.maximum(most[dim] - (x**2).sum(axis=1, keepdims=True), 0))]), seed=shard)
        edge = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        blob = pickle.dumps((tree.order, tree.nodes, tree.root, tree.points, np.concatenate(held), edge, x), protocol=5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "tree": pa.array([blob], pa.binary())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), many))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, tree binary")


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest of each query ``id, v, dim``, itself left out."""
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    blocks = max(1, -(-queries.count() // block))
    queries = queries.groupBy("dim", "id").agg(F.min("v").alias("v"))
    packed = queries.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("q"))  # about `block` rows each
    work = packed.join(shards, "dim").select("dim", "q", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard")).join(index, ["dim", "shard"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].values
                qid = rows.field("id").to_numpy()
                yield _answers(qid, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(qid), -1), batch.column(1)[i].as_py(), k, factor)

    found = work.select("q", "tree").repartition(max(1, min(1024, blocks * 4)), F.xxhash64("q"), F.xxhash64("tree")).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Pairs of a query and a point that are ranked at a time.
RANKED = 1 << 18


def _answers(qid: np.ndarray, q: np.ndarray, blob: bytes, k: int, factor: float) -> pa.RecordBatch:
    tree = VpTree.__new__(VpTree)
    tree.order, tree.nodes, tree.root, tree.points, ids, edge, x = pickle.loads(blob)
    high = np.hstack([q, np.zeros((len(q), 1))])
    # the query itself may be one of k + 1; then all points as near as the last of them, so that ids decide between ties
    found, _ = tree.search(high, min(k + 1, len(x)), factor)
    far = found.max(axis=1) if len(x) > k else np.full(len(q), np.inf)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query number, id, score

    def ranked(pairs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, p = (np.concatenate(y) for y in zip(*pairs, strict=True))
        score = np.zeros(len(a))
        for j in range(q.shape[1]):  # in order of the components, so equal vectors score equally
            score += x[p, j] * q[a, j]
        n = edge[p + 1] - edge[p]
        at = np.repeat(edge[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, score, near = np.repeat(a, n), np.repeat(score, n), ids[at]
        apart = near != qid[a]
        a, near, score = (np.concatenate([y, z[apart]]) for y, z in zip(best, (a, near, score), strict=True))
        order = np.lexsort((near, -score, a))
        a, near, score = a[order], near[order], score[order]
        first = np.searchsorted(a, a)
        top = np.arange(len(a)) - first < k
        return a[top], near[top], score[top]

    held, n = [], 0
    for pair in tree.within(high, far, factor):
        held.append(pair)
        n += len(pair[0])
        if n > RANKED:
            best, held, n = ranked(held), [], 0
    if held:
        best = ranked(held)
    return pa.RecordBatch.from_arrays([pa.array(qid[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", **more) -> DataFrame:
    """The k nearest of every row for which ``is_query`` (a condition on ``id``) holds, against all rows.

    Ties go to the smaller id; a query with fewer candidates gets them all; vectors of another dimension are no
    candidates; an empty table gives no rows; other columns are ignored.  Of rows with one id and dimension the least vector
    counts, as query and as candidate.  At factor 1 ties are exact: all points as near as the last one are ranked by score and id.
    """
    rows = usable(vectors, id_col, vector_col)
    return search(stage(build_index(rows, keep=k + 1, **more), "trees"), rows.where(is_query), k, factor)
