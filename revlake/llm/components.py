"""Connected components over a DataFrame of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import stage

#: Edges that one task unites.
FEW = 1 << 17


def _star(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour (itself included), joined back to its edges."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, comp)``: every node on an edge with the least node reachable from it.

    No neighbour list is ever gathered: each step is a minimum (combined before the shuffle) and a join that
    adaptive execution can split when one node has a third of all edges.  Each step is written to the shared
    folder, so lost executors cost no recomputation.  Null ends are ignored; no edges give no rows.  Edges that are counted
    to be few take no steps: one task unites them, with the same result.
    """
    now = stage(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.limit(FEW + 1).count() <= FEW:
        return _few_components(now)
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        now = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "stars",
        )
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())


def _few_components(edges: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, comp long")
