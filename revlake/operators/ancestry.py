"""An index of the commit graph: chains of first parents, positions on them, and the links between chains.

The first-parent tree is cut into heavy paths (each commit's chain goes on with the child that has most commits behind it), so
a walk along first parents crosses a logarithm of them.  Everything reachable from some tips is then a prefix of
each chain: a row per chain instead of a row per commit.  A closure walks links, not commits; its rounds are the depth of
merges, however long the chains are.

Building: the commits of a time range are joined to runs within a task first (a task holds the names of its range); what remains are
the forks and the borders of the ranges, and only these few runs take part in the doubling rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.operators.staging import FEW, cut, few


@dataclass(frozen=True)
class Ancestry:
    """``spans``: ``commit, secs, chain, at``; ``links``: ``chain, at, to_chain, to_at, pos`` of parents on other chains.

    ``bounds`` are ``(least secs, commits)`` of the ranges that the spans are written in, newest first.
    """

    spans: DataFrame
    links: DataFrame
    bounds: list[tuple[int | None, int]]


def build(edges: DataFrame, commits: DataFrame | None = None, secs: str = "committer_secs") -> Ancestry:
    """The index of ``edges`` (``commit, parent, pos``); parents that are no rows of ``commits`` take part without a time."""
    ends = edges.select("commit").union(edges.select("parent")).distinct()
    if commits is None:
        nodes = ends.withColumn("secs", F.lit(None).cast("long"))
    else:
        own = commits.select("commit", F.col(secs).cast("long").alias("secs"))
        nodes = own.unionByName(ends.join(own, "commit", "left_anti"), allowMissingColumns=True)
    first = edges.where("pos = 0").select("commit", F.col("parent").alias("below"))
    forks = first.groupBy(F.col("below").alias("commit")).count().where("count > 1").select("commit", F.lit(True).alias("fork"))
    rows = nodes.join(first, "commit", "left").join(forks, "commit", "left").select("commit", "secs", "below", F.coalesce("fork", F.lit(False)).alias("fork"))
    placed = cut(_runs(rows.repartitionByRange(F.col("secs"), F.col("commit"))))
    runs = placed.groupBy("run").agg(F.count("*").alias("n"), F.max("below").alias("below"))
    # a run's first parent is the last commit of its own run, so each run hangs from the end of another
    over = placed.select(F.col("commit").alias("below"), F.col("run").alias("under"))
    runs = cut(runs.join(over, "below", "left").select("run", "n", "under"))
    chains = _chains(runs)
    spans = cut(placed.join(few(chains), "run").select("commit", "secs", "chain", (F.col("before") + F.col("place")).alias("at")))
    ours = spans.select("commit", "chain", "at")
    theirs = spans.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("at").alias("to_at"))
    # a chain has the name of its first commit; all other first parents are on the chain itself
    apart = edges.select("commit", "parent", "pos").join(ours, "commit").where("pos > 0 or at = 0").join(theirs, "parent").where("chain <> to_chain")
    links = cut(apart.groupBy("chain", "at", "to_chain", F.col("pos") > 0).agg(F.max("to_at").alias("to_at"), F.min("pos").alias("pos")).select("chain", "at", "to_chain", "to_at", "pos"))
    return Ancestry(spans, links, [(None, 0)])


def _runs(rows: DataFrame) -> DataFrame:
    """``commit, secs, below, run, place``: commits joined to runs within their partition; ``below`` only where a run begins."""

    def run(batches):
        import pyarrow as pa

        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None  # the names of one range
        if got is None:
            return
        commit, secs, below, fork = (got.column(k).to_pylist() for k in range(4))
        here = {c: i for i, c in enumerate(commit)}
        after = [-1] * len(commit)
        starts = []
        for i, b in enumerate(below):
            j = here.get(b, -1) if b is not None else -1
            if j < 0 or fork[j]:
                starts.append(i)
            else:
                after[j] = i
        out: list[tuple] = []
        for s in starts:
            i, place = s, 0
            while i >= 0:
                out.append((commit[i], secs[i], below[i] if i == s else None, commit[s], place))
                i, place = after[i], place + 1
        for lo in range(0, len(out), 10_000):
            cols = zip(*out[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["commit", "secs", "below", "run", "place"])

    return rows.select("commit", "secs", "below", "fork").mapInArrow(run, "commit string, secs long, below string, run string, place long")


def _chains(runs: DataFrame) -> DataFrame:
    """``run, chain, before``: the heavy path of each run of ``run, n, under`` and the commits of it that come before.

    Runs that are counted to be few are decomposed in one task, others by doubling; the chains are the same.
    """
    return _few_chains(runs) if runs.limit(FEW + 1).count() <= FEW else _many_chains(runs)


def _few_chains(runs: DataFrame) -> DataFrame:
    def decompose(batches):
        import pyarrow as pa

        table = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        n = {run: k for run, k, _ in table}
        under = {run: u for run, _, u in table}
        above: dict[str, list[str]] = {}
        for run, u in under.items():
            if u is not None:
                above.setdefault(u, []).append(run)
        order = [run for run, u in under.items() if u is None]
        for run in order:  # grows as it is read
            order += above.get(run, [])
        size = dict(n)
        for run in reversed(order):
            if under[run] is not None:
                size[under[run]] += size[run]
        chain, before = {}, {}
        for run in order:
            u = under[run]
            heavy = u is not None and run == max(above[u], key=lambda r: (size[r], r))
            chain[run], before[run] = (chain[u], before[u] + n[u]) if heavy else (run, 0)
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array([chain[r] for r in order], pa.string()), pa.array([before[r] for r in order], pa.int64())], names=["run", "chain", "before"])

    return cut(runs.select("run", "n", "under").coalesce(1).mapInArrow(decompose, "run string, chain string, before long"))


def _many_chains(runs: DataFrame) -> DataFrame:
    size = runs.select("run", F.col("n").alias("size"))
    up = cut(runs.where("under is not null").select("run", F.col("under").alias("to")))
    while not up.isEmpty():  # runs at a distance of 1, 2, 4, ... below
        more = up.join(size, "run").groupBy(F.col("to").alias("run")).agg(F.sum("size").alias("more"))
        size = cut(size.join(more, "run", "left").select("run", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        up = cut(up.join(up.select(F.col("run").alias("to"), F.col("to").alias("far")), "to").select("run", F.col("far").alias("to")))
    heavy = runs.join(size, "run").where("under is not null").groupBy("under").agg(F.max_by("run", F.struct("size", "run")).alias("run")).select("run", F.lit(True).alias("heavy"))
    length = runs.select(F.col("run").alias("under"), F.col("n").alias("under_n"))
    goes_on = runs.join(heavy, "run").join(length, "under").select("run", F.col("under").alias("chain"), F.col("under_n").alias("before"))
    now = cut(runs.join(goes_on, "run", "left").select("run", F.coalesce("chain", "run").alias("chain"), F.coalesce("before", F.lit(0)).alias("before")))
    while True:
        further = now.select(F.col("run").alias("chain"), F.col("chain").alias("far"), F.col("before").alias("more")).where("chain <> far")
        total = F.col("before") + F.coalesce("more", F.lit(0))
        step = cut(now.join(further, "chain", "left").select("run", F.coalesce("far", "chain").alias("chain"), total.alias("before"), F.col("far").isNotNull().alias("moved")))
        now = step.select("run", "chain", "before")
        if step.where("moved").isEmpty():
            return now


def closure(index: Ancestry, tips: DataFrame, first_parent: bool = False) -> tuple[DataFrame, int]:
    """``chain, upto``: the prefix of each chain that the tips reach, and the rounds it took."""
    links = index.links.where("pos = 0") if first_parent else index.links
    start = index.spans.join(tips.select("commit"), "commit", "left_semi")
    raised = cut(start.groupBy("chain").agg(F.max("at").alias("upto")).withColumn("was", F.lit(-1).cast("long")))
    seen, rounds = raised, 0
    while not raised.isEmpty():
        rounds += 1
        out = links.join(few(raised), "chain").where("at > was and at <= upto").groupBy(F.col("to_chain").alias("chain")).agg(F.max("to_at").alias("upto"))
        known = seen.groupBy("chain").agg(F.max("upto").alias("was"))
        raised = cut(out.join(known, "chain", "left").select("chain", "upto", F.coalesce("was", F.lit(-1)).alias("was")).where("upto > was"))
        seen = seen.unionByName(raised)
    return cut(seen.groupBy("chain").agg(F.max("upto").alias("upto"))), rounds


def reached(index: Ancestry, tips: DataFrame, first_parent: bool = False) -> DataFrame:
    """``commit, secs`` of everything an edge path leads to from the tips, the tips included; tips without edges are kept."""
    known = index.spans.join(few(closure(index, tips, first_parent)[0]), "chain").where("at <= upto").select("commit", "secs")
    alone = tips.select("commit").where("commit is not null").distinct().join(index.spans, "commit", "left_anti")
    return known.unionByName(alone, allowMissingColumns=True)


def newest(index: Ancestry, tips: DataFrame, wanted: int, first_parent: bool = False, touching: DataFrame | None = None) -> DataFrame:
    """``commit, secs`` of reachable commits that hold the ``wanted`` newest: ranges are read from the newest on until they do."""
    prefix = few(closure(index, tips, first_parent)[0])
    take = 1
    while True:
        spans = index.spans.where("secs is not null")
        if take < len(index.bounds):
            spans = spans.where(F.col("secs") >= index.bounds[take - 1][0])
        hit = spans.join(prefix, "chain").where("at <= upto").select("commit", "secs")
        if touching is not None:
            hit = hit.join(touching.select("commit"), "commit", "left_semi")
        hit = cut(hit.orderBy(F.col("secs").desc(), "commit").limit(wanted))
        if take >= len(index.bounds) or hit.count() >= wanted:
            return hit
        take *= 4


def write(index: Ancestry, folder: str) -> None:
    """Spans by time, newest ranges first, and links by chain."""
    dealt = index.spans.repartitionByRange(F.col("secs").desc(), F.col("commit")).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions(F.col("secs").desc(), "commit").write.mode("overwrite").parquet(f"{folder}/spans")
    index.links.repartition("chain").sortWithinPartitions("chain", "at").write.mode("overwrite").parquet(f"{folder}/links")


def read(spark: SparkSession, folder: str) -> Ancestry:
    spans = spark.read.parquet(f"{folder}/spans")
    bounds = [(r["least"], r["n"]) for r in spans.where("secs is not null").groupBy("part").agg(F.min("secs").alias("least"), F.count("*").alias("n")).orderBy("part").collect()]  # a row per range
    return Ancestry(spans.drop("part"), spark.read.parquet(f"{folder}/links"), bounds or [(None, 0)])
