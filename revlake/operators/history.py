"""The commit graph: revision expressions, ancestry, logs, reachability, visibility.

Closures and logs go by the ancestry index (:mod:`revlake.operators.ancestry`): chains of first parents and the links between
them, so a round follows merges, not commits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.operators import ancestry as A
from revlake.operators.staging import cut

#: Fixed limits: steps of an ancestry, hex digits of a short id, commits of a log asked for as 0 and at most.
MOST_STEPS, SHORTEST_ID, LOG, MOST_LOG = 4096, 7, 50, 1000


class InvalidRevision(ValueError):
    """Outside the supported grammar."""


class ReservedNamespace(InvalidRevision):
    """Names the reserved namespace."""


@dataclass(frozen=True)
class Revision:
    """``kind`` is full, short_id, ref or name; ``steps`` are ``("~", n)`` and ``("^", n)``."""

    kind: str
    value: str
    steps: tuple[tuple[str, int], ...] = ()


def parse(text: str, reserved: str) -> Revision:
    """A revision expression; anything outside the grammar is refused, never guessed."""
    m = re.fullmatch(r"([^~^]*)((?:[~^]\d*)*)", text)
    if not m or not m[1]:
        raise InvalidRevision(text)
    steps = tuple((op, int(n) if n else 1) for op, n in re.findall(r"([~^])(\d*)", m[2]))
    if sum(n for _, n in steps) > MOST_STEPS:
        raise InvalidRevision(f"more than {MOST_STEPS} steps: {text}")
    name = m[1]
    if name.startswith(reserved) or ("refs/" + name).startswith(reserved):
        raise ReservedNamespace(name)
    if re.fullmatch(r"(sha1:)?[0-9a-f]{40}", name):
        return Revision("full", "sha1:" + name[-40:], steps)
    if re.fullmatch(rf"[0-9a-f]{{{SHORTEST_ID},39}}", name):
        return Revision("short_id", name, steps)
    if name != "HEAD" and re.fullmatch(r"[A-Z_]+", name) and ("_" in name or name.endswith("HEAD")):
        raise InvalidRevision(f"a pseudo-ref: {name}")
    bad = r"\.\.|@\{|\^\{|:|//|\.lock(/|$)|[\s*?\[\\\x00-\x1f\x7f]|^-|^@$|/$|^/|\.$|(^|/)\."
    if re.search(bad, name):
        raise InvalidRevision(name)
    return Revision("ref" if name.startswith("refs/") else "name", name, steps)


def resolve(revision: Revision, refs: DataFrame, commits: DataFrame, edges: DataFrame, head: str = "refs/heads/main", tags: DataFrame | None = None) -> DataFrame:
    """``commit``: the revision's commit, no row where there is none, an error where a short id is ambiguous.

    With ``tags`` (``tag, target``) a ref may name a tag object, which is followed; one that ends elsewhere is refused.
    """
    v = revision.value
    if revision.kind in ("ref", "name"):
        names = [v] if revision.kind == "ref" else [head] if v == "HEAD" else [f"refs/heads/{v}", f"refs/tags/{v}", f"refs/{v}"]
        order = F.coalesce(*[F.when(F.col("ref_name") == n, F.lit(i)) for i, n in enumerate(names)])
        found = refs.where(F.col("ref_name").isin(names)).orderBy(order).limit(1)
        if tags is None:
            found = found.select(F.col("target").alias("commit"))
        else:
            found = peeled(found, tags, commits).select("commit")
            if not found.where("commit is null").isEmpty():
                raise InvalidRevision(f"not a commit: {v}")
    else:
        found = commits.where(F.col("oid") == v if revision.kind == "full" else F.startswith(F.element_at(F.split("oid", ":"), 2), F.lit(v))).select("commit").limit(2)
        if revision.kind == "short_id" and found.count() > 1:
            raise InvalidRevision(f"ambiguous: {v}")
    return walk_ancestry(found, edges, revision.steps)


def peeled(refs: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """``ref_name, commit``: the commit at the end of each ref's chain of tag objects, null where something else is there.

    ``tags`` is ``tag, target``; a chain takes a round per tag on it, which are few.
    """
    now = cut(refs.select("ref_name", F.col("target").alias("at")))
    hop = tags.select(F.col("tag").alias("at"), F.col("target").alias("to"))
    while not now.join(hop, "at", "left_semi").isEmpty():
        now = cut(now.join(hop, "at", "left").select("ref_name", F.coalesce("to", "at").alias("at")))
    known = commits.select(F.col("commit").alias("at"), F.col("commit"))
    return now.join(known, "at", "left").select("ref_name", "commit")


def walk_ancestry(start: DataFrame, edges: DataFrame, steps) -> DataFrame:
    """``commit`` after the steps: ``^n`` the n-th parent, ``~n`` n first parents, 0 stays."""
    now = start.select("commit")
    first = edges.where("pos = 0").select("commit", F.col("parent").alias("to"))
    for op, n in steps:
        if op == "^":
            if n:
                now = now.join(edges.where(F.col("pos") == n - 1).select("commit", F.col("parent").alias("to")), "commit").select(F.col("to").alias("commit"))
            continue
        # powers of two of the first-parent step
        hop = first
        while n:
            if n & 1:
                now = now.join(hop, "commit").select(F.col("to").alias("commit"))
            n >>= 1
            if n:
                hop = hop.join(hop.select(F.col("commit").alias("to"), F.col("to").alias("far")), "to").select("commit", F.col("far").alias("to"))
    return now


def reachable(tips: DataFrame, edges: DataFrame, first_parent: bool = False, index: A.Ancestry | None = None) -> DataFrame:
    """``commit``: everything an edge path leads to from the tips, the tips included, by the ancestry index (built if not given)."""
    return A.reached(index or A.build(edges), tips, first_parent).select("commit")


def log(start: DataFrame, commits: DataFrame, edges: DataFrame, skip: int = 0, limit: int = 0, first_parent: bool = False, touching: DataFrame | None = None, index: A.Ancestry | None = None) -> tuple[DataFrame, bool]:
    """``(page, has_more)``: reachable commits by newest time, ties by id; ``touching`` filters before the skip.

    The page is found in the ancestry index (of ``committer_secs``; built if not given); only its commits are read whole.
    """
    limit = LOG if limit <= 0 else min(limit, MOST_LOG)
    index = index or A.build(edges, commits)
    order = [F.col("committer_secs").desc(), F.col("commit")]
    # a start that no table knows has no page
    head = A.newest(index, start, skip + limit + 1, first_parent, touching).orderBy(F.col("secs").desc(), "commit").offset(skip).limit(limit + 1)
    page = cut(commits.join(F.broadcast(head.select("commit")), "commit", "left_semi"))
    more = page.count() > limit
    return page.orderBy(*order).limit(limit), more


def touches(entries: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """``commit`` of the commits that changed a path: it differs from every parent; a root counts if it has it.

    ``entries`` is ``commit, path, oid, mode`` of the paths asked about.
    """
    e = entries.select("commit", "path", F.concat_ws(" ", "oid", F.col("mode").cast("string")).alias("state"))
    pairs = commits.select("commit").join(edges.select("commit", "parent"), "commit", "left")
    own = pairs.join(e, "commit").select("commit", "parent", "path", F.col("state").alias("own"), F.lit(None).cast("string").alias("was"))
    was = pairs.join(e.withColumnRenamed("commit", "parent"), "parent").select("commit", "parent", "path", F.lit(None).cast("string").alias("own"), F.col("state").alias("was"))
    sides = own.union(was).groupBy("commit", "parent", "path").agg(F.max("own").alias("own"), F.max("was").alias("was"))
    differs = sides.groupBy("commit", "path").agg(F.count("*").alias("n"), F.bool_and(~F.col("own").eqNullSafe(F.col("was"))).alias("d")).where("d")
    # a parent that has as little of the path as the commit itself gives no row, and is no difference
    parents = pairs.groupBy("commit").agg(F.count("*").alias("parents"))
    return differs.join(parents, "commit").where("n = parents").select("commit").distinct()


def visible_refs(refs: DataFrame, reserved: str) -> DataFrame:
    return refs.where(~F.startswith("ref_name", F.lit(reserved))).select("ref_name", "target").orderBy("ref_name")


def reserved_refs(refs: DataFrame, reserved: str) -> DataFrame:
    return refs.where(F.startswith("ref_name", F.lit(reserved))).select("ref_name", "target").orderBy("ref_name")
