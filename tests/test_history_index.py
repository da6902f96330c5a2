"""The ancestry index against plain walks of the commit graph."""

from __future__ import annotations

import random

import pytest

from revlake.operators import ancestry as A
from revlake.operators import history as L


def graph(spark, parents, times=None):
    commits = spark.createDataFrame([(c, (times or {}).get(c, i)) for i, c in enumerate(parents)], "commit string, committer_secs long")
    edges = spark.createDataFrame([(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)], "commit string, parent string, pos int")
    return commits, edges


def walked(parents, tips, first=False):
    seen, todo = set(), list(tips)
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents.get(c, [])[: 1 if first else None]
    return seen


def history(seed, n):
    rng = random.Random(seed)
    parents = {}
    for i in range(n):
        k = min(i, rng.choice((1, 1, 1, 2, 3)))
        near = [f"c{max(0, i - 1 - int(rng.expovariate(0.3)))}" for _ in range(k)]
        parents[f"c{i}"] = list(dict.fromkeys(near)) if rng.random() > 0.03 else []
    return parents


@pytest.mark.parametrize(("seed", "few"), [(1, 0), (2, 1 << 17)])
def test_index_equals_walks(spark, tmp_path, monkeypatch, seed, few):
    monkeypatch.setattr(A, "FEW", few)
    parents = history(seed, 300)
    rng = random.Random(seed)
    times = {c: rng.randrange(60) for c in parents}  # skewed clocks and ties
    commits, edges = graph(spark, parents, times)
    A.write(A.build(edges, commits), str(tmp_path / "index"))
    for index in (A.build(edges, commits), A.read(spark, str(tmp_path / "index")), A.build(edges)):
        spans = index.spans.collect()
        assert len(spans) == len({r["commit"] for r in spans}) == len({(r["chain"], r["at"]) for r in spans})
        for first in (False, True):
            tips = [f"c{rng.randrange(300)}" for _ in range(3)]
            want = walked(parents, tips, first)
            got = [r["commit"] for r in L.reachable(spark.createDataFrame([(t,) for t in tips], "commit string"), edges, first, index).collect()]
            assert sorted(got) == sorted(want) or not want.issubset({r["commit"] for r in spans})
    index = A.read(spark, str(tmp_path / "index"))
    for skip, limit in ((0, 5), (7, 20), (0, 1000)):
        page, more = L.log(spark.createDataFrame([("c299",)], "commit string"), commits, edges, skip, limit, index=index)
        want = sorted(walked(parents, ["c299"]), key=lambda c: (-times[c], c))
        assert [r["commit"] for r in page.collect()] == want[skip : skip + limit] and more == (len(want) > skip + limit)


def test_rounds_follow_merges_not_commits(spark):
    """16 branches of 256 commits, each entered by the second parent at the end of the one before."""
    parents = {}
    for b in range(16):
        for k in range(256):
            parents[f"b{b:02}-{k:03}"] = [f"b{b:02}-{k - 1:03}"] if k else ([f"root{b}", f"b{b - 1:02}-255"] if b else [])
        parents[f"root{b}"] = []
    commits, edges = graph(spark, parents)
    index = A.build(edges, commits)
    prefix, rounds = A.closure(index, spark.createDataFrame([("b15-255",)], "commit string"))
    assert rounds <= 17
    got = {r["commit"] for r in A.reached(index, spark.createDataFrame([("b15-255",)], "commit string")).collect()}
    assert got == walked(parents, ["b15-255"])


def test_first_parents_cross_few_chains(spark):
    """A comb whose teeth come first in time: heavy paths keep the spine whole."""
    parents = {}
    for i in range(200):
        parents[f"s{i}"] = [f"s{i - 1}"] if i else []
        parents[f"t{i}"] = [f"s{i}"]
    commits, edges = graph(spark, parents, {c: 10 * int(c[1:]) + (0 if c[0] == "t" else 5) for c in parents})
    index = A.build(edges, commits)
    assert A.closure(index, spark.createDataFrame([("t150",)], "commit string"), True)[1] <= 2
    assert len({r["chain"] for r in index.spans.where("commit like 's%'").collect()}) == 1


def test_chains_are_the_same_either_way(spark):
    rng = random.Random(9)
    rows = [(f"r{i:03}", rng.randrange(1, 9), f"r{rng.randrange(i):03}" if i and rng.random() > 0.1 else None) for i in range(120)]
    runs = spark.createDataFrame(rows, "run string, n long, under string")
    assert sorted(map(tuple, A._few_chains(runs).collect())) == sorted(map(tuple, A._many_chains(runs).select("run", "chain", "before").collect()))


def test_history_of_nothing(spark):
    commits, edges = spark.createDataFrame([], "commit string, committer_secs long"), spark.createDataFrame([], "commit string, parent string, pos int")
    page, more = L.log(spark.createDataFrame([("x",)], "commit string"), commits, edges)
    assert page.collect() == [] and not more
    assert [r["commit"] for r in L.reachable(spark.createDataFrame([("x",), (None,)], "commit string"), edges).collect()] == ["x"]


def test_kept_folders_follow_the_rows(spark):
    from revlake.operators.staging import checksum, kept

    made = []
    a, b = spark.range(5).toDF("x"), spark.range(6).toDF("x")
    one = kept(spark, "test", checksum(a), made.append)
    assert kept(spark, "test", checksum(a.repartition(3)), made.append) == one and made == [one]
    assert kept(spark, "test", checksum(b), made.append) != one and len(made) == 2
