"""Renames by similarity against a scorer that compares every two files."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from revlake.operators import renames as N
from revlake.operators import tree as T


def chunked(text):
    out = Counter()
    for c in re.findall(r"[^\n]{0,63}\n|[^\n]{1,64}", text):
        out[c] += len(c.encode())
    return out


def scores(gone, come, threshold):
    out = {}
    for f, x in gone.items():
        for t, y in come.items():
            a, b = chunked(x), chunked(y)
            larger = max(sum(a.values()), sum(b.values()))
            shared = sum(min(n, b[c]) for c, n in a.items())
            if larger and 100 * shared >= threshold * larger:
                out[f, t] = 100 * shared // larger
    return out


def greedy(scored):
    used, out = set(), {}
    for (f, t), s in sorted(scored.items(), key=lambda x: (-x[1], x[0][1], x[0][0])):
        if ("f", f) not in used and ("t", t) not in used:
            used |= {("f", f), ("t", t)}
            out[f, t] = s
    return out


def versions(rng):
    line = lambda: " ".join(rng.choice(("alpha", "bêta", "gamma", "δ", "x" * 150)) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 6)))
    licence = [f"license line {k}" for k in range(12)]
    gone, come = {}, {}
    for i in range(40):
        lines = licence[: rng.choice((0, 12))] + [line() for _ in range(rng.randrange(0, 30))]
        gone[f"old/{i}"] = "\n".join(lines) + rng.choice(("\n", ""))
        for k in range(rng.choice((0, 1, 1, 2))):
            kept = [x for x in lines if rng.random() > rng.choice((0.05, 0.4, 0.6))] + [line() for _ in range(rng.randrange(0, 6))]
            come[f"new/{i}-{k}"] = "\n".join(kept) + "\n"
    gone |= {"old/empty": "", "old/same": "one\ntwo\n", "old/same2": "one\ntwo\n"}
    come |= {"new/empty": "", "new/same": "one\ntwo\nthree", "new/same2": "one\ntwo\n2"}
    return gone, come


@pytest.mark.parametrize(("seed", "threshold"), [(1, 50), (2, 50), (3, 20), (4, 90)])
def test_pairs_and_assignment_against_every_pair(spark, monkeypatch, seed, threshold):
    gone, come = versions(random.Random(seed))
    a, b = (spark.createDataFrame(list(x.items()), "path string, content string").repartition(3) for x in (gone, come))
    # no chunk has more holders than a lot, so all pairs of the first round are all similar pairs
    monkeypatch.setattr(N, "LOT", 1000)
    want = scores(gone, come, threshold)
    assert {(r["from"], r["to"]): r["score"] for r in N.matched(a, b, threshold).collect()} == greedy(want) and want


@pytest.mark.parametrize("seed", [1, 2])
def test_common_chunks_are_dealt_into_lots(spark, monkeypatch, seed):
    """Of any lots the pairs are one-to-one and similar, and files with one possible partner have it."""
    gone, come = versions(random.Random(seed))
    a, b = (spark.createDataFrame(list(x.items()), "path string, content string").repartition(3) for x in (gone, come))
    monkeypatch.setattr(N, "LOT", 2)
    want = scores(gone, come, 50)
    got = {(r["from"], r["to"]): r["score"] for r in N.matched(a, b).collect()}
    assert all(want[k] == v for k, v in got.items()) and len({f for f, _ in got}) == len({t for _, t in got}) == len(got) >= 0.8 * len(greedy(want))


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"line {k} of a text that everyone has" for k in range(30)]
    copy = lambda: "\n".join(x if rng.random() > 0.05 else f"own {rng.random()}" for x in base)
    a, b = (spark.createDataFrame([(f"{side}{k}", copy()) for k in range(300)], "path string, content string") for side in "ab")
    met = []
    real = N._met

    def counted(*x):
        pairs = real(*x)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "_met", counted)
    assert N.matched(a, b).count() >= 290
    assert sum(met) < 10_000 and len(met) < 12


def test_only_what_is_left_of_exact_renames_is_compared(spark):
    row = "path string, content string, oid string, mode int"
    text = "".join(f"line {k}\n" for k in range(20))
    old = [("a", text, "1", 0o100644), ("b", text + "b\n", "2", 0o100755), ("c", None, "3", 0o100644), ("d", text, "4", 0o120000), ("e", "e\n", "5", 0o100644)]
    new = [("x", text, "1", 0o100644), ("y", text + "y\n", "6", 0o100644), ("z", None, "7", 0o100644), ("l", text, "8", 0o120000), ("e", "f\n", "9", 0o100644)]
    got = {(r["status"], r["old_path"], r["path"], r["similarity"]) for r in T.diff(spark.createDataFrame(old, row), spark.createDataFrame(new, row), similar=50).collect()}
    score = 100 * len(text.encode()) // (len(text.encode()) + 2)
    assert got == {("R", "a", "x", 100), ("R", "b", "y", score), ("D", None, "c", None), ("A", None, "z", None), ("D", None, "d", None), ("A", None, "l", None), ("M", None, "e", None)}


def test_pairs_are_assigned_the_same_either_way(spark):
    rng = random.Random(8)
    pairs = spark.createDataFrame([(f"f{i}", f"t{j}", rng.randrange(50, 60)) for i in range(25) for j in range(25) if rng.random() < 0.3], "from string, to string, score int")
    one, two = (sorted(map(tuple, f(pairs).collect())) for f in (N._few_assigned, N._many_assigned))
    assert one == two and one


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    assert N.matched(none, none).count() == 0
