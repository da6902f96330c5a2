"""Origins of lines by composed mappings against one walk through all versions."""

from __future__ import annotations

import random

from revlake.operators import blame as B
from revlake.operators import textdiff as D


def walked(contents):
    lines, origin = [], []
    for version, content in contents:
        new = D.split_lines(content or "")[0]
        origin = [origin[i] if op == " " else (version, j) for op, i, j in D.edit_script(lines, new) if op != "-"]
        lines = new
    out = []
    for k, (version, at) in enumerate(origin):
        if out and out[-1][2] == version and out[-1][3] + out[-1][1] == at + 1:
            out[-1][1] += 1
        else:
            out.append([k + 1, 1, version, at + 1])
    return [tuple(r) for r in out]


def edited(rng, lines):
    lines = list(lines)
    for _ in range(rng.randrange(0, 3)):
        at = rng.randrange(len(lines) + 1)
        lines[at : at + rng.choice((0, 0, 1, 2))] = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice((0, 1, 1, 3)))]
    return lines


def check(spark, histories):
    rows = [(p, v, c) for p, vs in histories.items() for v, c in vs]
    d = spark.createDataFrame(rows, "path string, version int, content string").repartition(7)
    got = {}
    for r in sorted(map(tuple, D.blame(d).collect())):
        got.setdefault(r[0], []).append(r[1:])
    assert got == {p: w for p, vs in histories.items() if (w := walked(vs))}


def test_many_files(spark):
    rng = random.Random(4)
    histories = {}
    for f in range(30):
        lines, out, v = [], [], rng.randrange(3)
        for _ in range(rng.randrange(1, 20)):
            lines = edited(rng, lines) if rng.random() > 0.2 else lines
            out.append((v, "".join(x + "\n" for x in lines) if lines or rng.random() > 0.5 else None))
            v += rng.randrange(1, 4)
        histories[f"f{f}"] = out
    check(spark, histories)


def test_a_thousand_versions(spark, monkeypatch):
    rng = random.Random(5)
    lines, out = ["x"] * 3, []
    for v in range(1000):
        lines = edited(rng, lines)[:40]
        out.append((v, "".join(x + "\n" for x in lines)))
    rounds = []
    real = B.cut
    monkeypatch.setattr(B, "cut", lambda df: rounds.append(1) or real(df))
    check(spark, {"hot": out})
    assert len(rounds) <= 12


def test_composition_is_associative():
    rng = random.Random(6)
    for _ in range(200):
        texts = [[]]
        for _ in range(3):
            texts.append(edited(rng, texts[-1]))
        a, b, c = (B.mapping(texts[k], texts[k + 1], k) for k in range(3))
        assert B.composed(B.composed(a, b), c) == B.composed(a, B.composed(b, c))


def test_searches_split_at_their_middle(monkeypatch):
    """However few steps are kept, scripts stay shortest and apply."""
    rng = random.Random(7)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for most in (1024, 1, 2, 5):
        monkeypatch.setattr(D, "MOST_EDITS", most)
        for _ in range(300):
            a, b = ([rng.choice("abcdx"[: rng.choice((2, 5))]) for _ in range(rng.randrange(14))] for _ in range(2))
            script = D.edit_script(a, b)
            assert sum(op == " " for op, _, _ in script) == longest(a, b)
            i = j = 0
            for op, x, y in script:
                assert (x, y) == (i, j) and (op != " " or a[x] == b[y])
                i, j = i + (op != "+"), j + (op != "-")
            assert (i, j) == (len(a), len(b))
    a = [str(k) for k in range(20_000)]
    assert len(D.edit_script(a, [f"x{k}" for k in a])) == 40_000  # nothing in common is found at once
