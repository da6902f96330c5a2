"""Logs with renames against a model that applies one operation after the other."""

from __future__ import annotations

import random

import pytest

from revlake.operators import oplog as L

FILE, EXEC, DIR, LINK = 0o100644, 0o100755, 0o40000, 0o120000
LOG = "path string, seq long, op string, content string, mode int, to string"


class Model:
    """The tree as a dictionary; an operation that the tree does not allow is refused."""

    def __init__(self, base):
        self.files = {p: [c, m, p] for p, (c, m) in base.items()}  # content, mode, where it was in the base

    def below(self, path):
        return [p for p in self.files if p.startswith(path + "/")]

    def is_dir(self, path):
        return bool(self.below(path)) or self.files.get(path, [0, 0])[1] == DIR

    def parent_fine(self, path):
        up = path.rpartition("/")[0]
        return not up or (self.files.get(up, [0, DIR])[1] == DIR and self.parent_fine(up))

    def apply(self, op, path, content, mode, to):
        f = self.files.get(path)
        if not self.parent_fine(path):
            return False
        if op == "rename":
            if (f is None and not self.below(path)) or path == to or to.startswith(path + "/") or path.startswith(to + "/") or not self.parent_fine(to) or self.below(to):
                return False
            there = self.files.get(to)
            if there and (there[1] == DIR) != self.is_dir(path):
                return False
            self.files.pop(to, None)
            for p in [path, *self.below(path)]:
                if p in self.files:
                    self.files[to + p[len(path) :]] = self.files.pop(p)
            return True
        if op == "remove":
            if f is None or self.below(path):
                return False
            del self.files[path]
            return True
        if op == "mkdir" or op == "symlink":
            if f is not None or self.below(path):
                return False
            self.files[path] = [None if op == "mkdir" else content, DIR if op == "mkdir" else LINK, None]
            return True
        if self.below(path) or (f and f[1] in (DIR, LINK)):
            return False
        if op == "chmod":
            if f is None:
                return False
            f[1] = mode
        elif op == "create":
            self.files[path] = [content, FILE, f[2] if f else None]
        elif f is None:
            self.files[path] = [content if op != "truncate" else "", FILE, None]
        else:
            f[0] = {"write": content, "append": (f[0] or "") + content, "truncate": ""}[op]
        return True


def accepted(rng, base, steps):
    names = ["a", "b", "c", "d"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.choice((1, 1, 2, 2, 3))))
    model, log = Model(base), []
    for k in range(steps):
        op = rng.choice(("create", "write", "append", "truncate", "chmod", "symlink", "mkdir", "remove", "rename", "rename", "rename"))
        some = list(model.files) or ["a"]
        p = rng.choice((path(), rng.choice(some), rng.choice(some).rpartition("/")[0] or "a"))
        to = rng.choice((path(), path(), rng.choice(some)))
        if model.apply(op, p, f"<{k}>", EXEC, to):
            log.append((p, len(log), op, f"<{k}>", EXEC, to if op == "rename" else None))
    return model, log


@pytest.mark.parametrize(("seed", "chunk"), [(1, 50_000), (2, 50_000), (3, 3), (4, 1)])
def test_random_logs_match_the_model(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(L, "RENAMES", chunk)
    rng = random.Random(seed)
    for _ in range(3):
        base = {p: (f"base {p}", FILE) for p in ("a/a", "a/b/c", "b/a", "b/d/a", "c/a", "d/c/b") if rng.random() > 0.2}
        model, log = accepted(rng, base, 120)
        d = spark.createDataFrame(log, LOG).repartition(4)
        b = spark.createDataFrame([(p, c, m) for p, (c, m) in base.items()], "path string, content string, mode int")
        rows = L.fold_log(d, b).collect()
        assert len({r["path"] for r in rows}) == len(rows)
        view = {p: (c, m) for p, (c, m) in base.items()}
        for r in rows:
            if r["present"]:
                view[r["path"]] = (r["content"], r["mode"])
            else:
                del view[r["path"]]  # only base paths have such rows
        assert view == {p: (c, m) for p, (c, m, _) in model.files.items()}
        assert sum(op == "rename" for _, _, op, *_ in log) >= 5


def test_a_directory_moves_with_all_that_is_below(spark):
    base = spark.createDataFrame([("lib/x.py", "x"), ("lib/sub/y.py", "y"), ("other", "o"), ("dst/old", "z")], "path string, content string")
    log = [("lib/x.py", 0, "append", "1", None, None), ("dst/old", 1, "remove", None, None, None), ("lib", 2, "rename", None, None, "dst"), ("dst/x.py", 3, "append", "2", None, None), ("lib/x.py", 4, "create", "new", None, None), ("dst/sub", 5, "rename", None, None, "lib/sub")]
    got = {r["path"]: tuple(r)[1:] for r in L.fold_log(spark.createDataFrame(log, LOG), base).collect()}
    assert got == {
        "dst/x.py": (True, "file", FILE, "x12", "lib/x.py", 3, 2),
        "lib/x.py": (True, "file", FILE, "new", None, 4, None),
        "lib/sub/y.py": (True, "file", FILE, "y", None, None, 5),
        "dst/old": (False, None, None, None, None, 1, None),
    }


def test_logs_without_renames_and_nothing(spark):
    base = spark.createDataFrame([("a", "x")], "path string, content string")
    none = spark.createDataFrame([], LOG)
    assert L.fold_log(none, base).collect() == []
    one = spark.createDataFrame([("a", 0, "append", "y", None, None)], LOG)
    assert [(r["path"], r["content"]) for r in L.fold_log(one, base).collect()] == [("a", "xy")]
