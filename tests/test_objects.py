"""Object ids against objects put together by hand."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from revlake.operators import objects as J


def oid(kind, body):
    return hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest()


def by_hand(files):
    """Directory by directory, recursively, with the names' bytes in tree order."""
    out = {}

    def tree(prefix):
        names = {}
        for path, (o, mode) in files.items():
            if path.startswith(prefix):
                name, _, rest = path[len(prefix) :].partition("/")
                names[name] = ("dir",) if rest else (o, mode)
        body = b""
        for name, what in sorted(names.items(), key=lambda x: (x[0] + "/" * (x[1] == ("dir",))).encode()):
            o, mode = (tree(f"{prefix}{name}/"), 0o40000) if what == ("dir",) else what
            body += f"{mode:o} {name}".encode() + b"\0" + bytes.fromhex(o)
        out[prefix.rstrip("/")] = oid("tree", body)
        return out[prefix.rstrip("/")]

    tree("")
    return out


def test_tree_ids(spark):
    rng = random.Random(3)
    names = ["a", "a.b", "a-b", "a0", "é", "b c", "Z", "lib", "lib.c", "lib0"]
    files = {}
    for _ in range(120):
        path = "/".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))
        if not any(p == path or p.startswith(path + "/") or path.startswith(p + "/") for p in files):
            files[path] = (hashlib.sha1(path.encode()).hexdigest(), rng.choice((0o100644, 0o100755, 0o120000)))
    d = spark.createDataFrame([(p, f"sha1:{o}", m) for p, (o, m) in files.items()], "path string, oid string, mode int").repartition(4)
    want = {p: f"sha1:{o}" for p, o in by_hand(files).items()}
    assert dict(J.trees(d).collect()) == want and len(want) > 20
    one = next(p for p in sorted(files) if p.count("/") == 2)
    changed = d.withColumn("mode", F.when(F.col("path") == one, 0o100600).otherwise(F.col("mode")).cast("int"))
    up = one.split("/")
    assert {r["path"] for r in J.changed_directories(J.trees(d), J.trees(changed)).collect()} == {"", up[0], "/".join(up[:2])}


def test_known_ids(spark):
    """The empty tree and a commit whose ids are those of every implementation."""
    none = spark.createDataFrame([], "path string, oid string, mode int")
    assert [tuple(r) for r in J.trees(none).collect()] == [("", "sha1:4b825dc642cb6eb9a060e54bf8d69288fbee4904")]
    body = b"tree 4b825dc642cb6eb9a060e54bf8d69288fbee4904\nparent " + b"ab" * 20 + b"\nauthor A U Thor <a@b.c> 1700000000 -0130\ncommitter C <c@d.e> 1700000001 +0545\n\nh\xc3\xa9llo\n"
    row = spark.createDataFrame([("sha1:4b825dc642cb6eb9a060e54bf8d69288fbee4904", ["sha1:" + "ab" * 20], "A U Thor", "a@b.c", 1700000000, -90, "C", "c@d.e", 1700000001, 345, "héllo\n")], "t string, p array<string>, an string, ae string, a_s long, az int, cn string, ce string, cs long, cz int, m string")
    who = dict(zip((f"{r}_{k}" for r in ("author", "committer") for k in ("name", "email", "secs", "tz")), map(F.col, ("an", "ae", "a_s", "az", "cn", "ce", "cs", "cz")), strict=True))
    assert row.select(J.commit_oid("t", "p", who, "m")).first()[0] == "sha1:" + oid("commit", body)
