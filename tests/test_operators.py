"""Operators that SQL cannot check, against plain Python; grammars and edge cases."""

from __future__ import annotations

import difflib
import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revlake.functions import content as K
from revlake.functions import globs as G
from revlake.functions import history as H
from revlake.functions import patterns as R
from revlake.functions import paths as P
from revlake.operators import history as L
from revlake.operators import index as X
from revlake.operators import overlay as O
from revlake.operators import rules
from revlake.operators import search as S
from revlake.operators import textdiff as D
from revlake.operators import tree as T
from revlake.operators.staging import with_sum_before
from revlake.plans import graph_queries as Q
from revlake.plans import more_queries as M
from revlake.plans import tree_queries as W
from revlake.sources import views as V
from revlake.streaming import detectors as Z

RESERVED = "refs/internal/"


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        # a pattern without a slash matches a name at any depth
        ("*.log", "var/2024/boot.log", True),
        ("*.log", "var/boot.log.1", False),
        # one with a slash is anchored at the root, and a star stays within a component
        ("docs/*.md", "docs/intro.md", True),
        ("docs/*.md", "docs/guide/intro.md", False),
        ("docs/*.md", "old/docs/intro.md", False),
        # two stars take any number of components, none included
        ("lib/**/test", "lib/test", True),
        ("lib/**/test", "lib/x/y/test", True),
        ("lib/**/test", "lib/x/testing", False),
        # a trailing slash takes what lies below a directory, not a file of its name
        ("cache/", "app/cache/page/1.bin", True),
        ("cache/", "app/cache", False),
        # a bracket without its end and an escaped sign are ordinary
        ("q[uv", "q[uv", True),
        (r"what\?", "what?", True),
        (r"what\?", "whats", False),
        ("a/**/b", "a/xb", True),
        ("/top.txt", "a/top.txt", False),
        ("a?c", "a/c", False),
        ("[!a]x", "bx", True),
        ("[^/]x", "/x", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert G.is_match(path, glob) == hit
    assert spark.range(1).select(G.matches(F.lit(path), glob)).first()[0] == hit


@pytest.mark.parametrize(
    "pattern, literal, fold, want",
    [
        ("needle", False, False, ["needle"]),
        ("north|southern", False, False, ["north", "southern"]),
        ("north|so", False, False, None),
        ("batch(es)?", False, False, ["batch"]),
        (r"def\s+reduce_", False, False, ["reduce_"]),
        ("x.y", False, False, None),
        (r"\d*", False, False, None),
        ("$", False, False, None),
        ("[", False, False, None),
        ("(?:tick)+", False, False, ["tick"]),
        ("(?:tick)*", False, False, None),
        ("a.b", True, False, ["a.b"]),
        ("café", True, False, ["café"]),
        ("café", True, True, None),
        ("(?i)needle", False, False, None),
    ],
)
def test_required_literals(pattern, literal, fold, want):
    assert R.required_literals(pattern, literal, fold) == want


def test_required_literals_are_sound():
    rng = random.Random(1)
    for _ in range(300):
        parts = [rng.choice(["abc", "abcd", "x?", "[ab]", "(foo|foobar)", "(?:qux)+", "d*", "(abc|abd)", "zz"]) for _ in range(rng.randint(1, 4))]
        pattern = "".join(parts)
        need = R.required_literals(pattern)
        for _ in range(20):
            text = "".join(rng.choice(["abc", "abd", "foo", "foobar", "qux", "zz", "x", "a", "d", "bcd"]) for _ in range(8))
            if need and re.search(pattern, text):
                assert any(n in text for n in need), (pattern, text, need)


def test_trigrams_and_case_variants():
    assert R.trigrams("aaaa") == [0x616161] and R.trigrams("ab") == []
    assert [len(R.case_variants(R.pack(x))) for x in (b"abc", b"a1c", b"123")] == [8, 4, 1]


@pytest.mark.parametrize("pattern", ["(?=a)b", r"(a)\1", "+a", "a{2,1}", "(?<!x)y", "(?>a)", r"\Z", r"\q", "(?-u).", "[b-a]", "(a", "a)", "[a", r"\p{Nonsense}", "[[:nonsense:]]"])
def test_unsupported_patterns_are_refused(spark, pattern):
    with pytest.raises(R.InvalidPattern):
        R.check(pattern)


def test_occurrences_byte_columns_and_empty_matches(spark):
    lines = spark.createDataFrame([(1, 1, "baaac"), (1, 2, "éxé\r"), (2, 1, None)], "blob_key long, line long, text string")
    got = [tuple(r) for r in S.occurrences(lines, S.Query("a*", literal=False)).orderBy("blob_key", "line", "column").select("line", "column", "matched").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 1, ""), (1, 2, "aaa"), (1, 6, "")]
    assert [tuple(r) for r in S.occurrences(lines, S.Query("x")).select("line", "column", "line_text").collect()] == [(2, 3, "éxé")]
    long = spark.createDataFrame([(1, 1, "é" * 10 + "x")], "blob_key long, line long, text string")
    row = S.occurrences(long, S.Query("x", line_bytes=5)).first()
    assert (row["column"], row["line_text"], row["line_truncated"]) == (21, "éé", True)


def test_search_contract(spark):
    files = [(1, "a/x.txt", "one two\ntwo"), (2, "a/y.txt", "two"), (3, "vendor/z.txt", "two"), (4, "b/n.bin", "\0two")]
    d = spark.createDataFrame(files, "blob_key long, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    b = X.registry(d.select("blob_key", "content", "size", F.lit("o").alias("oid")))
    m = d.select("path", "blob_key")
    for postings in (None, X.postings(b)):
        page, done = S.search(m, b, postings, S.Query("two", results=3))
        assert [tuple(r) for r in page.select("path", "line", "column").collect()] == [("a/x.txt", 1, 5), ("a/x.txt", 2, 1), ("a/y.txt", 1, 1)]
        row = done.first()
        assert (row["execution_status"], row["truncation"], row["eligible_paths"], row["excluded"]) == ("TRUNCATED", "result_limit", 3, {"binary": 1})
    page, done = S.search(m, b, X.postings(b), S.Query("two", results=4))
    assert page.count() == 4 and done.first()["execution_status"] == "COMPLETE"
    _, done = S.search(m, b, X.postings(b), S.Query("t.o", literal=False))
    assert done.first()["truncation"] == "no_required_literal"
    _, done = S.search(m, b, X.postings(b), S.Query("two", candidates=1))
    assert done.first()["truncation"] == "candidate_budget" and done.first()["candidates_considered"] == 1
    policy = K.CorpusPolicy(vendored=True)
    _, done = S.search(m, b, None, S.Query("two", policy=policy))
    assert done.first()["excluded"] == {"binary": 1, "vendored": 1} and "vendored" in done.first()["declared_exclusions"]


def test_content_classes_and_pointers(spark):
    rows = [(0, b""), (1, b"a\0b"), (2, b"\xff\xfe"), (3, b"ok"), (4, b"x" * 9000 + b"\0"), (5, None)]
    d = spark.createDataFrame(rows, "id int, c binary")
    got = {r[0]: r[1] for r in d.select("id", K.classify("c", 100_000)).collect()}
    assert got == {0: "TEXT", 1: "BINARY", 2: "INVALID_UTF8", 3: "TEXT", 4: "TEXT", 5: None}
    oid = "a" * 64
    texts = [f"version https://git-lfs.github.com/spec/v1\noid sha256:{oid}\nsize 12345\n", f"version https://git-lfs.github.com/spec/v1\next-0 x\noid sha256:{oid}\nsize 1\n", f"version https://git-lfs.github.com/spec/v1\noid sha256:{oid}\nsize 1", f"oid sha256:{oid}\nsize 1\n", "version https://git-lfs.github.com/spec/v1\nnovalue\n"]
    got = [r[1] and r[1]["size"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", K.pointer("t")).orderBy("i").collect()]
    assert got == [12345, 1, None, None, None]


def test_lines_and_locate(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in d.orderBy("i").select(K.lines("t")).collect()]
    assert got == [[], ["a"], ["a"], ["a", ""], [""], ["a\r", "b"]]
    assert tuple(spark.range(1).select(K.locate(F.lit("ab\nécd"), F.lit(5))).first()[0]) == (2, 3)


def test_paths(spark):
    show = lambda c: spark.range(1).select(c).first()[0]
    assert show(P.condition(F.lit("a/" * 256 + "b"))) == "too deep" and show(P.condition(F.lit("a\0b"))) == "nul" and show(P.condition(F.lit("a/b"))) is None
    assert show(P.resolved(F.lit("a/./b/../c"))) == "a/c" and show(P.resolved(F.lit("../x"))) is None
    assert show(P.quoted("a/", F.lit('é"\t'))) == '"a/\\303\\251\\"\\t"'
    assert show(P.escaped(F.lit(bytearray(b"a\xff\\")))) == "a\\xff\\\\"
    assert show(P.common_ancestor(F.lit("a/b/c"), F.lit("a/bc/d"))) == "a"
    assert show(P.common_ancestor(F.lit("x"), F.lit("y"))) == ""
    assert show(P.repository_id_for(F.lit(" git@Host:a//b/../c.git "))) == "Host_a_b_.__c"


def test_formats_and_dates(spark):
    d = spark.createDataFrame([("sha1:" + "a" * 40, "sha1:" + "b" * 40, ["sha1:" + "c" * 40], "S\n\nB\n", "n", "e", 1112911993, -420)], "commit string, tree string, parents array<string>, message string, author_name string, author_email string, author_secs long, author_tz int")
    assert d.select(H.formatted("%h %t %p|%s|%b|%ad|%aI|%%%n", 0)).first()[0] == "aaaaaaa bbbbbbb ccccccc|S|B\n|Thu Apr 7 15:13:13 2005 -0700|2005-04-07T15:13:13-07:00|%\n"
    for bad in ("%q", "%ax", "%"):
        with pytest.raises(ValueError):
            H.formatted(bad, 0)
    year = 31557600
    for delta, want in ((1, "1 second ago"), (3600, "1 hour ago"), (75 * 86400, "2 months ago"), (2 * year + 40 * 86400, "2 years, 1 month ago"), (3 * year, "3 years ago"), (-1, "in the future")):
        assert spark.range(1).select(H.date_relative(F.lit(0).cast("long"), F.lit(delta).cast("long"))).first()[0] == want


@pytest.mark.parametrize(
    "text, kind, steps",
    [("HEAD", "name", ()), ("a" * 40, "full", ()), ("sha1:" + "a" * 40, "full", ()), ("abcdef0", "short_id", ()), ("abcdef", "name", ()), ("refs/heads/x~2^3", "ref", (("~", 2), ("^", 3))), ("main^~", "name", (("^", 1), ("~", 1))), ("x~0", "name", (("~", 0),))],
)
def test_revisions(text, kind, steps):
    r = L.parse(text, RESERVED)
    assert (r.kind, r.steps) == (kind, steps)


@pytest.mark.parametrize("text", ["a..b", "x@{1}", "x^{tree}", "rev:path", "@", "-x", "a b", "x.lock", "a//b", "FETCH_HEAD", "x~5000", "", "refs/internal/x", "internal/x"])
def test_bad_revisions(text):
    with pytest.raises(L.InvalidRevision):
        L.parse(text, RESERVED)


def test_ambiguous_short_id(spark):
    commits = spark.createDataFrame([("a", "sha1:abcdef012"), ("b", "sha1:abcdef034")], "commit string, oid string")
    edges = spark.createDataFrame([], "commit string, parent string, pos int")
    with pytest.raises(L.InvalidRevision):
        L.resolve(L.parse("abcdef0", RESERVED), commits, commits, edges)
    assert L.resolve(L.parse("abcdef01", RESERVED), commits, commits, edges).first()[0] == "a"


def test_ignore_rules_last_match_wins(spark):
    parsed = rules.parse_ignore("# c\n\n *.log \n!keep.log\nbuild/\n")
    assert parsed == [("*.log", False), ("!keep.log"[1:], True), ("build/", False)]
    listed = [("", g, n) for g, n in parsed] + [("sub", "keep.log", False)]
    paths = ["a.log", "keep.log", "sub/keep.log", "build/x", "src/build/x", "src/x"]
    d = spark.createDataFrame(list(enumerate(paths)), "i int, path string").orderBy("i").select(rules.ignored("path", listed))
    assert [r[0] for r in d.collect()] == [True, False, True, True, True, False]


def test_edit_scripts_are_shortest_and_apply():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        script = D.edit_script(a, b)
        assert [a[i] for op, i, _ in script if op != "+"] == a and [b[j] for op, _, j in script if op != "-"] == b
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert sum(op == " " for op, _, _ in script) == lcs[-1][-1]


def test_unified_equals_difflib_in_shape():
    old = "".join(f"l{i}\n" for i in range(40))
    new = old.replace("l5\n", "L5\n").replace("l30\n", "") + "tail"
    want = "".join(list(difflib.unified_diff(old.splitlines(True), new.splitlines(True)))[2:])
    got = D.unified(old, new)
    assert got.replace("\\ No newline at end of file\n", "").rstrip("\n") == want.rstrip("\n")
    assert got.endswith("+tail\n\\ No newline at end of file\n")
    assert D.unified("", "a\n") == "@@ -0,0 +1,1 @@\n+a\n" and D.unified("a\n", "a\n") == ""


def test_patches_stats_and_cap(spark):
    rows = [("x", "a\nb\n", "a\nc\n", 33188, 33261, "Modified", None), ("n", None, "n\n", None, 33188, "Added", None), ("b", "\0", "y", 33188, 33188, "Modified", None), ("to", "s\n", "s\n", 33188, 33188, "Renamed", "was")]
    d = spark.createDataFrame(rows, "path string, old_content string, new_content string, old_mode int, new_mode int, kind string, `from` string")
    p = {r["path"]: r["patch"] for r in D.patches(d).collect()}
    assert p["x"] == "diff --git a/x b/x\nold mode 100644\nnew mode 100755\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    assert p["n"] == "diff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1,1 @@\n+n\n"
    assert p["b"].endswith("Binary files a/b and b/b differ\n") and p["to"] == "diff --git a/was b/to\nrename from was\nrename to to\n"
    s = {r["path"]: (r["additions"], r["deletions"], r["binary"]) for r in D.stats(d).collect()}
    assert s == {"x": (1, 1, False), "n": (1, 0, False), "b": (0, 0, True), "to": (0, 0, False)}
    assert {r["path"]: r["bar"] for r in D.histogram(D.stats(d)).collect()}["x"] == "+-"
    page, more = D.capped(D.patches(d), 120)
    assert more and [r["path"] for r in page.collect()] == ["b"]


def c_quoted(text):
    named = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
    raw = ("a/" + text).encode()
    shown = "".join(named.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in raw)
    return shown if shown == raw.decode(errors="replace") else f'"{shown}"'


def test_quoted_texts_against_python(spark, sf_dir):
    want = {r["doc_id"]: c_quoted(r["content"]) for r in V.files(spark, sf_dir).collect()}
    assert {r["doc_id"]: r["quoted"] for r in W.e30(spark, sf_dir).collect()} == want


def ended(text):
    return [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * bool(text and not text.endswith("\n"))


def applied(old, hunks):
    """What a patch makes of a text."""
    lines, out, at = ended(old), [], 0
    body = hunks.split("\n")[:-1]
    for k, x in enumerate(body):
        if x.startswith("@@"):
            first, count = map(int, x.split()[1][1:].split(","))
            start = first - (count > 0)
            out += lines[at:start]
            at = start
        elif x[0] in " +-":
            text = x[1:] + ("" if body[k + 1 : k + 2] == ["\\ No newline at end of file"] else "\n")
            if x[0] != "+":
                assert lines[at] == text
                at += 1
            if x[0] != "-":
                out.append(text)
    return "".join(out + lines[at:])


@pytest.mark.parametrize("old, new", [("a\nb", "a\nb\nc"), ("a\nb\n", "a\nb"), ("", "x"), ("x", ""), ("a\nb", "z\nb"), ("a\n" * 20, "a\n" * 9 + "q\n" + "a\n" * 11 + "t")])
def test_patches_with_unended_lines(old, new):
    assert applied(old, D.unified(old, new)) == new


def test_bundle_checksums_against_difflib(spark, sf_dir):
    """Patches whose hunks difflib agrees with: applied to the old text they give the new one."""
    base = {r["path"]: r for r in V.snapshot(spark, sf_dir, 3).collect()}
    new = {r["path"]: r["content"] for r in V.overlay_content(spark, sf_dir).collect()}
    rows = {r["path"]: r for r in O.status(V.overlay(spark, sf_dir)).collect()}
    got = {r["path"]: r["patch_sha256"] for r in M.k4(spark, sf_dir).collect()}
    assert set(got) == set(rows) and len(set(got.values())) == len(got)
    for path, r in rows.items():
        was, name = r["from"] or path, {k: c_quoted(k) for k in (path, r["from"] or path)}
        a, b = name[was], c_quoted(path).replace("a/", "b/", 1)
        old, come = "" if r["kind"] == "Added" else base[was]["content"], "" if r["kind"] == "Deleted" else new[path]
        head = f"diff --git {a} {b}\n"
        if r["kind"] == "Added":
            head += f"new file mode {r['new_mode']:06o}\n"
        elif r["kind"] == "Deleted":
            head += f"deleted file mode {r['old_mode']:06o}\n"
        elif r["kind"] == "Renamed":
            head += f"rename from {was}\nrename to {path}\n"
        elif r["old_mode"] != r["new_mode"]:
            head += f"old mode {r['old_mode']:06o}\nnew mode {r['new_mode']:06o}\n"
        if old != come:
            assert applied(old, D.unified(old, come)) == come
            head += f"--- {'/dev/null' if r['kind'] == 'Added' else a}\n+++ {'/dev/null' if r['kind'] == 'Deleted' else b}\n"
            head += D.unified(old, come)
        assert got[path] == hashlib.sha256(head.encode()).hexdigest()
        if r["kind"] in ("Modified", "Added", "Deleted"):
            plus = sum(x[:1] == "+" for x in D.unified(old, come).split("\n"))
            assert plus == sum(j2 - j1 for op, _, _, j1, j2 in difflib.SequenceMatcher(None, ended(old), ended(come), False).get_opcodes() if op != "equal")


def test_blame(spark):
    d = spark.createDataFrame([("f", 0, "a\nb\nc\n"), ("f", 1, "a\nB\nc\n"), ("f", 2, "z\na\nB\nc\n"), ("g", 0, "")], "path string, version int, content string")
    got = sorted(tuple(r) for r in D.blame(d).collect())
    assert got == [("f", 1, 1, 2, 1), ("f", 2, 1, 0, 1), ("f", 3, 1, 1, 2), ("f", 4, 1, 0, 3)]
    assert [tuple(r) for r in D.blame_lines(D.blame(d), 2, 3).orderBy("line").collect()] == [("f", 2, 0, 1), ("f", 3, 1, 2)]


def test_stats_of_snapshots_against_difflib(spark, sf_dir):
    both = D.pairs(V.snapshot(spark, sf_dir, 0), V.snapshot(spark, sf_dir, 1))
    got = {r["path"]: (r["additions"], r["deletions"]) for r in D.stats(both).collect()}
    for r in both.collect():
        old, new = (r["old_content"] or "").splitlines(True), (r["new_content"] or "").splitlines(True)
        adds, dels = got[r["path"]]
        assert adds - dels == len(new) - len(old)
        assert adds <= sum(x.startswith("+ ") for x in difflib.ndiff(old, new))


def test_list_tree_pages_end_with_directories(spark):
    paths = ["a/1", "a/2", "a/b/1", "a/b/2", "a/b/3", "c/1", "d/1", "e"]
    d = spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.lit(V.REGULAR).alias("mode"), F.lit("o").alias("oid"), F.lit(1).cast("long").alias("size"))
    page = {r["directory"]: r["page"] for r in T.list_tree(d, 4).collect()}
    assert page == {"": 0, "a": 1, "a/b": 1, "c": 2, "d": 2}


@pytest.mark.parametrize("most", [1, 7, 60])
def test_list_tree_pages_over_many_ranges(spark, most):
    r = random.Random(most)
    paths = sorted({"/".join(r.choice("abcdefgh.") * r.randint(1, 2) for _ in range(r.randint(1, 5))) + "/z" for _ in range(500)})
    d = spark.createDataFrame([(p, V.REGULAR, "o", 1) for p in paths], "path string, mode int, oid string, size long")
    held, page, want = 0, 0, {}
    children = defaultdict(set)
    for p in paths:
        parts = p.split("/")
        for i in range(len(parts)):
            children["/".join(parts[:i])].add(parts[i])
    for directory in sorted(children, key=lambda x: x.split("/")):
        want[directory] = page
        held += len(children[directory])
        if held >= most:
            held, page = 0, page + 1
    assert {x["directory"]: x["page"] for x in T.list_tree(d, most).collect()} == want


def test_list_tree_of_nothing(spark):
    assert T.list_tree(spark.createDataFrame([], "path string, mode int, oid string, size long"), 5).count() == 0


def test_operations_follow_what_a_path_allows(spark):
    ops = [
        ("d", "mkdir", None, None), ("d", "write", "no", None), ("d", "chmod", None, V.EXECUTABLE),
        ("l", "symlink", "to", None), ("l", "append", "no", None), ("l", "mkdir", None, None),
        ("f", "chmod", None, V.EXECUTABLE), ("f", "create", None, None), ("f", "append", "ab", None), ("f", "chmod", None, V.EXECUTABLE), ("f", "write", "c", None),
        ("base", "truncate", None, None), ("base", "write", "was", None), ("gone", "remove", None, None), ("never", "create", "x", None), ("never", "remove", None, None),
        ("again", "remove", None, None), ("again", "symlink", "y", None), ("tool", "chmod", None, V.REGULAR), ("odd", "unknown", "x", None),
    ]
    log = spark.createDataFrame([(p, i, op, c, m) for i, (p, op, c, m) in enumerate(ops)], "path string, seq int, op string, content string, mode int")
    base = spark.createDataFrame([(p, "was", V.EXECUTABLE if p == "tool" else V.REGULAR) for p in ("base", "gone", "again", "tool", "other")], "path string, content string, mode int")
    got = {r["path"]: tuple(r)[1:] for r in O.fold_operations(log, base).collect()}
    assert got == {
        "d": (True, "directory", V.DIRECTORY, None, False),
        "l": (True, "symlink", V.SYMLINK, "to", False),
        "f": (True, "file", V.EXECUTABLE, "c", False),
        "base": (True, "file", V.REGULAR, "was", True),
        "gone": (False, None, None, None, False),
        "again": (True, "symlink", V.SYMLINK, "y", False),
        "tool": (True, "file", V.REGULAR, "was", False),
    }


def test_monitor_answers_ask_for_a_rescan(spark):
    base = spark.createDataFrame([("b",)], "path string")
    log = spark.createDataFrame([("x", 1, "remove"), ("b", 2, "remove"), ("y", 3, "remove"), ("x", 4, "write"), ("x", 5, "write"), ("y", 6, "remove")], "path string, seq int, op string")
    assert [O.vanished_overflow(log, base, n).first()["overflow"] for n in (1, 2)] == [True, False]
    assert O.vanished_overflow(log.limit(0), base, 0).first()["overflow"] is False
    fits, more = O.vanished_overflow(log, base, 2), O.vanished_overflow(log, base, 1)
    assert [O.monitor_answer(base, o, 4, t)[1] for o, t in ((fits, "4:9"), (fits, "41:9"), (fits, ""), (more, "4:9"))] == [False, True, True, True]


def test_tags_are_peeled_and_other_objects_refused(spark):
    refs = spark.createDataFrame([("refs/tags/a", "t2"), ("refs/tags/b", "t3"), ("refs/heads/c", "c1")], "ref_name string, target string")
    tags = spark.createDataFrame([("t1", "c1"), ("t2", "t1"), ("t3", "tree")], "tag string, target string")
    commits = spark.createDataFrame([("c1", "sha1:00")], "commit string, oid string")
    edges = spark.createDataFrame([], "commit string, parent string, pos int")
    found = lambda name: [r[0] for r in L.resolve(L.parse(name, V.RESERVED), refs, commits, edges, tags=tags).collect()]
    assert found("a") == ["c1"] and found("c") == ["c1"] and found("none") == []
    with pytest.raises(L.InvalidRevision):
        found("b")


def test_sums_before_run_over_ranges(spark):
    rows = [(i // 3, i, i % 5) for i in range(400)]
    random.Random(1).shuffle(rows)
    got = with_sum_before(spark.createDataFrame(rows, "a int, b int, n int"), ["a", "b"], "n", "before").collect()
    assert {r["b"]: r["before"] for r in got} == {i: sum(j % 5 for j in range(i)) for i in range(400)}


def test_front_coding_round_trip(spark, sf_dir):
    rows = [tuple(r) for r in T.front_coded(V.files(spark, sf_dir)).collect()]
    groups = defaultdict(list)
    for path, shared, suffix in rows:
        groups[path.split("/")[0]].append((path, shared, suffix))
    for g in groups.values():
        before = ""
        for path, shared, suffix in sorted(g):
            assert path == before[:shared] + suffix and (not before or before[: shared + 1] != path[: shared + 1])
            before = path


def test_touches_against_python(spark, sf_dir):
    c = V.commits(spark, sf_dir).select("commit", "parents", "author_name").collect()
    role = {r["commit"]: r["author_name"] for r in c}
    want = {r["commit"] for r in c if not r["parents"] or all(role.get(p) != r["author_name"] for p in r["parents"])}
    assert {r["commit"] for r in Q.f10(spark, sf_dir).collect()} == want


def test_walk_and_log(spark, sf_dir):
    c = V.commits(spark, sf_dir)
    rows = {r["commit"]: r for r in c.collect()}
    last = max(rows, key=lambda k: rows[k]["committer_secs"])
    tip = spark.createDataFrame([(last,)], "commit string")
    seen, todo = set(), [last]
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += [p for p in rows[k]["parents"] if p in rows]
    page, more = L.log(tip, c, V.edges(c), limit=10)
    want = sorted(seen, key=lambda k: (-rows[k]["committer_secs"], k))[:10]
    assert [r["commit"] for r in page.collect()] == want and more == (len(seen) > 10)


def drive(machine, events):
    return [a for e in events if (a := machine.see(e)) is not None]


def test_detectors():
    w = drive(Z.WalkDetector(), [{"at": t, "path": p} for t, p in ((0, "a/b/c"), (0.5, "a/b/d"), (1, "a/x"), (1.5, "a/b"), (1.6, "q"))])
    assert w == [(1.5, "a")]
    r = drive(Z.ReadDetector(), [{"at": t, "path": p} for t, p in ((0, "d/1"), (1, "d/1"), (2, "d/2"), (3, "d/3"), (4, "d/4"), (50, "d/5"))])
    assert r == [(3, "d")]
    b = drive(Z.Budget(10), [{"seq": i, "oid": o, "size": s} for i, (o, s) in enumerate((("a", 6), ("b", 6), ("a", 6), ("c", 4)))])
    assert b == [(0, "admitted", 6), (1, "refused", 6), (2, "refetch", 6), (3, "admitted", 10)]
    v = drive(Z.Verdicts(), [{"seq": i, "commit": "x", "visible": s, "at": t, "generation": g} for i, (s, t, g) in enumerate(((True, 0, 1), (False, 5, 1), (False, 6, 2), (True, 7, 2), (True, 9, 2)))])
    assert [x[1] for x in v] == ["computed", "cached", "computed", "cached", "computed"]


@pytest.mark.parametrize("name", ["t5", "t6", "t7", "t8"])
def test_folded_detectors_against_python(spark, sf_dir, name, monkeypatch):
    seen = {}
    fold = Z.fold
    monkeypatch.setattr(Z, "fold", lambda e, key, order, make, schema: seen.update(e=e, key=key, order=order, make=make) or fold(e, key, order, make, schema))
    got = sorted(map(str, (tuple(r) for r in getattr(Q, name)(spark, sf_dir).collect())))
    groups = defaultdict(list)
    for r in seen["e"].collect():
        groups[r[seen["key"]]].append(r.asDict())
    want = []
    for k, rows in groups.items():
        rows.sort(key=lambda r: [r[o] for o in seen["order"]])
        want += [(k, *a) for a in drive(seen["make"](), rows)]
    assert got == sorted(map(str, want)) and got


def test_read_sessions_against_python(spark, sf_dir):
    rows = sorted((r["user_id"], r["ts"], r["event_id"] % 5) for r in V.table(spark, sf_dir, "events").collect())
    want, current = 0, None
    for user, ts, name in rows:
        if current and current[0] == user and (ts - current[1]).total_seconds() < 6 * 3600:
            current = (user, ts, current[2] | {name})
        else:
            want += bool(current and len(current[2]) >= 3)
            current = (user, ts, {name})
    want += len(current[2]) >= 3
    assert Q.w9(spark, sf_dir).count() == want


def test_stream_of_refs_equals_batch(spark, sf_dir, tmp_path):
    o = V.ref_observations(spark, sf_dir).select("ref_name", "seq", "new_oid")
    o.where("seq < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    o.where("seq >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "ref_name string, seq long, change string, old_oid string, new_oid string"
    s = Z.stream(spark.readStream.schema(o.schema).parquet(str(tmp_path / "in")), "ref_name", "seq", Z.RefState, schema)
    q = s.writeStream.format("memory").queryName("ref_changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, (tuple(r) for r in spark.table("ref_changes").collect())))
    want = sorted(map(str, (tuple(r) for r in Z.fold(o, "ref_name", ["seq"], Z.RefState, schema).collect())))
    assert got == want and got


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, mode int, oid string, size long, content string, blob_key long, present boolean, kind string, opaque boolean, renamed_from string, base_oid string, base_mode int")
    from revlake.operators import overlay as O

    assert T.diff(none, none).count() == T.delta(none, none).count() == T.list_directory(none, "").count() == T.recursive_counts(none).count() == 0
    assert O.status(none).count() == O.merged(none, none).count() == O.resolve(none, none).count() == 0
    page, done = S.search(none.select("path", "blob_key"), X.registry(none.select("blob_key", "content", "size", "oid")), None, S.Query("x"))
    assert page.count() == 0 and done.first()["eligible_paths"] == 0 and done.first()["execution_status"] == "COMPLETE"


def test_command_lines():
    from revlake.plans.commands import Refused, diff_arguments, find_options, search_query

    q = search_query(["-F", "-i", "-C", "200", "-g", "*.rs", "-g", "!target/", "a+b", "./src/"])
    assert (q.pattern, q.literal, q.fold, q.scope, q.include, q.exclude, q.context) == ("a+b", True, True, "src", ("*.rs",), ("target/",), (64, 64))
    for bad in (["--unknown", "x"], [], ["a", "b", "c"]):
        with pytest.raises(Refused):
            search_query(bad)
    assert find_options([".", "-type", "d", "-maxdepth", "2", "-print"]) == {"start": "", "kind": "d", "maxdepth": 2}
    for bad in (["-newer", "x"], ["-type", "l"], ["-name"]):
        with pytest.raises(Refused):
            find_options(bad)
    assert diff_arguments([]) == (None, None) and diff_arguments(["a"]) == ("a", None) and diff_arguments(["a..b"]) == diff_arguments(["a", "b"]) == ("a", "b")
    for bad in (["a...b"], ["a", "b", "c"], ["a..", "b"]):
        with pytest.raises(Refused):
            diff_arguments(bad)


def test_written_index(spark, sf_dir, tmp_path):
    f = V.files(spark, sf_dir)
    b = X.registry(f.select(F.col("doc_id").alias("blob_key"), "oid", "size", "content"))
    X.write_index(str(tmp_path / "i"), X.postings(b), b, T.build_manifest(V.manifest(spark, sf_dir, 1)), "rev-1")
    state = X.write_index(str(tmp_path / "i"), X.postings(b), b, T.build_manifest(V.manifest(spark, sf_dir, 2)), "rev-2")
    assert {(r["commit"], r["state"]) for r in state.collect()} == {("rev-1", "READY"), ("rev-2", "READY")}
    m, kept, p = X.read_index(spark, str(tmp_path / "i"), "rev-1")
    assert kept.count() == b.count() and "content" not in kept.columns
    want = S.search(V.manifest(spark, sf_dir, 1), b, None, S.Query("tion", results=500, context=(1, 1), line_bytes=20))[0].collect()
    for _ in range(2):  # a build that is written again replaces itself
        page, _ = S.search(m, kept, p, S.Query("tion", results=500, context=(1, 1), line_bytes=20), b.select("blob_key", "content"))
        assert page.collect() == want and len(want) == 500 and max(len(x.encode()) for r in want for x in (*r["before"], *r["after"])) <= 20
        n = p.count()
        X.write_index(str(tmp_path / "i"), X.postings(b), b, T.build_manifest(V.manifest(spark, sf_dir, 1)), "rev-1")
        m, kept, p = X.read_index(spark, str(tmp_path / "i"), "rev-1")
        assert p.count() == n
    with pytest.raises(ValueError):
        X.read_index(spark, str(tmp_path / "i"), "rev-9")


def test_numbers_are_stable_when_partitions_are_coalesced(spark):
    rows = [(f"o{i % 700}", i) for i in range(2000)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = {r["oid"]: r["blob_key"] for r in X.intern(spark.createDataFrame([("o5", 3)], "oid string, blob_key long"), spark.createDataFrame(rows, "oid string, pos long")).collect()}
        fresh = [o for o, _ in rows[:700] if o != "o5"]
        assert got == {"o5": 3} | {o: 4 + k for k, o in enumerate(fresh)}
        patches = spark.createDataFrame([(f"p{i:04}", "x" * 10) for i in range(1000)], "path string, patch string")
        page, more = D.capped(patches, 5000)
        assert more and [r["path"] for r in page.collect()] == [f"p{i:04}" for i in range(500)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_bundle_files(spark, sf_dir, tmp_path):
    from revlake.operators import export as B

    changes = O.status(V.overlay(spark, sf_dir))
    patches = changes.select("path", F.lit("p").alias("patch"))
    B.write_bundle(str(tmp_path / "b"), changes, patches)
    assert spark.read.parquet(str(tmp_path / "b" / "manifest")).count() == changes.count() == spark.read.text(str(tmp_path / "b" / "changes")).count()


def test_blame_lines_and_caps_of_queries(spark, sf_dir):
    from revlake.plans import more_queries as M

    hunks = Q.h9(spark, sf_dir).collect()
    want = sorted((r["path"], k, r["version"], r["orig_start"] + k - r["start"]) for r in hunks for k in range(r["start"], r["start"] + r["lines"]) if k <= 5)
    assert sorted(tuple(r) for r in M.w13(spark, sf_dir).collect()) == want
    total = defaultdict(int)
    for r in hunks:
        total[r["path"]] += r["lines"]
    assert {r["path"]: (r["width"], r["lines"]) for r in M.a16(spark, sf_dir).collect()} == {p: (1, n) for p, n in total.items()}
    sections = sorted((r["path"], r["patch"]) for r in Q.h8(spark, sf_dir).collect())
    kept, held = [], 0
    for path, patch in sections:
        held += len(patch.encode())
        if held <= 20_000:
            kept.append((path, patch))
    assert [tuple(r) for r in M.l11(spark, sf_dir).collect()] == kept
