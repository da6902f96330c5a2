"""One answer over a base and the overlay on it: order, pages, coverage, budgets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from revlake.operators import index as X
from revlake.operators import overlay as O
from revlake.operators import search as S

ROW = "path string, present boolean, kind string, opaque boolean, oid string, mode int, size long, renamed_from string, base_oid string, base_mode int"
BASE = [(1, "a.txt", "one hit\nhit hit"), (2, "b/old.txt", "hit"), (3, "c/gone.txt", "hit"), (4, "d/edited.txt", "hit"), (5, "e/masked.txt", "hit"), (6, "z.txt", "last hit"), (7, "f/bin", "\0hit")]
OVER = [("b/old.txt", False, None), ("m/new.txt", True, "b/old.txt"), ("c/gone.txt", False, None), ("d/edited.txt", True, None), ("k/own.txt", True, None), ("k/own.bin", True, None), ("n/moved-edited.txt", True, "d/edited.txt")]
LOCAL = {"m/new.txt": "hit", "d/edited.txt": "no\nhit here", "k/own.txt": "hit\n", "k/own.bin": "\0", "n/moved-edited.txt": "hit, but edited"}


@pytest.fixture(scope="module")
def halves(spark):
    base = spark.createDataFrame([(k, p, c, f"oid-{c}") for k, p, c in BASE], "blob_key long, path string, content string, oid string").withColumn("size", F.octet_length("content").cast("long"))
    rows = [(p, here, "file", False, f"oid-{LOCAL[p]}" if here else None, 0o100644, 1, src, None, None) for p, here, src in OVER] + [("e", True, "directory", True, None, None, None, None, None, None)]
    over = O.with_base_bytes(spark.createDataFrame(rows, ROW), base)
    files = spark.createDataFrame(list(LOCAL.items()), "path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    return base, X.registry(base.select("blob_key", "oid", "size", "content")), over, files


WANT = [("a.txt", 1, 5, "base"), ("a.txt", 2, 1, "base"), ("a.txt", 2, 5, "base"), ("d/edited.txt", 2, 1, "local"), ("k/own.txt", 1, 1, "local"), ("m/new.txt", 1, 1, "base"), ("n/moved-edited.txt", 1, 1, "local"), ("z.txt", 1, 6, "base")]


def answer(halves, budget=None, **more):
    base, blobs, over, files = halves
    page, done = S.merged_answer(base.select("path", "blob_key"), blobs, X.postings(blobs), over, files, S.Query("hit", **more), budget=budget or S.LocalBudget())
    return [tuple(r) for r in page.select("path", "line", "column", "source").collect()], done.first()


def test_results_from_both_halves_are_merged_into_one_path_order(halves):
    got, done = answer(halves)
    assert got == WANT
    # a.txt, m/new.txt and z.txt of the base, three local files; a binary file on each side
    assert (done["execution_status"], done["truncation"], done["eligible_paths"], done["excluded"]) == ("COMPLETE", None, 6, {"binary": 2})
    assert done["candidates_considered"] == 3


def test_pages_resume_and_tell_that_there_is_more(halves):
    seen, after = [], None
    while True:
        got, done = answer(halves, results=3, after=after)
        seen += got
        assert (done["truncation"] == "result_limit") == (len(seen) < len(WANT))
        if done["execution_status"] == "COMPLETE":
            break
        after = got[-1][:3]
    assert seen == WANT


def test_local_budgets_truncate_the_whole_answer(halves):
    got, done = answer(halves, S.LocalBudget(read_bytes=5))
    assert got == [x for x in WANT if x[0] not in ("k/own.txt", "n/moved-edited.txt")] and done["execution_status"] == "TRUNCATED"
    got, done = answer(halves, S.LocalBudget(results=1))
    assert [x for x in got if x[3] == "local"] == WANT[3:4] and done["truncation"] == "result_limit"


def test_scope_goes_by_the_names_of_the_merged_tree(halves):
    assert answer(halves, scope="m")[0] == [("m/new.txt", 1, 1, "base")] and answer(halves, scope="b")[0] == []


def test_context_and_nothing(halves, spark):
    base, blobs, over, files = halves
    page, _ = S.merged_answer(base.select("path", "blob_key"), blobs, None, over, files, S.Query("hit", context=(1, 1), include=("d/**",)))
    assert [(r["path"], r["before"], r["after"]) for r in page.collect()] == [("d/edited.txt", ["no"], [])]
    page, done = S.merged_answer(base.select("path", "blob_key").limit(0), blobs, None, over.limit(0), files.limit(0), S.Query("hit"))
    assert page.collect() == [] and done.first()["eligible_paths"] == 0
