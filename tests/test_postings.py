"""Posting lists as bitmaps against plain sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revlake.functions import patterns as R
from revlake.operators import index as X


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(2)
    # keys of three chunks, the first and last key of each among them
    keys = sorted({0, 32_767, 32_768, 65_535, 65_536, *(rng.randrange(70_000) for _ in range(300))})
    rows = [(k, "".join(rng.choice("abAB") for _ in range(rng.randrange(0, 40))), rng.random() > 0.1) for k in keys]
    return spark.createDataFrame(rows, "blob_key long, content string, indexed boolean").repartition(5)


def lists(blobs):
    out = {}
    for r in blobs.where("indexed").collect():
        for t in R.trigrams(r["content"]):
            out.setdefault(t, set()).add(r["blob_key"])
    return out


def test_bitmaps_hold_the_lists(spark, blobs):
    want = lists(blobs)
    made = X.postings(blobs)
    assert made.count() == len({(t, k // X.CHUNK) for t, ks in want.items() for k in ks})
    got = {}
    for r in X.posting_rows(made).collect():
        got.setdefault(r["trigram"], set()).add(r["blob_key"])
    assert got == want
    sums = made.groupBy("trigram").agg(F.sum(F.bitmap_count("bits")).alias("n"), F.min(X.first_key()).alias("first")).collect()
    assert {r["trigram"]: (r["n"], r["first"]) for r in sums} == {t: (len(k), min(k)) for t, k in want.items()}


def test_merged_bitmaps(spark, blobs):
    a, b = X.postings(blobs.where("blob_key % 3 <> 0")), X.postings(blobs.where("blob_key % 3 <> 1"))
    one = {(r["trigram"], r["blob_key"]) for r in X.posting_rows(X.merge_postings(a, b)).collect()}
    assert one == {(t, k) for t, ks in lists(blobs).items() for k in ks}


@pytest.mark.parametrize(("literals", "fold"), [(["abab"], False), (["abAB", "bbb"], False), (["abab"], True), (["zzzz"], False), (["aaa", "bab"], True)])
def test_candidates_hold_every_trigram(spark, blobs, literals, fold):
    rows = blobs.where("indexed").collect()
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    want = {r["blob_key"] for r in rows for x in literals if all(low(x[i : i + 3]) in low(r["content"]) for i in range(len(x) - 2))}
    got = [r["blob_key"] for r in X.candidates(X.postings(blobs), literals, blobs, fold).collect()]
    assert sorted(got) == sorted(want)


def test_no_blobs(spark, blobs):
    none = X.postings(blobs.limit(0))
    assert none.count() == 0 and X.candidates(none, ["abc"], blobs).count() == 0
