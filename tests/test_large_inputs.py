"""What shows only on other tables than the given ones: queries against their SQL on tables made for it, and bounds of tasks."""

from __future__ import annotations

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import ordered
from test_renames import greedy, scores, versions

from revlake.functions import paths as P
from revlake.functions import patterns as R
from revlake.operators import index as X
from revlake.operators import renames as N
from revlake.operators import search as S
from revlake.plans import registry


@pytest.fixture
def equals_sql(spark, tmp_path):
    def check(name: str, documents: list[tuple[int, str, str, str]]) -> None:
        spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = ordered([tuple(r) for r in df.collect()], df.columns)
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        found = con.execute(registry.SQL[name])
        assert got == ordered(found.fetchall(), [c[0] for c in found.description])

    return check


@pytest.mark.parametrize("lang", ["en", "fr"])
def test_rule_sources_of_one_directory(equals_sql, lang):
    equals_sql("s15_rule_sources", [(1, "a", lang, "src1"), (21, "b", "en", "src1"), (41, "c", "fr", "src1")])


def test_context_of_whole_lines(equals_sql):
    equals_sql("w1_context", [(1, "é" * 9000 + "\nnden\n" + "x" * 9000, "en", "src1")])


def test_merged_completion_has_no_budget(equals_sql):
    equals_sql("x11_merged_completion", [(k, "tiont and tiont\n" * 400, "en", f"src{k % 20}") for k in range(30)])


def test_quoted_bytes(spark):
    names = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def quoted(raw: bytes) -> str:
        if all(32 <= c < 127 and c not in (34, 92) for c in raw):
            return raw.decode()
        return '"' + "".join(names.get(c) or (chr(c) if 32 <= c < 127 else f"\\{c:03o}") for c in raw) + '"'

    raws = [bytes([c]) for c in range(256)] + [bytes(range(256)), b"", b"plain", b"\n\n", "é\n".encode() * 50_000]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary").select("i", P.quoted("a/", "raw").alias("q"))
    assert dict(rows.collect()) == {i: quoted(b"a/" + r) for i, r in enumerate(raws)}


def test_parts_of_a_batch_are_bounded():
    """A match shows its line, so the matches of a whole batch can take the square of a line."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([b"x" * R.STEP, b"", None, b"y"])], names=["k", "v"])
    assert [p.num_rows for p in R.parts(batch, 1)] == [3, 1]


def test_stray_bytes_by_line(spark):
    rows = [(1, b"\xffone\ntwo\n\nlast\xc3"), (2, "é\nü\n".encode()), (3, b""), (4, "a\U0010ff80b\nc".encode())]
    files = spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "blob_key long, content binary").select("blob_key", F.col("content").cast("string").alias("content"))
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(S.text_lines(files)) == get(S.line_rows(S.as_text(files)))


def test_page_takes_only_its_lines_apart(spark, monkeypatch):
    seen = []
    whole = S.occurrences
    monkeypatch.setattr(S, "occurrences", lambda lines, query: seen.append(lines.count()) or whole(lines, query))
    files = spark.createDataFrame([(k, f"d/{k:03}", "eau eau\n" * 20) for k in range(50)], "blob_key long, path string, content string")
    blobs = X.registry(files.select("blob_key", "content", F.octet_length("content").cast("long").alias("size")))
    page, _ = S.search(files.select("path", "blob_key"), blobs, None, S.Query("eau", after=("d/007", 20, 1), results=5))
    assert [tuple(r) for r in page.select("path", "line", "column").collect()] == [("d/007", 20, 5), ("d/008", 1, 1), ("d/008", 1, 5), ("d/008", 2, 1), ("d/008", 2, 5)]
    assert seen[0] <= 7


@pytest.mark.parametrize(("seed", "rare", "few"), [(1, 1, 1 << 17), (2, 3, 5)])
def test_renames_of_common_chunks_are_exact(spark, monkeypatch, seed, rare, few):
    """Whatever the cells, each pair is found once and the best come first."""
    gone, come = versions(random.Random(seed))
    a, b = (spark.createDataFrame(list(x.items()), "path string, content string").repartition(3) for x in (gone, come))
    for name, value in (("LOT", 2), ("RARE", rare), ("FEW", few)):
        monkeypatch.setattr(N, name, value, raising=False)
    assert [(r["from"], r["to"]) for r in N.matched(a, b).orderBy(F.desc("score"), "to").collect()] == sorted(greedy(scores(gone, come, 50)), key=lambda k: (-scores(gone, come, 50)[k], k[1]))


def test_trigrams_of_long_contents_in_little_memory(spark):
    class Task:
        """Hands out what a task runs."""

        select = where = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    rng = random.Random(9)
    contents = [rng.randbytes(6 << 20), b"", None, b"ab", b"abc" * (1 << 20)] + [rng.randbytes(4096) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(contents)), pa.int64()), pa.array(contents, pa.binary())], names=["blob_key", "content"])
    run = R.trigram_rows(Task())
    want = [np.frombuffer(c or b"", np.uint8).astype(np.int64) for c in contents]
    want = np.concatenate([np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) | k << 24 for k, b in enumerate(want) if len(b) > 2])
    got = np.concatenate([out.column("trigram").to_numpy() | out.column("blob_key").to_numpy() << 24 for out in run([batch])])
    assert np.array_equal(np.sort(got), want)
    tracemalloc.start()
    most = max(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1 << 20 and peak < 64 << 20


def test_budgets_are_spent_behind_the_position(spark):
    files = spark.createDataFrame([(k, f"d/{k:03}", "eau\n") for k in range(50)], "blob_key long, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    blobs = X.registry(files.select("blob_key", "content", "size"))
    get = lambda page: [r["path"] for r in page.select("path").collect()]
    for more in ({"candidates": 4}, {"read_bytes": 16}):
        page, done = S.search(files.select("path", "blob_key"), blobs, None, S.Query("eau", after=("d/040", 1, 0), results=3, **more))
        assert get(page) == ["d/040", "d/041", "d/042"] and done.first()["eligible_paths"] == 50
    page, outcome = S.local_page(files.select("path", "content", "size"), S.Query("eau", after=("d/040", 1, 0), results=3), budget=S.LocalBudget(read_bytes=16))
    assert get(page) == ["d/040", "d/041", "d/042"] and outcome.first()["truncated"]


@pytest.mark.parametrize("name", ["l3_resumed_page", "x8_search", "x8_search_unindexed", "x8_completion", "k6_rendered", "w3_display_budget", "x18_command_line", "a2_completion_stats", "x11_merged_page"])
def test_no_budget_where_the_sql_has_none(equals_sql, monkeypatch, name):
    monkeypatch.setattr(S, "READ_BYTES", 50)
    monkeypatch.setattr(S, "MOST_CANDIDATES", 2)
    equals_sql(name, [(k, "eauq and quill\ntionth\n", "fr", f"src{k % 20}") for k in range(90)])
