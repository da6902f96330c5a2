"""Every registered query against its SQL on the smallest tables; the others against brute force elsewhere."""

from __future__ import annotations

import duckdb
import pytest

from revlake.plans import graph_queries, more_queries, registry, search_queries, tree_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows, columns):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in by) for r in rows), [columns[i] for i in by]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(registry.SQL[name])
    want = ordered(found.fetchall(), [c[0] for c in found.description])
    assert got == want


def test_every_query_has_sql_or_a_test():
    by_hand = {"a8_diffstat", "h8_patches", "h9_blame", "t5_walks", "t6_reads", "w13_blame_lines", "a16_blame_widths", "l11_capped_patch", "e30_quoted", "k4_bundle_records"}
    assert set(registry.QUERIES) - set(registry.SQL) == by_hand
