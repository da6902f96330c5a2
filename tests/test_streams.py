"""Lease timers and the outbox: streams and restarts against batch folds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revlake.operators import catalog as C
from revlake.streaming import leases as L
from revlake.streaming.outbox import Outbox, table_sink


def events_of(rng, leases=12, span=200_000):
    rows = []
    for m in range(leases):
        at = rng.randrange(1000)
        for k in range(rng.randrange(1, 40)):
            rows.append((m, at, "create" if k == 0 else rng.choice(("renew",) * 12 + ("fail", "release", "other"))))
            at += rng.choice((60, 600, 1500, 2000, 2699, 2700, 2701, 2702, 90_000))
    rows = sorted((r for r in rows if r[1] < span), key=lambda r: r[1])
    return [(m, i, at, op) for i, (m, at, op) in enumerate(rows)]


def folded(rows, until):
    """Second by second semantics: an ACTIVE lease is swept at each event and at the end."""
    out = []
    for m in {r[0] for r in rows}:
        state, expires, born, ended = None, 0, 0, None
        for _, _, at, op in [*sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])), (m, 0, until, "sweep")]:
            if state == "ACTIVE" and at > expires + C.GRACE:
                state, ended = "EXPIRED", expires + C.GRACE
                out.append((m, ended, "EXPIRED"))
            if state in ("EXPIRED", "RELEASED") and at >= ended + C.PRUNE:
                state = "PRUNABLE"
                out.append((m, ended + C.PRUNE, "PRUNABLE"))
            if op == "create" and state is None:
                state, born, expires = "ACTIVE", at, at + C.TTL
                out.append((m, at, "ACTIVE"))
            elif op == "renew" and state == "ACTIVE" and at - born <= C.MOST_AGE:
                expires = max(expires, at + C.TTL)
            elif op == "release" and state == "ACTIVE":
                state, ended = "RELEASED", at
                out.append((m, at, "RELEASED"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_of_a_table(spark, seed):
    rows = events_of(random.Random(seed), 40)
    until = max(r[2] for r in rows)
    d = spark.createDataFrame(rows, "mount_id long, seq long, at long, op string").repartition(5)
    want = folded(rows, until)
    assert sorted(map(tuple, L.changes(d, until).collect())) == want and {c for _, _, c in want} == {"ACTIVE", "EXPIRED", "RELEASED", "PRUNABLE"}
    assert L.changes(d.limit(0), until).collect() == []


def test_a_stream_with_restarts_equals_the_table(spark, tmp_path):
    """Three runs from one checkpoint; what only time brings about comes from timers on the watermark."""
    rows = events_of(random.Random(3), 8)
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        d = spark.createDataFrame(rows, "mount_id long, seq long, at long, op string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
        times = sorted({r[2] for r in rows})
        edges = [times[0], times[len(times) // 3], times[2 * len(times) // 3], times[-1] + 1]
        for a, b in zip(edges, edges[1:]):
            d.where((F.unix_timestamp("ts") >= a) & (F.unix_timestamp("ts") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = L.stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "0 seconds")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.set(key, was)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("mount_id", "at", "change").collect()))
    want = folded(rows, max(r[2] for r in rows))
    assert got == want and any(c == "EXPIRED" for _, _, c in want)


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_drain_loses_nothing_and_repeats_nothing(spark, tmp_path, when):
    """Killed while a batch is handed over, or between hand-over and mark, while new events keep coming."""
    box = Outbox(spark, str(tmp_path / "box"))
    put = table_sink(str(tmp_path / "sink"))
    seen = []

    def dying(batch, number):
        if when == "after":
            put(batch, number)
        raise Killed

    events = lambda n: spark.range(n).select((F.col("id") * 3 + 1).alias("event_id"), F.concat(F.lit("e"), "id").alias("name"))
    assert box.hand_over(events(10), put, 4) == 10
    with pytest.raises(Killed):
        box.hand_over(events(10), dying, 4)
    assert box.high_water() == 10
    again = Outbox(spark, str(tmp_path / "box"))  # another process
    assert again.hand_over(events(20), lambda b, n: (seen.append((n, b.count())), put(b, n)), 4) == 22 and seen == [(22, 4)]
    assert again.drain(events(20), put, 5) == 3 and again.drain(events(20), put, 5) == 0
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect())
    assert got == [3 * k + 1 for k in range(20)]


def test_pending_events_are_the_oldest(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "none"))
    e = spark.range(9).select(F.col("id").alias("event_id"))
    assert box.high_water() == -1 and [r["event_id"] for r in box.pending(e, 3).collect()] == [0, 1, 2]
    assert box.hand_over(e.limit(0), lambda *_: None, 3) is None
