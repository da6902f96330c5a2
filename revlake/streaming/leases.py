"""The life of leases, event by event: the same state machine over a table and over a stream.

A lease is ACTIVE from its creation, is extended by renewals, and ends RELEASED or, when no renewal came until the grace after its
expiry, EXPIRED; some time after its end its anchor may be pruned.  What only time brings about is a timer on the stream's
watermark; over a table it is looked at before each later event and once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.operators.catalog import GRACE, MOST_AGE, PRUNE, TTL

CHANGES = "mount_id long, at long, change string"
STATE = "state string, born long, expires long, failures int, ended long"


class Lease:
    """One lease; ``see`` and ``wait`` return the changes ``(at, change)`` that an event or the passing of time brings about."""

    def __init__(self, state: str = "", born: int = 0, expires: int = 0, failures: int = 0, ended: int = 0):
        self.state, self.born, self.expires, self.failures, self.ended = state, born, expires, failures, ended

    def kept(self) -> tuple:
        return (self.state, self.born, self.expires, self.failures, self.ended)

    def deadline(self) -> int | None:
        """When time alone changes the lease next: the last second at which it does not."""
        return {"ACTIVE": self.expires + GRACE, "RELEASED": self.ended + PRUNE - 1, "EXPIRED": self.ended + PRUNE - 1}.get(self.state)

    def wait(self, now: int) -> Iterator[tuple[int, str]]:
        while (end := self.deadline()) is not None and now > end:
            if self.state == "ACTIVE":
                self.state, self.ended = "EXPIRED", end
                yield end, "EXPIRED"
            else:
                self.state = "PRUNABLE"
                yield end + 1, "PRUNABLE"

    def see(self, op: str, at: int) -> Iterator[tuple[int, str]]:
        yield from self.wait(at)
        if op == "create" and not self.state:
            self.state, self.born, self.expires = "ACTIVE", at, at + TTL
            yield at, "ACTIVE"
        elif op == "renew" and self.state == "ACTIVE" and at - self.born <= MOST_AGE:
            self.expires, self.failures = max(self.expires, at + TTL), 0
        elif op == "release" and self.state == "ACTIVE":
            self.state, self.ended = "RELEASED", at
            yield at, "RELEASED"
        elif op == "fail":
            self.failures += 1


def changes(events: DataFrame, until: int) -> DataFrame:
    """``mount_id, at, change`` of a table of events (``mount_id, seq, at, op``) looked at from ``until``.

    Events are dealt by lease and sorted; a task holds one lease's state at a time.
    """

    def run(batches):
        import pandas as pd

        out: list[tuple] = []
        mount, lease = None, Lease()
        for batch in batches:
            for key, at, op in zip(batch["mount_id"].tolist(), batch["at"].tolist(), batch["op"].tolist(), strict=True):
                if key != mount:
                    out += [(mount, *c) for c in lease.wait(until)]
                    mount, lease = key, Lease()
                out += [(key, *c) for c in lease.see(op, at)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["mount_id", "at", "change"])
                out = []
        out += [(mount, *c) for c in lease.wait(until)]
        yield pd.DataFrame(out, columns=["mount_id", "at", "change"]).astype({"mount_id": "int64", "at": "int64"}) if out else pd.DataFrame({"mount_id": pd.Series(dtype="int64"), "at": pd.Series(dtype="int64"), "change": pd.Series(dtype="str")})

    dealt = events.select("mount_id", "seq", "at", "op").repartition("mount_id").sortWithinPartitions("mount_id", "at", "seq")
    return dealt.mapInPandas(run, CHANGES)


def stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``mount_id, at, change`` of a stream of events (``mount_id, seq, ts, op``): expiry and pruning are event-time timers.

    The session's state store must be the one on disk (RocksDB), which holds timers; ``late`` is how long events may be out of order.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.lease = handle.getValueState("lease", STATE)

        def _lease(self) -> Lease:
            return Lease(*self.lease.get()) if self.lease.exists() else Lease()

        def _done(self, key, lease: Lease, found: list) -> Iterator[pd.DataFrame]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if lease.state == "PRUNABLE":
                self.lease.clear()  # nothing can happen to it any more
                self.lease.update(lease.kept())
            else:
                self.lease.update(lease.kept())
                if (end := lease.deadline()) is not None:
                    self.handle.registerTimer((end + 1) * 1000)
            if found:
                yield pd.DataFrame([(key[0], *c) for c in found], columns=["mount_id", "at", "change"])

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            lease, found = self._lease(), []
            held = pd.concat(list(rows), ignore_index=True)
            held["at"] = held["ts"].map(lambda t: int(t.timestamp()))
            for r in held.sort_values(["at", "seq"]).itertuples():
                found += lease.see(r.op, r.at)
            yield from self._done(key, lease, found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            lease = self._lease()
            found = list(lease.wait(expiredTimerInfo.getExpiryTimeInMs() // 1000))
            yield from self._done(key, lease, found)

        def close(self) -> None:
            pass

    keyed = events.select("mount_id", "seq", "ts", "op").withWatermark("ts", late).groupBy("mount_id")
    return keyed.transformWithStateInPandas(Processor(), CHANGES, "append", "EventTime")


def sweep_report(changed: DataFrame) -> DataFrame:
    """``outcome, leases, first_lease``: what a sweep over all changes finds, by each lease's last change."""
    last = changed.groupBy("mount_id").agg(F.max_by("change", F.struct("at", (F.col("change") == "PRUNABLE").cast("int"))).alias("outcome"))
    return last.groupBy("outcome").agg(F.count("*").alias("leases"), F.min("mount_id").alias("first_lease"))
