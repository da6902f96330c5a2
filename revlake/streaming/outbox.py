"""Draining an outbox of events: each batch is handed over once in effect, whenever the drain is killed.

A batch is a range of event ids.  Its range is written down before it is handed over and its end is marked afterwards, each as a
small table in the shared folder.  A drain that finds a range without a mark hands over that same range again, under
the same number, so a sink that replaces what it has under a number holds every event once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Outbox:
    """The ranges and marks of one outbox, in ``folder``."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, kind: str) -> list[tuple[int, int]]:
        path = f"{self.folder}/{kind}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return []
        last = self.spark.read.parquet(path).orderBy(F.col("last").desc()).limit(2).collect()
        return [(r["after"], r["last"]) for r in last]

    def _write(self, kind: str, after: int, last: int) -> None:
        self.spark.createDataFrame([(after, last)], "after long, last long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{kind}/upto={last}")

    def high_water(self) -> int:
        """The id up to which events were handed over and marked; -1 before the first."""
        return max((last for _, last in self._read("marks")), default=-1)

    def pending(self, events: DataFrame, limit: int) -> DataFrame:
        """The unmarked events, oldest first, at most ``limit``; ``event_id`` grows."""
        return events.where(F.col("event_id") > self.high_water()).orderBy("event_id").limit(limit)

    def hand_over(self, events: DataFrame, handle: Callable[[DataFrame, int], object], limit: int) -> int | None:
        """Hand the next batch to ``handle(batch, number)`` and mark it; its number, or None if nothing is pending."""
        mark = self.high_water()
        open_ = [r for r in self._read("ranges") if r[1] > mark]
        if open_:
            after, last = open_[0]
        else:
            top = self.pending(events, limit).agg(F.max("event_id").alias("last")).first()["last"]
            if top is None:
                return None
            after, last = mark, top
            self._write("ranges", after, last)
        handle(events.where(F.col("event_id").between(after + 1, last)), last)
        self._write("marks", after, last)
        return last

    def drain(self, events: DataFrame, handle: Callable[[DataFrame, int], object], limit: int) -> int:
        """Hand over all that is pending; how many batches there were."""
        n = 0
        while self.hand_over(events, handle, limit) is not None:
            n += 1
        return n


def table_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that holds each batch under its number and replaces one that comes again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return put
