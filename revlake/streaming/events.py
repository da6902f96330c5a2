"""Structured Streaming jobs over event tables: windows with late data, sessions and renewals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` in tumbling windows; on a stream events later than ``late`` are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_sessions(accesses: DataFrame, gap: str = "30 seconds", distinct: int = 3) -> DataFrame:
    """``dir, start, files`` of sessions of one directory that read at least ``distinct`` different files."""
    e = accesses.withWatermark("ts", gap) if accesses.isStreaming else accesses
    # distinct names are a set, as a stream has no exact distinct count; it is bounded by the files of a directory
    out = e.groupBy("dir", F.session_window("ts", gap).alias("s")).agg(F.size(F.collect_set("name")).cast("long").alias("files"))
    return out.where(F.col("files") >= distinct).select("dir", F.col("s.start").alias("start"), "files")


def renewals(events: DataFrame, ttl: int) -> DataFrame:
    """``mount_id, expires_at`` of a stream or table of renewals; one that arrives late never moves it backwards."""
    return events.where("op in ('create', 'renew')").groupBy("mount_id").agg((F.max("at") + ttl).alias("expires_at"))
