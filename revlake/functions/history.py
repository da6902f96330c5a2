"""Commit fields and dates as columns; clamped times; outcome and error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions.paths import col

#: Nanoseconds per second, and the earliest time a snapshot may carry (1990-01-01).
NANOS, EARLIEST = 1_000_000_000, 631_152_000


def hex_of(oid: Column | str) -> Column:
    return F.element_at(F.split(col(oid), ":"), -1)


def short(oid: Column | str) -> Column:
    return F.substring(hex_of(oid), 1, 7)


def subject(message: Column | str) -> Column:
    return F.element_at(F.split(col(message), "\n"), 1)


def body(message: Column | str) -> Column:
    """What follows the first line and one blank line."""
    m = col(message)
    rest = F.when(F.instr(m, "\n") > 0, F.substring(m, F.instr(m, "\n") + 1, F.length(m))).otherwise(F.lit(""))
    return F.regexp_replace(rest, r"\A\n", "")


def _local(secs, tz_minutes) -> Column:
    return F.timestamp_seconds(col(secs) + col(tz_minutes).cast("long") * 60)


def offset(tz_minutes: Column | str, colon: bool = False) -> Column:
    t = col(tz_minutes).cast("int")
    size = F.abs(t)
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.when(t < 0, "-").otherwise("+"), part(F.floor(size / 60)), F.lit(":" if colon else ""), part(size % 60))


def date_default(secs, tz_minutes) -> Column:
    """``Thu Apr 7 15:13:13 2005 -0700`` in the author's own offset (the session runs in UTC)."""
    return F.concat(F.date_format(_local(secs, tz_minutes), "EEE MMM d HH:mm:ss yyyy "), offset(tz_minutes))


def date_iso(secs, tz_minutes) -> Column:
    return F.concat(F.date_format(_local(secs, tz_minutes), "yyyy-MM-dd HH:mm:ss "), offset(tz_minutes))


def date_strict(secs, tz_minutes) -> Column:
    return F.concat(F.date_format(_local(secs, tz_minutes), "yyyy-MM-dd'T'HH:mm:ss"), offset(tz_minutes, True))


def date_relative(secs, now) -> Column:
    """``3 weeks ago``; a month is 30 days 10.5 hours, a year 365.25 days, and past a year months are named too."""
    d = col(now) - col(secs)
    hour, day = 3600, 86400
    month, year = 30 * day + 10 * hour + 1800, 365 * day + 6 * hour
    count = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    whole = lambda n: F.floor(d / n).cast("long")
    months = F.floor((d % year) / month).cast("long")
    out = F.when(d < 0, "in the future")
    for limit, size, unit in ((60, 1, "second"), (hour, 60, "minute"), (day, hour, "hour"), (7 * day, day, "day"), (70 * day, 7 * day, "week"), (year, month, "month")):
        out = out.when(d < limit, F.concat(count(whole(size), unit), F.lit(" ago")))
    return out.when(months == 0, F.concat(count(whole(year), "year"), F.lit(" ago"))).otherwise(F.concat(count(whole(year), "year"), F.lit(", "), count(months, "month"), F.lit(" ago")))


def formatted(pattern: str, now: int) -> Column:
    """A commit rendered by a ``%`` format; unknown placeholders are refused before anything runs.

    Reads ``commit, tree, parents, message, author*/committer*`` columns: ``_name, _email, _secs, _tz``.
    """
    person = {
        "n": lambda w: F.col(f"{w}_name"),
        "e": lambda w: F.col(f"{w}_email"),
        "t": lambda w: F.col(f"{w}_secs").cast("string"),
        "d": lambda w: date_default(f"{w}_secs", f"{w}_tz"),
        "i": lambda w: date_iso(f"{w}_secs", f"{w}_tz"),
        "I": lambda w: date_strict(f"{w}_secs", f"{w}_tz"),
        "r": lambda w: date_relative(f"{w}_secs", F.lit(now)),
    }
    plain = {
        "H": lambda: hex_of("commit"),
        "h": lambda: short("commit"),
        "T": lambda: hex_of("tree"),
        "t": lambda: short("tree"),
        "P": lambda: F.array_join(F.transform("parents", hex_of), " "),
        "p": lambda: F.array_join(F.transform("parents", short), " "),
        "s": lambda: subject("message"),
        "b": lambda: body("message"),
        "B": lambda: F.col("message"),
        "n": lambda: F.lit("\n"),
        "%": lambda: F.lit("%"),
    }
    parts, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c != "%":
            parts.append(F.lit(c))
            at += 1
            continue
        code = pattern[at + 1 : at + 2]
        if code in ("a", "c"):
            which = pattern[at + 2 : at + 3]
            if which not in person or not which:
                raise ValueError(f"unsupported format placeholder %{code}{which}")
            parts.append(person[which]("author" if code == "a" else "committer"))
            at += 3
        elif code in plain and code:
            parts.append(plain[code]())
            at += 2
        else:
            raise ValueError(f"unsupported format placeholder %{code}")
    return F.concat(*parts) if parts else F.lit("")


def ticks(secs: Column | str, nanos: Column | str) -> Column:
    """A time as one number of nanoseconds, wide enough for every second."""
    return col(secs).cast("decimal(30,0)") * F.lit(NANOS).cast("decimal(30,0)") + col(nanos).cast("decimal(30,0)")


def snapshot_time(committer: Column, first_seen: Column) -> Column:
    """The commit's time between 1990 and one tick before it was first seen; 1990 where that is no range."""
    low, high = F.lit(EARLIEST).cast("decimal(30,0)") * NANOS, first_seen - 1
    return F.when(high < low, low).otherwise(F.greatest(low, F.least(committer, high)))


def overlay_time(clock: Column, snapshot: Column, prior: Column) -> Column:
    """Strictly after the snapshot and after the entry's prior time."""
    return F.greatest(clock, snapshot + 1, F.coalesce(prior + 1, snapshot + 1))


#: Code, gRPC status, HTTP status, whether an identical retry may succeed.
ERRORS = (
    ("INVALID_ARGUMENT", 3, 400, False),
    ("NOT_FOUND", 5, 404, False),
    ("PERMISSION_DENIED", 7, 403, False),
    ("UNAUTHENTICATED", 16, 401, False),
    ("EXPIRED", 16, 401, False),
    ("FAILED_PRECONDITION", 9, 422, False),
    ("CONFLICT", 10, 409, False),
    ("RESOURCE_LIMIT", 8, 429, False),
    ("SNAPSHOT_BUILDING", 14, 503, True),
    ("NOT_INDEXABLE", 9, 422, False),
    ("UNSUPPORTED_REPOSITORY_FORMAT", 9, 422, False),
    ("RESERVED_NAMESPACE", 3, 400, False),
    ("UNAVAILABLE", 14, 503, True),
    ("DEADLINE_EXCEEDED", 4, 504, True),
    ("CANCELLED", 1, 499, False),
    ("INTERNAL", 13, 500, False),
)


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, grpc int, http int, retryable boolean")


def exit_code(status: Column | str, matches: Column | str, excluded: Column | str) -> Column:
    """2 failed, 3 truncated, 4 gaps in the coverage, 1 nothing found, 0 found: the first that holds."""
    return F.when(col(status) == "FAILED", 2).when(col(status) == "TRUNCATED", 3).when(col(excluded) > 0, 4).when(col(matches) == 0, 1).otherwise(0)
