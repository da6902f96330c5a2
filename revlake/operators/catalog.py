"""Catalog tables: refs and their events, leases, snapshots, access rules, caches and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.staging import with_sum_before

#: Fixed lease times in seconds: time to live, grace after it, delay before an anchor is pruned, greatest age.
TTL, GRACE, PRUNE, MOST_AGE = 1800, 900, 86_400, 86_400
#: Fixed snapshot rules: a build is stale after, attempts, time to live.
STALE, ATTEMPTS, SNAPSHOT_TTL = 600, 3, 3600
#: Fixed: which repository states may follow which.
TRANSITIONS = (("CREATING", "ACTIVE"), ("CREATING", "QUARANTINED"), ("CREATING", "DELETING"), ("ACTIVE", "QUARANTINED"), ("ACTIVE", "DELETING"), ("QUARANTINED", "ACTIVE"), ("QUARANTINED", "DELETING"))


def reconcile(known: DataFrame, actual: DataFrame) -> DataFrame:
    """``ref_name, change, old_oid, new_oid`` of what differs between the refs known and those there."""
    j = known.select("ref_name", F.col("oid").alias("old_oid")).join(actual.select("ref_name", F.col("oid").alias("new_oid")), "ref_name", "full_outer")
    change = F.when(F.col("old_oid").isNull(), "Created").when(F.col("new_oid").isNull(), "Deleted").when(F.col("old_oid") != F.col("new_oid"), "Updated")
    return j.select("ref_name", change.alias("change"), "old_oid", "new_oid").where("change is not null")


def ref_events(observed: DataFrame) -> DataFrame:
    """``ref_name, seq, change, old_oid, new_oid`` from what was seen of each ref in order (``ref_name, seq, new_oid``).

    A change that was reported before with the same old and new oid is not reported again, creations and deletions
    included.
    """
    w = Window.partitionBy("ref_name").orderBy("seq")
    seen = observed.select("ref_name", "seq", "new_oid", F.lag("new_oid").over(w).alias("old_oid"))
    change = F.when(F.col("old_oid").isNull() & F.col("new_oid").isNotNull(), "Created").when(F.col("old_oid").isNotNull() & F.col("new_oid").isNull(), "Deleted").when(F.col("old_oid") != F.col("new_oid"), "Updated")
    rows = seen.withColumn("change", change).where("change is not null")
    return rows.groupBy("ref_name", "change", "old_oid", "new_oid").agg(F.min("seq").alias("seq")).select("ref_name", "seq", "change", "old_oid", "new_oid")


def ref_versions(events: DataFrame) -> DataFrame:
    """Events with ``ref_version``: increasing in each repository, never used again."""
    return events.withColumn("ref_version", F.row_number().over(Window.partitionBy("repository_id").orderBy("seq")).cast("long"))


def refs_as_of(events: DataFrame, seq: int) -> DataFrame:
    """``ref_name, oid`` as they stood after an event."""
    last = events.where(F.col("seq") <= seq).groupBy("ref_name").agg(F.max_by("new_oid", "seq").alias("oid"))
    return last.where("oid is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, first_wins: bool = False) -> DataFrame:
    """One row per key of both tables: the latest by ``order``, or with ``first_wins`` the one there first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = [F.col("_new"), F.col(order)] if first_wins else [F.col("_new").desc(), F.col(order).desc()]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_k = 1").drop("_k", "_new")


def compare_and_swap(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``ref_name, outcome``: ``wanted`` is ``ref_name, expected, target``; a null expectation creates."""
    j = wanted.join(refs.select("ref_name", "oid"), "ref_name", "left")
    return j.select("ref_name", F.when(F.col("oid").eqNullSafe(F.col("expected")), "updated").otherwise("CONFLICT").alias("outcome"))


def lease_states(events: DataFrame, now: Column) -> DataFrame:
    """``mount_id, state, expires_at, failures, outcome`` from lease events (``mount_id, seq, at, op``).

    ``create`` starts a lease, ``renew`` extends it (never backwards, and only while active and not too old), ``fail`` counts a failed
    renewal, ``release`` ends it.  The outcome is that of a sweep at ``now``.
    """
    w = Window.partitionBy("mount_id").orderBy("seq")
    born = F.first("at").over(w)
    released = F.max((F.col("op") == "release").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fine = (F.col("op") == "create") | ((F.col("op") == "renew") & (F.coalesce(released, F.lit(0)) == 0) & (F.col("at") - born <= MOST_AGE))
    rows = events.withColumn("until", F.when(fine, F.col("at") + TTL)).withColumn("good", F.when(fine, F.col("seq")))
    last_good = F.max("good")
    folded = rows.groupBy("mount_id").agg(
        F.max("until").alias("expires_at"),
        last_good.alias("good"),
        F.min(F.when(F.col("op") == "release", F.col("at"))).alias("released_at"),
        F.collect_list(F.when(F.col("op") == "fail", F.col("seq"))).alias("fails"),  # one lease's events
    )
    failures = F.size(F.filter("fails", lambda s: s > F.col("good")))
    state = F.when(F.col("released_at").isNotNull(), "RELEASED").when(now > F.col("expires_at") + GRACE, "EXPIRED").otherwise("ACTIVE")
    ended = F.coalesce("released_at", F.col("expires_at") + GRACE)
    outcome = (
        F.when((state == "ACTIVE") & (now > F.col("expires_at")), "in_grace")
        .when(state == "ACTIVE", "none")
        .when(now >= ended + PRUNE, "prunable")
        .otherwise("protected")
    )
    return folded.select("mount_id", state.alias("state"), "expires_at", failures.alias("failures"), outcome.alias("outcome"))


def is_protecting(state: Column, terminal_at: Column, now: Column) -> Column:
    return state.isin("PREPARING", "ACTIVE") | F.coalesce(now < terminal_at + PRUNE, F.lit(False))


def lease_health(failures: Column, expires_at: Column, now: Column) -> Column:
    return F.when(now > expires_at + GRACE, "Critical").when((failures >= 2) | (now > expires_at), "Warning").otherwise("Healthy")


def reconcile_leases(leases: DataFrame, anchors: DataFrame) -> DataFrame:
    """``mount_id, action``: leases against the anchors there are, after a restart."""
    a = anchors.select("mount_id", F.col("target").alias("anchored"))
    j = leases.select("mount_id", "state", "target").join(a, "mount_id", "full_outer")
    protecting = F.coalesce(F.col("state").isin("PREPARING", "ACTIVE"), F.lit(False))
    action = (
        F.when(F.col("state") == "PREPARING", "abandon")
        .when((F.col("state") == "ACTIVE") & ~F.coalesce(F.col("anchored") == F.col("target"), F.lit(False)), "repair")
        .when(~protecting & F.col("anchored").isNotNull(), "drop_anchor")
    )
    return j.select("mount_id", action.alias("action")).where("action is not null")


def snapshot_claims(rows: DataFrame, now: Column) -> DataFrame:
    """``commit, claim`` of what a worker that asks for a snapshot is told."""
    claim = (
        F.when(F.col("state") == "READY", "Ready")
        .when((F.col("state") == "BUILDING") & (now - F.col("updated_at") < STALE), "Building")
        .when((F.col("state") == "FAILED") & (F.col("attempts") >= ATTEMPTS), "Failed")
        .otherwise("Claimed")
    )
    return rows.select("commit", claim.alias("claim"))


def collect_garbage(snapshots: DataFrame, pinned: DataFrame, now: Column) -> DataFrame:
    """``commit, verdict``: pinned snapshots stay, expired ones go, those without expiry are kept by policy."""
    j = snapshots.join(pinned.select("commit", F.lit(True).alias("pinned")).distinct(), "commit", "left")
    return j.select("commit", F.when(F.col("pinned"), "retained").when(F.col("expires_at").isNull(), "policy").when(F.col("expires_at") <= now, "deleted").otherwise("live").alias("verdict"))


def may_transition(rows: DataFrame) -> DataFrame:
    """``rows`` (``state, next_state``) with ``legal``; staying is always legal."""
    table = rows.sparkSession.createDataFrame(TRANSITIONS, "state string, next_state string").withColumn("ok", F.lit(True))
    return rows.join(F.broadcast(table), ["state", "next_state"], "left").withColumn("legal", F.coalesce("ok", F.col("state") == F.col("next_state"))).drop("ok")


def may_read(requests: DataFrame, capabilities: DataFrame, allowed: DataFrame, reachable: DataFrame, now: Column) -> DataFrame:
    """Requests (``subject, repository_id, commit``) with ``verdict``: a live capability, else a permitted repository and a visible commit,
    else a denial that looks like absence."""
    c = capabilities.where(F.col("expires_at") > now).select("subject", "repository_id", "commit", F.lit(True).alias("cap")).distinct()
    j = requests.join(c, ["subject", "repository_id", "commit"], "left")
    j = j.join(allowed.select("subject", "repository_id", F.lit(True).alias("repo")).distinct(), ["subject", "repository_id"], "left")
    j = j.join(reachable.select("commit", F.lit(True).alias("seen")).distinct(), "commit", "left")
    return j.withColumn("verdict", F.when(F.col("cap"), "capability").when(F.col("repo") & F.col("seen"), "reachable").otherwise("NOT_FOUND")).drop("cap", "repo", "seen")


def evict(entries: DataFrame, quota: int) -> DataFrame:
    """``key`` of the least recently used entries that go until the rest fits; pinned entries count but stay.

    What must go is a prefix of the entries by last use and key; null sizes count as 0.
    """
    total = F.broadcast(entries.agg((F.sum("size") - quota).alias("over")))  # one row
    free = with_sum_before(entries.where("not pinned").select("key", "last_used", "size"), ["last_used", "key"], "size", "gone")
    return free.join(total, F.lit(True)).where(F.col("gone") < F.col("over")).select("key", "size")


def nearest_rank(values: DataFrame, groups: list[str], value: str, percent: int) -> DataFrame:
    """The nearest-rank percentile of each group."""
    return values.groupBy(*groups).agg(F.expr(f"percentile_disc({percent / 100}) within group (order by {value})").alias("percentile"))


def extension_profile(files: DataFrame) -> DataFrame:
    """``extension, files, bytes, duplicates, largest``: what a tree holds."""
    ext = F.regexp_extract(F.substring_index("path", "/", -1), r"\.([^.]+)$", 1)
    return files.groupBy(ext.alias("extension")).agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), (F.count("*") - F.count_distinct("oid")).alias("duplicates"), F.max("size").cast("long").alias("largest")
    )


def counters(requests: DataFrame, key: str, failed: Column) -> DataFrame:
    """``key, requests, errors``: how many requests there were of each key and how many failed."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.count(F.when(failed, 1)).alias("errors"))


def latest(rows: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """``key, name``: the value of each key's last row; later rules and writes win."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def reused(checks: DataFrame, subject: list[str], order: str, ttl: Column) -> DataFrame:
    """``checks`` with ``reused``: whether the subject's check before (by ``order``) is younger than ``ttl`` at this one's ``at``."""
    age = F.col("at") - F.lag("at").over(Window.partitionBy(*subject).orderBy(order))
    return checks.withColumn("reused", age < ttl)
