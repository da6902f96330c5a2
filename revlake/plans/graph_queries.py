"""Queries over history, refs, leases and the overlay."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlake.functions import history as H
from revlake.functions import paths as P
from revlake.operators import ancestry as A
from revlake.operators import catalog as C
from revlake.operators import history as G
from revlake.operators import objects as J
from revlake.operators import oplog as Z
from revlake.operators import overlay as O
from revlake.operators import renderings as N
from revlake.operators import textdiff as D
from revlake.operators.staging import checksum, kept
from revlake.plans.registry import SQL, query
from revlake.sources import views as V
from revlake.streaming import detectors as S
from revlake.streaming import events as E
from revlake.streaming import leases as W
from revlake.streaming import outbox as Y


@query("s8_visible_refs", "select ref_name, target from refs where not starts_with(ref_name, 'refs/internal/') order by ref_name")
def s8(spark, sf):
    return G.visible_refs(V.refs(spark, sf), V.RESERVED)


@query("s9_reserved_refs", "select ref_name, target from refs where starts_with(ref_name, 'refs/internal/') order by ref_name")
def s9(spark, sf):
    return G.reserved_refs(V.refs(spark, sf), V.RESERVED)


@query("s10_read_commit", "select \"commit\", 'sha1:' || sha1('tree ' || \"commit\") as tree, message, role as author_name, secs as author_secs from commits where conv_id = 7")
def s10(spark, sf):
    return V.commits(spark, sf).where("conv_id = 7").select("commit", "tree", "message", "author_name", "author_secs")


@query("s13_catalog_refs", "select ref_name, target from refs order by ref_name")
def s13(spark, sf):
    return V.refs(spark, sf).select("ref_name", "target").orderBy("ref_name")


@query("s14_journal", "select path, present, kind, opaque, oid, mode, renamed_from from ov")
def s14(spark, sf):
    return V.overlay(spark, sf).select("path", "present", "kind", "opaque", "oid", "mode", "renamed_from")


@query(
    "e20_commit_fields",
    "select \"commit\", substring(sha1(\"commit\"), 1, 7) as short, string_split(message, chr(10))[1] as subject, case when instr(message, chr(10)) > 0 then regexp_replace(substring(message, instr(message, chr(10)) + 1), '^\\n', '') else '' end as body from commits",
)
def e20(spark, sf):
    return V.commits(spark, sf).select("commit", H.short("oid").alias("short"), H.subject("message").alias("subject"), H.body("message").alias("body"))


_WHEN = "make_timestamp((secs + tz * 60) * 1000000)"
_OFF = "case when tz < 0 then '-' else '+' end || lpad((abs(tz) // 60)::varchar, 2, '0') || {c} || lpad((abs(tz) % 60)::varchar, 2, '0')"


@query(
    "e21_formatted",
    "select sha1(\"commit\") || ' ' || substring(sha1(\"commit\"), 1, 7) || ' ' || role || ' <' || role || '@example.org> ' || secs || '%' || string_split(message, chr(10))[1] as line from commits",
)
def e21(spark, sf):
    return V.commits(spark, sf).withColumn("commit", F.col("oid")).select(H.formatted("%H %h %an <%ce> %at%%%s", 0).alias("line"))


@query(
    "e22_dates",
    f"select \"commit\", strftime({_WHEN}, '%a %b %-d %H:%M:%S %Y ') || {_OFF.format(c=chr(39) * 2)} as shown, strftime({_WHEN}, '%Y-%m-%d %H:%M:%S ') || {_OFF.format(c=chr(39) * 2)} as iso, strftime({_WHEN}, '%Y-%m-%dT%H:%M:%S') || {_OFF.format(c=chr(39) + ':' + chr(39))} as strict, "
    "case when d < 0 then 'in the future' when d < 60 then d || case when d = 1 then ' second ago' else ' seconds ago' end when d < 3600 then d // 60 || case when d // 60 = 1 then ' minute ago' else ' minutes ago' end when d < 86400 then d // 3600 || case when d // 3600 = 1 then ' hour ago' else ' hours ago' end "
    "when d < 604800 then d // 86400 || case when d // 86400 = 1 then ' day ago' else ' days ago' end else d // 604800 || case when d // 604800 = 1 then ' week ago' else ' weeks ago' end end as relative from (select *, 1600360000 - secs as d from commits)",
)
def e22(spark, sf):
    c = V.commits(spark, sf)
    return c.select(
        "commit",
        H.date_default("author_secs", "author_tz").alias("shown"),
        H.date_iso("author_secs", "author_tz").alias("iso"),
        H.date_strict("author_secs", "author_tz").alias("strict"),
        H.date_relative("author_secs", F.lit(1_600_360_000)).alias("relative"),
    )


@query(
    "e23_snapshot_time",
    "select event_id, (case when seen - 1 < 631152000000000000 then 631152000000000000 else greatest(631152000000000000, least(made, seen - 1)) end)::varchar as snapshot, (greatest(seen, greatest(631152000000000000, least(made, seen - 1)) + 1))::varchar as overlay from (select event_id, (case when event_type = 'error' then 0 else 1700000000 + event_id % 1000 end)::hugeint * 1000000000 + 5 as made, (1700000500)::hugeint * 1000000000 as seen from events)",
)
def e23(spark, sf):
    e = V.table(spark, sf, "events")
    made = H.ticks(F.when(F.col("event_type") == "error", 0).otherwise(F.lit(1_700_000_000) + F.col("event_id") % 1000), F.lit(5))
    seen = H.ticks(F.lit(1_700_000_500), F.lit(0))
    snap = H.snapshot_time(made, seen)
    return e.select("event_id", snap.cast("decimal(30,0)").cast("string").alias("snapshot"), H.overlay_time(seen, snap, F.lit(None).cast("decimal(30,0)")).cast("decimal(30,0)").cast("string").alias("overlay"))


@query("e24_exit_code", "select event_id, case event_type when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 when 'view' then 1 else 0 end as code from events")
def e24(spark, sf):
    t = F.col("event_type")
    e = V.table(spark, sf, "events").select("event_id", F.when(t == "error", "FAILED").when(t == "purchase", "TRUNCATED").otherwise("COMPLETE").alias("s"), F.when(t == "view", 0).otherwise(1).alias("m"), F.when(t == "signup", 1).otherwise(0).alias("x"))
    return e.select("event_id", H.exit_code("s", "m", "x").alias("code"))


@query(
    "e25_errors",
    "select code, grpc, http, retryable, count(*) as answers from (select case event_type when 'error' then 'UNAVAILABLE' when 'click' then 'CONFLICT' when 'view' then 'NOT_FOUND' when 'purchase' then 'RESOURCE_LIMIT' else 'SNAPSHOT_BUILDING' end as code from events) "
    "join (values ('UNAVAILABLE', 14, 503, true), ('CONFLICT', 10, 409, false), ('NOT_FOUND', 5, 404, false), ('RESOURCE_LIMIT', 8, 429, false), ('SNAPSHOT_BUILDING', 14, 503, true)) t(code, grpc, http, retryable) using (code) group by all",
)
def e25(spark, sf):
    """What callers were told, by kind of answer."""
    t = F.col("event_type")
    code = F.when(t == "error", "UNAVAILABLE").when(t == "click", "CONFLICT").when(t == "view", "NOT_FOUND").when(t == "purchase", "RESOURCE_LIMIT").otherwise("SNAPSHOT_BUILDING")
    told = V.table(spark, sf, "events").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("answers"))
    return told.join(H.error_table(spark), "code").select("code", "grpc", "http", "retryable", "answers")


@query("e26_work_ref", "select distinct 'refs/internal/work/u_' || user_id || '.x/main' as ref from events")
def e26(spark, sf):
    e = V.table(spark, sf, "events").select("user_id").distinct()
    return e.select(P.work_ref(F.concat(F.lit("@u/ "), "user_id", F.lit(".x_")), F.lit("main"), V.RESERVED + "work/").alias("ref"))


@query("e27_identifiers", "select event_id, event_type in ('click', 'view') as valid from events")
def e27(spark, sf):
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    made = F.when(t == "click", F.concat(F.lit("repo-"), u)).when(t == "view", F.concat(u, F.lit("_x.y"))).when(t == "error", F.concat(F.lit("-"), u)).when(t == "purchase", F.concat(F.lit("a.."), u)).otherwise(F.lit(""))
    return V.table(spark, sf, "events").select("event_id", P.valid_identifier(made).alias("valid"))


@query("f10_touches", "select c.\"commit\" from commits c left join edges e on e.\"commit\" = c.\"commit\" left join commits p on p.\"commit\" = e.parent group by c.\"commit\" having bool_and(e.parent is null or p.role is distinct from c.role)")
def f10(spark, sf):
    c = V.commits(spark, sf)
    # the one file holds the turn's role: a commit touches it where the role changes
    entries = c.select("commit", F.lit("role.txt").alias("path"), F.col("author_name").alias("oid"), F.lit(V.REGULAR).alias("mode"))
    return G.touches(entries, V.edges(c), c)


@query("f13_may_read", "select event_id, case when event_type = 'click' then 'capability' when user_id % 2 = 0 and event_type <> 'error' then 'reachable' else 'NOT_FOUND' end as verdict from events")
def f13(spark, sf):
    e = V.table(spark, sf, "events")
    ask = e.select("event_id", F.col("user_id").alias("subject"), F.lit("r").alias("repository_id"), F.col("event_type").alias("commit"))
    caps = ask.where("commit = 'click'").select("subject", "repository_id", "commit", F.lit(10).alias("expires_at")).unionByName(ask.where("commit = 'view'").select("subject", "repository_id", "commit", F.lit(1).alias("expires_at")))
    allowed = ask.where("subject % 2 = 0").select("subject", "repository_id")
    seen = ask.where("commit <> 'error'").select("commit")
    return C.may_read(ask, caps, allowed, seen, F.lit(5)).select("event_id", "verdict")


_STATE = "case event_type when 'signup' then 'CREATING' when 'error' then 'QUARANTINED' when 'purchase' then 'DELETING' else 'ACTIVE' end"


@query(
    "f15_transitions",
    f"with s as (select {_STATE} as b, lag({_STATE}) over (partition by user_id order by event_id) as a from events) select a, b, a = b or (a = 'CREATING' and b <> 'CREATING') or (a in ('ACTIVE', 'QUARANTINED') and b in ('ACTIVE', 'QUARANTINED', 'DELETING')) as legal, count(*) as n from s where a is not null group by all",
)
def f15(spark, sf):
    """The changes of state that each user's events ask for, and which of them are allowed."""
    t = F.col("event_type")
    state = F.when(t == "signup", "CREATING").when(t == "error", "QUARANTINED").when(t == "purchase", "DELETING").otherwise("ACTIVE")
    before = F.lag(state).over(Window.partitionBy("user_id").orderBy("event_id"))
    asked = V.table(spark, sf, "events").select(before.alias("state"), state.alias("next_state")).where("state is not null").groupBy("state", "next_state").agg(F.count("*").alias("n"))
    return C.may_transition(asked).select(F.col("state").alias("a"), F.col("next_state").alias("b"), "legal", "n")


@query("h2_resolve", "select target as \"commit\" from refs where ref_name = 'refs/heads/conv-5'")
def h2(spark, sf):
    c = V.commits(spark, sf)
    return G.resolve(G.parse("conv-5", V.RESERVED), V.refs(spark, sf), c, V.edges(c))


@query("h2_resolve_short", "select \"commit\" from commits where starts_with(sha1(\"commit\"), (select substring(sha1('c-3-0'), 1, 10)))")
def h2_short(spark, sf):
    import hashlib

    c = V.commits(spark, sf)
    return G.resolve(G.parse(hashlib.sha1(b"c-3-0").hexdigest()[:10], V.RESERVED), V.refs(spark, sf), c, V.edges(c))


@query(
    "h2_peeled",
    "with recursive w(tag, obj) as (select tag, tag from tagged union all select w.tag, t.target from w join tagged t on t.tag = w.obj) "
    "select 'refs/tags/' || w.tag as ref_name, c.\"commit\" from w left join commits c on c.\"commit\" = w.obj where w.obj not in (select tag from tagged)",
)
def h2_peeled(spark, sf):
    t = V.tags(spark, sf)
    return G.peeled(t.select(F.concat(F.lit("refs/tags/"), "tag").alias("ref_name"), F.col("tag").alias("target")), t, V.commits(spark, sf))


@query(
    "h3_ancestry",
    "with recursive walk(c, n) as (select target, 0 from refs where ref_name = 'refs/heads/conv-40' union all select e.parent, n + 1 from walk join edges e on e.\"commit\" = walk.c and e.pos = 0 where n < 13) select c as \"commit\" from walk where n = 13",
)
def h3(spark, sf):
    c = V.commits(spark, sf)
    return G.resolve(G.parse("conv-40~13", V.RESERVED), V.refs(spark, sf), c, V.edges(c))


_REACH = "with recursive r(c) as (select target from refs where ref_name = 'refs/heads/conv-20' union select e.parent from r join edges e on e.\"commit\" = r.c{w}) "


def kept_ancestry(spark, sf):
    """``(commits, edges, index)``: the ancestry index of the history, written by the session's first caller."""
    c = V.commits(spark, sf)
    e = V.edges(c)
    folder = kept(spark, "ancestry", checksum(V.written(spark, sf, "conversations")), lambda f: A.write(A.build(e, c), f))
    return c, e, A.read(spark, folder)


@query("h4_log", _REACH.format(w="") + "select c.\"commit\", secs from r join commits c on c.\"commit\" = r.c order by secs desc, c.\"commit\" limit 50 offset 5")
def h4(spark, sf):
    c, e, index = kept_ancestry(spark, sf)
    page, _ = G.log(V.refs(spark, sf).where("ref_name = 'refs/heads/conv-20'").select(F.col("target").alias("commit")), c, e, skip=5, limit=50, index=index)
    return page.select("commit", F.col("committer_secs").alias("secs"))


@query("h4_first_parent", _REACH.format(w=" and e.pos = 0") + "select c as \"commit\" from r")
def h4_first(spark, sf):
    _, e, index = kept_ancestry(spark, sf)
    return G.reachable(V.refs(spark, sf).where("ref_name = 'refs/heads/conv-20'").select(F.col("target").alias("commit")), e, first_parent=True, index=index)


@query(
    "h5_visible",
    "with recursive r(c) as (select target from refs where starts_with(ref_name, 'refs/tags/') union select e.parent from r join edges e on e.\"commit\" = r.c) select \"commit\", \"commit\" in (select c from r) as visible from commits",
)
def h5(spark, sf):
    c, e, index = kept_ancestry(spark, sf)
    seen = G.reachable(V.refs(spark, sf).where("ref_name like 'refs/tags/%'").select(F.col("target").alias("commit")), e, index=index)
    return c.select("commit").join(seen.select("commit", F.lit(True).alias("v")), "commit", "left").select("commit", F.coalesce("v", F.lit(False)).alias("visible"))


@query("j11_edges", "select \"commit\", parent, pos from edges")
def j11(spark, sf):
    return V.edges(V.commits(spark, sf)).select("commit", "parent", "pos")


@query(
    "o1_resolve",
    "select path, case when exists (select 1 from ov o where (not o.present or o.kind <> 'directory') and starts_with(p.path, o.path || '/')) then 'absent' when exists (select 1 from ov o where o.path = p.path and o.present) then 'overlay' when exists (select 1 from ov o where o.path = p.path) then 'absent' when exists (select 1 from ov o where o.opaque and starts_with(p.path, o.path || '/')) then 'absent' else 'base' end as resolution from snap3 p",
)
def o1(spark, sf):
    return O.resolve(V.snapshot(spark, sf, 3), V.overlay(spark, sf))


@query(
    "o3_merged",
    "select path, oid, mode, size, 'base' as source from snap3 s where not exists (select 1 from ov o where o.path = s.path) and not exists (select 1 from ov o where (not o.present or o.kind <> 'directory' or o.opaque) and starts_with(s.path, o.path || '/')) "
    "union all select path, oid, mode, size, 'overlay' from ov s where present and kind <> 'directory' and not exists (select 1 from ov o where (not o.present or o.kind <> 'directory') and starts_with(s.path, o.path || '/'))",
)
def o3(spark, sf):
    return O.merged(V.snapshot(spark, sf, 3), V.overlay(spark, sf))


@query("o4_status", "select * from changes")
def o4(spark, sf):
    return O.status(V.overlay(spark, sf))


@query("o4_directory_deletions", "select path from ov o where not present and kind = 'directory' and not exists (select 1 from ov x where starts_with(x.path, o.path || '/'))")
def o4_dirs(spark, sf):
    return O.directory_deletions(V.overlay(spark, sf))


@query(
    "o5_commit_plan",
    "select path, case when kind = 'Deleted' then 'delete' else 'upsert' end as action, case when kind <> 'Deleted' then new_oid end as oid, case when kind <> 'Deleted' then new_mode end as mode from changes union all select \"from\", 'delete', null, null from changes where kind = 'Renamed' "
    "union all select path, 'delete', null, null from snap3 where exists (select 1 from ov o where not present and kind = 'directory' and starts_with(snap3.path, o.path || '/') and not exists (select 1 from ov x where starts_with(x.path, o.path || '/')))",
)
def o5(spark, sf):
    rows = V.overlay(spark, sf)
    return O.commit_plan(O.status(rows), O.directory_deletions(rows), V.snapshot(spark, sf, 3))


@query(
    "j8_list_merged",
    "with b as (select distinct string_split(path, '/')[3] as name from snap3 where starts_with(path, 'src7/en/')), o as (select string_split(path, '/')[3] as name, present from ov where starts_with(path, 'src7/en/')) "
    "select coalesce(b.name, o.name) as name, case when o.present then case when b.name is not null then 'replace' else 'extra' end else 'hide' end as verdict from b full outer join o on b.name = o.name",
)
def j8(spark, sf):
    return O.list_merged(V.snapshot(spark, sf, 3), V.overlay(spark, sf), "src7/en")


@query(
    "j9_place",
    "with m as (select path, doc_id from snap3 where contains(content, 'tion')) select coalesce(r.path, m.path) as path, doc_id from m left join (select * from ov where present and renamed_from is not null) r on r.renamed_from = m.path where r.path is not null or (not exists (select 1 from ov o where o.path = m.path) and not exists (select 1 from ov o where (not o.present or o.opaque or o.kind <> 'directory') and starts_with(m.path, o.path || '/')))",
)
def j9(spark, sf):
    m = V.snapshot(spark, sf, 3).where(F.col("content").contains("tion")).select("path", "doc_id")
    return O.place(m, O.with_base_bytes(V.overlay(spark, sf), V.snapshot(spark, sf, 3)))


@query(
    "u4_worktree",
    "select path from (select path from snap3 where path not in (select path from changes where kind = 'Deleted') and path not in (select \"from\" from changes where kind = 'Renamed') and not exists (select 1 from ov o where not o.present and o.kind = 'directory' and starts_with(snap3.path, o.path || '/') and not exists (select 1 from ov x where starts_with(x.path, o.path || '/'))) union select path from changes where kind in ('Added', 'Renamed'))",
)
def u4(spark, sf):
    rows = V.overlay(spark, sf)
    return O.worktree(V.snapshot(spark, sf, 3), O.status(rows), O.directory_deletions(rows))


@query(
    "o8_monitor_changes",
    "select path from changes union select \"from\" from changes where \"from\" is not null union select path || '/' from ov o where not present and kind = 'directory' and not exists (select 1 from ov x where starts_with(x.path, o.path || '/')) union select 'u/' || user_id from (select user_id, arg_max(event_type, event_id) as op from events group by 1) where op = 'error'",
)
def o8(spark, sf):
    rows = V.overlay(spark, sf)
    e = V.table(spark, sf, "events").select(F.concat(F.lit("u/"), "user_id").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("write").alias("op"))
    return O.monitor_changes(O.status(rows), O.directory_deletions(rows), O.vanished(e, V.snapshot(spark, sf, 3)))


@query(
    "o8_monitor_answer",
    "with e as (select event_id as seq, user_id, (event_type = 'error')::int as gone from events), t as (select seq, gone - coalesce(lag(gone) over (partition by user_id order by seq), 0) as step from e), n as (select sum(step) over (order by seq) as n from t) "
    "select path, (select max(n) > 5 from n) as full_rescan from changes",
)
def o8_answer(spark, sf):
    rows = V.overlay(spark, sf)
    log = V.table(spark, sf, "events").select(F.concat(F.lit("u/"), "user_id").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("write").alias("op"))
    paths, again = O.monitor_answer(O.status(rows).select("path"), O.vanished_overflow(log, V.snapshot(spark, sf, 3), 5), 3, "3:17")
    return paths.withColumn("full_rescan", F.lit(again))


@query("o10_quota", "select sum(case when present and oid is distinct from base_oid then size else 0 end)::bigint as used, sum(case when present and oid is distinct from base_oid then size else 0 end) <= 1000000 as allowed from ov")
def o10(spark, sf):
    return O.quota(V.overlay(spark, sf), 1_000_000)


@query(
    "o6_fold_operations",
    "with e as (select 'u/' || user_id as path, event_id as seq, event_type as op from events), b as (select path, max(case when op in ('signup', 'purchase', 'error') then seq end) as reset, arg_max(op, seq) filter (where op in ('signup', 'purchase', 'error')) as last_reset, coalesce(max(seq) filter (where op in ('signup', 'error')), -1) as made, arg_max(op, seq) filter (where op in ('signup', 'error')) as how from e group by 1), "
    "s as (select b.*, case when how = 'signup' then made else (select min(seq) from e where e.path = b.path and e.op in ('view', 'purchase') and e.seq > b.made) end as since from b) "
    "select s.path, true as present, 'file' as kind, case when exists (select 1 from e where e.path = s.path and e.op = 'click' and e.seq > s.since) then 33261 else 33188 end as mode, "
    "case when last_reset = 'signup' then 'new' else '' end || repeat('x', (select count(*) from e where e.path = s.path and e.op = 'view' and e.seq > coalesce(s.reset, -1))) as content, false as unchanged from s where since is not null",
)
def o6(spark, sf):
    op = F.create_map(*[F.lit(x) for p in (("view", "append"), ("signup", "create"), ("purchase", "truncate"), ("error", "remove"), ("click", "chmod")) for x in p])
    t = F.col("event_type")
    log = V.table(spark, sf, "events").select(F.concat(F.lit("u/"), "user_id").alias("path"), F.col("event_id").alias("seq"), op[t].alias("op"), F.when(t == "view", "x").when(t == "signup", "new").alias("content"), F.when(t == "click", V.EXECUTABLE).alias("mode"))
    return O.fold_operations(log, V.snapshot(spark, sf, 3))


@query(
    "o6_rename_log",
    "with f as (select *, case when starts_with(path, 'src1/en/') then 'kept/en/' || substr(path, 9) when starts_with(path, 'src2/') then 'src1/en/' || substr(path, 6) else path end as to_path, "
    "content || case when doc_id % 13 = 2 then '+a' else '' end || case when starts_with(path, 'src1/en/') and doc_id % 5 = 0 then '+b' else '' end as made, starts_with(path, 'src2/') and doc_id % 7 = 1 as lost from snap3) "
    "select to_path as path, true as present, 'file' as kind, mode, made as content, case when to_path <> path then path end as renamed_from from f where not lost and (to_path <> path or doc_id % 13 = 2) union all select path, false, null, null, null, null from f where to_path <> path",
)
def o6_renames(spark, sf):
    """Two directories are renamed, the second one to where the first was; files are edited before and after, some are removed."""
    base = V.snapshot(spark, sf, 3).select("doc_id", "path", "content", "mode")
    n = (base.agg(F.max("doc_id")).first()[0] or 0) + 1
    k = F.col("doc_id")
    none = [F.lit(None).cast("int").alias("mode"), F.lit(None).cast("string").alias("to")]
    step = lambda rows, path, seq, op, text=None: rows.select(path.alias("path"), seq.cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(text).cast("string").alias("content"), *none)
    below = lambda old, new: F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))
    first, second = base.where("path like 'src1/en/%'"), base.where("path like 'src2/%'")
    moves = spark.createDataFrame([("src1/en", n, "rename", None, None, "kept/en"), ("src2", 2 * n + 2, "rename", None, None, "src1/en")], "path string, seq long, op string, content string, mode int, to string")
    log = (
        step(base.where(k % 13 == 2), F.col("path"), k, "append", "+a")
        .unionByName(step(first.where(k % 5 == 0), below("src1/en", "kept/en"), k + n + 1, "append", "+b"))
        .unionByName(step(second.where(k % 7 == 1), below("src2", "src1/en"), k + 2 * n + 3, "remove"))
        .unionByName(moves)
    )
    return Z.fold_log(log, base.drop("doc_id")).drop("changed", "moved")


@query(
    "j13_reconcile_refs",
    "with k as (select ref_name, arg_max(coalesce(new_oid, ''), seq) as oid from obs where seq <= (select max(seq) // 2 from obs) group by 1 having oid <> ''), a as (select ref_name, arg_max(coalesce(new_oid, ''), seq) as oid from obs group by 1 having oid <> '') "
    "select coalesce(k.ref_name, a.ref_name) as ref_name, case when k.oid is null then 'Created' when a.oid is null then 'Deleted' else 'Updated' end as change, k.oid as old_oid, a.oid as new_oid from k full outer join a on k.ref_name = a.ref_name where k.oid is distinct from a.oid",
)
def j13(spark, sf):
    o = V.ref_observations(spark, sf)
    last = o.agg(F.max("seq")).first()[0] or 0
    return C.reconcile(C.refs_as_of(o, last // 2), C.refs_as_of(o, last))


@query(
    "t1_ref_events",
    "with s as (select ref_name, seq, new_oid, lag(new_oid) over (partition by ref_name order by seq) as old_oid from obs), c as (select *, case when old_oid is null and new_oid is not null then 'Created' when old_oid is not null and new_oid is null then 'Deleted' when old_oid <> new_oid then 'Updated' end as change from s) select ref_name, min(seq) as seq, change, old_oid, new_oid from c where change is not null group by ref_name, change, old_oid, new_oid",
)
def t1(spark, sf):
    return C.ref_events(V.ref_observations(spark, sf))


@query(
    "t1_ref_states",
    "with s as (select ref_name, seq, new_oid, lag(new_oid) over (partition by ref_name order by seq) as old_oid from obs), c as (select *, case when old_oid is null and new_oid is not null then 'Created' when old_oid is not null and new_oid is null then 'Deleted' when old_oid <> new_oid then 'Updated' end as change from s) select ref_name, min(seq) as seq, change, old_oid, new_oid from c where change is not null group by ref_name, change, old_oid, new_oid",
)
def t1_states(spark, sf):
    return S.fold(V.ref_observations(spark, sf).select("ref_name", "seq", "new_oid"), "ref_name", ["seq"], S.RefState, "ref_name string, seq long, change string, old_oid string, new_oid string")


@query("w7_ref_versions", "select seq, row_number() over (partition by ref_name order by seq) as ref_version from obs")
def w7(spark, sf):
    return C.ref_versions(V.ref_observations(spark, sf).withColumnRenamed("ref_name", "repository_id")).select("seq", "ref_version")


@query("j19_refs_as_of", "select ref_name, oid from (select ref_name, arg_max(coalesce(new_oid, ''), seq) as oid from obs where seq <= (select max(seq) // 2 from obs) group by 1) where oid <> ''")
def j19(spark, sf):
    o = V.ref_observations(spark, sf)
    return C.refs_as_of(o, (o.agg(F.max("seq")).first()[0] or 0) // 2)


@query("k8_upsert", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def k8(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return C.upsert(e.where("event_id < 5000"), e.where("event_id >= 5000"), ["user_id"], "event_id")


@query("k8_first_wins", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1")
def k8_first(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return C.upsert(e.where("event_id < 5000"), e.where("event_id >= 5000"), ["user_id"], "event_id", first_wins=True)


_ZONE = "case when tz < 0 then '-' else '+' end || lpad((abs(tz) // 60)::varchar, 2, '0') || lpad((abs(tz) % 60)::varchar, 2, '0')"


@query(
    "k2_commit_ids",
    "with p as (select c.\"commit\", string_agg('parent ' || sha1(e.parent) || chr(10), '' order by e.pos) as above from commits c join edges e on e.\"commit\" = c.\"commit\" group by 1), "
    f"b as (select \"commit\", 'tree ' || sha1('tree ' || \"commit\") || chr(10) || coalesce(above, '') || 'author ' || role || ' <' || role || '@example.org> ' || secs || ' ' || {_ZONE} || chr(10) || 'committer ' || role || ' <' || role || '@example.org> ' || secs || ' ' || {_ZONE} || chr(10) || chr(10) || message as body from commits left join p using (\"commit\")) "
    "select \"commit\", 'sha1:' || sha1('commit ' || strlen(body) || chr(0) || body) as oid from b",
)
def k2_ids(spark, sf):
    """What creating each commit anew on its parents (of the table's ids) gives."""
    c = V.commits(spark, sf)
    who = {f"{r}_{k}": F.col(f"{r}_{k}") for r in ("author", "committer") for k in ("name", "email", "secs", "tz")}
    above = F.transform("parents", lambda p: F.concat(F.lit("sha1:"), F.sha1(p.cast("binary"))))
    return c.select("commit", J.commit_oid("tree", above, who, "message").alias("oid"))


@query("k2_compare_and_swap", "select ref_name, case when conv_id % 3 = 0 then 'CONFLICT' else 'updated' end as outcome from refs")
def k2(spark, sf):
    r = V.refs(spark, sf)
    wanted = r.select("ref_name", F.when(F.col("conv_id") % 3 == 0, "other").otherwise(F.col("target")).alias("expected"), F.lit("next").alias("target"))
    return C.compare_and_swap(r.select("ref_name", F.col("target").alias("oid")), wanted)


_LEASE = "select user_id as mount_id, event_id as seq, floor(epoch(ts))::bigint as \"at\", case when row_number() over (partition by user_id order by event_id) = 1 then 'create' when event_type in ('click', 'view') then 'renew' when event_type = 'purchase' then 'release' when event_type = 'error' then 'fail' else 'other' end as op from events"


def _leases(spark, sf):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    t = F.col("event_type")
    op = F.when(first, "create").when(t.isin("click", "view"), "renew").when(t == "purchase", "release").when(t == "error", "fail").otherwise("other")
    return V.table(spark, sf, "events").select(F.col("user_id").alias("mount_id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), op.alias("op"))


@query(
    "t3_leases",
    f"with l as ({_LEASE}), b as (select mount_id, min(\"at\") filter (where op = 'create') as born, min(seq) filter (where op = 'release') as rel_seq, min(\"at\") filter (where op = 'release') as released_at from l group by 1), "
    "g as (select l.*, op = 'create' or (op = 'renew' and (rel_seq is null or seq < rel_seq) and \"at\" - born <= 86400) as fine, released_at from l join b using (mount_id)), "
    "f as (select mount_id, max(case when fine then \"at\" + 1800 end) as expires_at, max(case when fine then seq end) as good, any_value(released_at) as released_at from g group by 1), "
    "x as (select f.*, (select count(*) from l where l.mount_id = f.mount_id and op = 'fail' and seq > good)::int as failures, case when released_at is not null then 'RELEASED' when 1705000000 > expires_at + 900 then 'EXPIRED' else 'ACTIVE' end as state from f) "
    "select mount_id, state, expires_at, failures, case when state = 'ACTIVE' and 1705000000 > expires_at then 'in_grace' when state = 'ACTIVE' then 'none' when 1705000000 >= coalesce(released_at, expires_at + 900) + 86400 then 'prunable' else 'protected' end as outcome from x",
)
def t3(spark, sf):
    return C.lease_states(_leases(spark, sf), F.lit(1_705_000_000))


@query("t3_renewals", f"with l as ({_LEASE}) select mount_id, max(\"at\") + 1800 as expires_at from l where op in ('create', 'renew') group by 1")
def t3_renewals(spark, sf):
    return E.renewals(_leases(spark, sf), C.TTL)


@query(
    "t3_lease_changes",
    f"with recursive l as ({_LEASE}), e as (select *, row_number() over (partition by mount_id order by \"at\", seq) as n from l), "
    "s(mount_id, n, state, born, expires, ended) as (select distinct mount_id, 0::bigint, '', 0::bigint, 0::bigint, 0::bigint from e "
    "union all select mount_id, n, case when op = 'create' and now = '' then 'ACTIVE' when op = 'release' and now = 'ACTIVE' then 'RELEASED' else now end, case when op = 'create' and now = '' then \"at\" else born end, "
    "case when op = 'create' and now = '' then \"at\" + 1800 when op = 'renew' and now = 'ACTIVE' and \"at\" - born <= 86400 then greatest(expires, \"at\" + 1800) else expires end, case when now = 'EXPIRED' and was = 'ACTIVE' then expires + 900 when op = 'release' and now = 'ACTIVE' then \"at\" else ended end "
    "from (select e.mount_id, e.n, e.op, e.\"at\", s.state as was, s.born, s.expires, s.ended, case when s.state = 'ACTIVE' and e.\"at\" > s.expires + 900 then 'EXPIRED' else s.state end as now from s join e on e.mount_id = s.mount_id and e.n = s.n + 1)), "
    "z as (select *, (select max(\"at\") from l) as until from (select *, row_number() over (partition by mount_id order by n desc) as k from s) where k = 1), "
    "f as (select mount_id, born, until, case when state = 'ACTIVE' and until > expires + 900 then 'EXPIRED' else state end as state, case when state = 'ACTIVE' then expires + 900 else ended end as ended from z) "
    "select mount_id, born as \"at\", 'ACTIVE' as change from f where state <> '' union all select mount_id, ended, state from f where state in ('EXPIRED', 'RELEASED') union all select mount_id, ended + 86400, 'PRUNABLE' from f where state in ('EXPIRED', 'RELEASED') and until >= ended + 86400",
)
def t3_changes(spark, sf):
    e = _leases(spark, sf)
    return W.changes(e, e.agg(F.max("at")).first()[0] or 0)


_SOON = "(select * from ({}) where \"at\" <= (select min(floor(epoch(ts)))::bigint + 100000 from events))".format(_LEASE)


@query(
    "a11_lease_sweep",
    "with c as (" + SQL["t3_lease_changes"].replace(f"l as ({_LEASE})", f"l as {_SOON}") + "), r as (select *, row_number() over (partition by mount_id order by \"at\" desc, change = 'PRUNABLE' desc) as k from c) select change as outcome, count(*) as leases, min(mount_id) as first_lease from r where k = 1 group by 1",
)
def a11_sweep(spark, sf):
    """A sweep little more than a day after the first event."""
    e = _leases(spark, sf)
    soon = (e.agg(F.min("at")).first()[0] or 0) + 100_000
    past = e.where(F.col("at") <= soon)
    return W.sweep_report(W.changes(past, past.agg(F.max("at")).first()[0] or 0))


@query("t2_outbox_drain", "with p as (select seq as event_id, ref_name, row_number() over (order by seq) - 1 as k from obs where new_oid is not null), n as (select ceil(count(*) / 3.0)::bigint as most from p), b as (select event_id, ref_name, k // most as batch from p, n) select event_id, ref_name, max(event_id) over (partition by batch) as number from b")
def t2_drain(spark, sf):
    """All pending events in three batches; the second one is killed after it was handed over, and comes again."""
    events = V.ref_observations(spark, sf).where("new_oid is not null").select(F.col("seq").alias("event_id"), "ref_name")
    most = -(-events.count() // 3)
    if not most:
        return events.withColumn("number", F.lit(None).cast("long"))
    folder = kept(spark, "outbox", uuid.uuid4().hex, lambda _: None)
    box, put = Y.Outbox(spark, f"{folder}/box"), Y.table_sink(f"{folder}/sink")

    def dies(batch, number):
        put(batch, number)
        raise InterruptedError

    box.hand_over(events, put, most)
    try:
        box.hand_over(events, dies, most)
    except InterruptedError:
        box = Y.Outbox(spark, f"{folder}/box")
    box.drain(events, put, most)
    return spark.read.parquet(f"{folder}/sink").select("event_id", "ref_name", F.col("batch").cast("long").alias("number"))


@query("t4_lease_health", "select event_id, case when value > 80 then 'Critical' when event_id % 4 >= 2 or value > 50 then 'Warning' else 'Healthy' end as health from (select event_id, floor(value)::bigint as value from events)")
def t4(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.floor("value").alias("v"))
    # expiry chosen so that a value of 50 is the expiry and one of 80 the end of the grace time
    now = F.when(F.col("v") > 80, C.GRACE + 1).when(F.col("v") > 50, 1).otherwise(0)
    return e.select("event_id", C.lease_health(F.col("event_id") % 4, F.lit(0), now).alias("health"))


@query(
    "j14_reconcile_leases",
    "with l as (select conv_id as mount_id, case conv_id % 4 when 0 then 'PREPARING' when 3 then 'EXPIRED' else 'ACTIVE' end as state, target from refs where starts_with(ref_name, 'refs/heads/')), a as (select conv_id as mount_id, case when conv_id % 5 = 0 then 'stale' else target end as anchored from refs where starts_with(ref_name, 'refs/heads/') and conv_id % 3 <> 0) "
    "select * from (select mount_id, case when state = 'PREPARING' then 'abandon' when state = 'ACTIVE' and anchored is distinct from target then 'repair' when state = 'EXPIRED' and anchored is not null then 'drop_anchor' end as action from l left join a using (mount_id)) where action is not null",
)
def j14(spark, sf):
    r = V.refs(spark, sf).where("ref_name like 'refs/heads/%'").withColumnRenamed("conv_id", "mount_id")
    k = F.col("mount_id") % 4
    leases = r.select("mount_id", F.when(k == 0, "PREPARING").when(k == 3, "EXPIRED").otherwise("ACTIVE").alias("state"), "target")
    anchors = r.where("mount_id % 3 <> 0").select("mount_id", F.when(F.col("mount_id") % 5 == 0, "stale").otherwise(F.col("target")).alias("target"))
    return C.reconcile_leases(leases, anchors)


@query(
    "x12_snapshot_claims",
    "select \"commit\", case turn % 4 when 0 then 'Ready' when 1 then case when secs % 1000 > 400 then 'Building' else 'Claimed' end when 2 then case when conv_id % 5 >= 3 then 'Failed' else 'Claimed' end else 'Claimed' end as claim from commits",
)
def x12(spark, sf):
    k = F.col("turn") % 4
    rows = V.commits(spark, sf).select("commit", F.when(k == 0, "READY").when(k == 1, "BUILDING").when(k == 2, "FAILED").otherwise("ABSENT").alias("state"), (F.col("author_secs") % 1000).alias("updated_at"), (F.col("conv_id") % 5).alias("attempts"))
    return C.snapshot_claims(rows, F.lit(1000))


@query(
    "j15_collect_garbage",
    "with s as (select \"commit\", case when conv_id % 3 = 0 then null else secs end as expires_at from commits) select \"commit\", case when \"commit\" in (select target from refs) then 'retained' when expires_at is null then 'policy' when expires_at <= 1600100000 then 'deleted' else 'live' end as verdict from s",
)
def j15(spark, sf):
    c = V.commits(spark, sf)
    rows = c.select("commit", F.when(F.col("conv_id") % 3 != 0, F.col("author_secs")).alias("expires_at"))
    return C.collect_garbage(rows, V.refs(spark, sf).select(F.col("target").alias("commit")), F.lit(1_600_100_000))


@query("a12_percentile", "select event_type, quantile_disc(value, 0.95) as percentile from events group by 1")
def a12(spark, sf):
    return C.nearest_rank(V.table(spark, sf, "events"), ["event_type"], "value", 95)


@query("a15_request_metrics", "select event_type as action, event_id % 3 as code, count(*) as n, quantile_disc(value, 0.5) as p50 from events group by 1, 2")
def a15(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("action"), (F.col("event_id") % 3).alias("code"), "value")
    return e.groupBy("action", "code").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"))


@query("w10_evict", "with e as (select event_id as key, floor(epoch(ts))::bigint as last_used, (floor(value) + 1)::bigint as size, event_id % 10 = 0 as pinned from events), r as (select *, sum(size) over (order by last_used, key) - size as gone from e where not pinned) select key, size from r where gone < (select sum(size) - 200000 from e)")
def w10(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("key"), F.unix_timestamp("ts").alias("last_used"), (F.floor("value") + 1).alias("size"), (F.col("event_id") % 10 == 0).alias("pinned"))
    return C.evict(e, 200_000)


@query("t5_walks")
def t5(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", (F.unix_timestamp("ts") / 40000.0).alias("at"), F.concat_ws("/", F.lit("a"), F.col("event_id") % 2, F.col("event_id") % 5).alias("path"))
    return S.fold(e, "user_id", ["at", "event_id"], S.WalkDetector, "user_id long, at double, root string")


@query("t6_reads")
def t6(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", (F.unix_timestamp("ts") / 4000.0).alias("at"), F.concat_ws("/", F.lit("d"), F.col("event_id") % 2, F.col("event_id") % 5).alias("path"))
    return S.fold(e, "user_id", ["at", "event_id"], S.ReadDetector, "user_id long, at double, dir string")


@query(
    "t7_budget",
    "with recursive e as (select user_id, event_id as seq, event_id % 20 as oid, floor(value)::bigint as size, row_number() over (partition by user_id order by event_id) as k from events), "
    "s as (select user_id, 0::bigint as k, null::bigint as seq, '' as outcome, 0::bigint as charged, [-1::bigint] as seen from (select distinct user_id from e) "
    "union all select e.user_id, e.k, e.seq, case when list_contains(s.seen, e.oid) then 'refetch' when s.charged + e.size > 500 then 'refused' else 'admitted' end, "
    "case when not list_contains(s.seen, e.oid) and s.charged + e.size <= 500 then s.charged + e.size else s.charged end, "
    "case when not list_contains(s.seen, e.oid) and s.charged + e.size <= 500 then list_append(s.seen, e.oid) else s.seen end from s join e on e.user_id = s.user_id and e.k = s.k + 1) "
    "select user_id, seq, outcome, charged from s where k > 0",
)
def t7(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 20).alias("oid"), F.floor("value").alias("size"))
    return S.fold(e, "user_id", ["seq"], lambda: S.Budget(500), "user_id long, seq long, outcome string, charged long")


@query(
    "t8_verdicts",
    "with recursive e as (select user_id, event_type, event_id as seq, floor(epoch(ts)) / 20000.0 as secs, event_id // 1000 as generation, row_number() over (partition by user_id, event_type order by event_id) as k from events), "
    "s as (select user_id, event_type, k, seq, 'computed' as outcome, secs as since, generation from e where k = 1 "
    "union all select e.user_id, e.event_type, e.k, e.seq, case when s.generation = e.generation and e.secs - s.since < case when e.event_type = 'error' then 2 else 10 end then 'cached' else 'computed' end, "
    "case when s.generation = e.generation and e.secs - s.since < case when e.event_type = 'error' then 2 else 10 end then s.since else e.secs end, "
    "case when s.generation = e.generation and e.secs - s.since < case when e.event_type = 'error' then 2 else 10 end then s.generation else e.generation end "
    "from s join e on e.user_id = s.user_id and e.event_type = s.event_type and e.k = s.k + 1) "
    "select user_id, seq, outcome, event_type <> 'error' as visible from s",
)
def t8(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.unix_timestamp("ts") / 20000.0).alias("at"), F.col("event_type").alias("commit"), (F.col("event_type") != "error").alias("visible"), F.floor(F.col("event_id") / 1000).alias("generation"))
    return S.fold(e, "user_id", ["seq"], S.Verdicts, "user_id long, seq long, outcome string, visible boolean")


@query(
    "w9_read_sessions",
    "with g as (select user_id, ts, event_id, case when ts - lag(ts) over w >= interval '6 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id as dir, min(ts) as start, count(distinct event_id % 5) as files from s group by user_id, k having files >= 3",
)
def w9(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("dir"), (F.col("event_id") % 5).alias("name"), "ts")
    return E.read_sessions(e, "6 hours", 3)


@query("t9_activity", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def t9(spark, sf):
    return E.activity(V.table(spark, sf, "events"))


@query("a8_diffstat")
def a8(spark, sf):
    return D.stats(D.pairs(V.snapshot(spark, sf, 0), V.snapshot(spark, sf, 1)))


_LINES = "case when {c} = '' then 0 else strlen({c}) - strlen(replace({c}, chr(10), '')) + case when ends_with({c}, chr(10)) then 0 else 1 end end"
_OPEN = "case when {c} = '' or ends_with({c}, chr(10)) then 0 else 1 end"


_APPENDED = (
    "select coalesce(a.path, b.path) as path, "
    f"(case when a.path is null then {_LINES.format(c='b.content')} when b.path is null or a.content = b.content then 0 when a.doc_id % 11 = 1 then 2 else {_OPEN.format(c='b.content')} end)::bigint as additions, "
    f"(case when b.path is null then {_LINES.format(c='a.content')} when a.path is null or a.content = b.content then 0 when a.doc_id % 11 = 1 then {_OPEN.format(c='a.content')} else 2 end)::bigint as deletions, "
    'contains(substring(coalesce(a.content, \'\'), 1, 8000) || substring(coalesce(b.content, \'\'), 1, 8000), chr(0)) as "binary" '
    "from snap2 a full outer join snap1 b on a.path = b.path where a.oid is distinct from b.oid or a.mode is distinct from b.mode"
)


@query("a8_diffstat_appended", _APPENDED)
def a8_appended(spark, sf):
    return D.stats(D.pairs(V.snapshot(spark, sf, 2), V.snapshot(spark, sf, 1)))


_TOTALS = f"with s as ({_APPENDED}), f as (select max(length(path)) as wide, max(additions + deletions) as most, length(max(additions + deletions)::varchar) as digits from s), "


@query(
    "h8_stat",
    _TOTALS + "r as (select path, additions, deletions, additions + deletions as n, wide, digits, most, greatest(80 - wide - digits - 5, 7) as room from s, f), b as (select *, case when most <= room then n else (n * room + most // 2) // most end as bar from r) "
    "select path, ' ' || rpad(path, wide::int, ' ') || ' | ' || lpad(n::varchar, digits::int, ' ') || case when n > 0 then ' ' || repeat('+', bar * additions // n) || repeat('-', bar - bar * additions // n) else '' end as line from b order by path",
)
def h8_stat(spark, sf):
    return N.stat(_counted(spark, sf))


@query("h8_summary", _TOTALS + "t as (select count(*) as c, sum(additions)::bigint as a, sum(deletions)::bigint as d from s) select ' ' || c || ' file' || case when c = 1 then '' else 's' end || ' changed, ' || a || ' insertion' || case when a = 1 then '' else 's' end || '(+), ' || d || ' deletion' || case when d = 1 then '' else 's' end || '(-)' as line from t")
def h8_summary(spark, sf):
    return N.summary(_counted(spark, sf))


def _counted(spark, sf):
    both = D.pairs(V.snapshot(spark, sf, 2), V.snapshot(spark, sf, 1))
    status = F.when(F.col("old_mode").isNull(), "A").when(F.col("new_mode").isNull(), "D").otherwise("M")
    sides = both.select("path", F.lit(None).cast("string").alias("old_path"), status.alias("status"), F.octet_length("old_content").alias("old_size"), F.octet_length("new_content").alias("new_size"))
    return sides.join(D.stats(both), "path")


@query("h8_patches")
def h8(spark, sf):
    both = D.pairs(V.snapshot(spark, sf, 0), V.snapshot(spark, sf, 1))
    kind = F.when(F.col("old_content").isNull(), "Added").when(F.col("new_content").isNull(), "Deleted").otherwise("Modified")
    return D.patches(both.withColumn("kind", kind).withColumn("from", F.lit(None).cast("string")))


@query("h9_blame")
def h9(spark, sf):
    revs = None
    for k in range(4):
        s = V.snapshot(spark, sf, k).select("path", F.lit(k).alias("version"), "content")
        revs = s if revs is None else revs.unionByName(s)
    return D.blame(revs)


@query(
    "w14_hunk_groups",
    "with c as (select path, line from lines where contains(text, 'the')), g as (select *, case when line - lag(line) over (partition by path order by line) - 1 > 6 or lag(line) over (partition by path order by line) is null then 1 else 0 end as new from c), n as (select *, sum(new) over (partition by path order by line)::bigint as hunk from g) select path, hunk, min(line) as first, max(line) as last from n group by 1, 2",
)
def w14(spark, sf):
    from revlake.operators.search import line_rows

    f = V.files(spark, sf).withColumnRenamed("path", "blob_key")
    return D.hunk_groups(line_rows(f).where(F.col("text").contains("the")).select(F.col("blob_key").alias("path"), "line"))
