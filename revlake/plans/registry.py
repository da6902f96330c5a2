"""Registered queries and the SQL that checks them.

``query(name, sql)`` registers a function ``(spark, sf_dir) -> DataFrame``.  The SQL runs in DuckDB over the same tables; common
relations are the CTEs below, the counterparts of :mod:`revlake.sources.views`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_OID = "'sha1:' || sha1('blob ' || strlen({c}) || chr(0) || {c})"
CTES = {
    "files": ((), "select doc_id, source || '/' || lang || '/doc-' || doc_id || '.txt' as path, coalesce(text, '') as content, strlen(coalesce(text, ''))::bigint as size, " + _OID.format(c="coalesce(text, '')") + " as oid, 33188 as mode from documents"),
    **{
        f"snap{k}": (
            ("files",),
            f"select 'rev-{k}' as \"commit\", doc_id, path, content, strlen(content)::bigint as size, {_OID.format(c='content')} as oid, case when doc_id % 17 = {k} then 33261 else 33188 end as mode "
            f"from (select doc_id, path, case when doc_id % 11 = {k} then content || chr(10) || 'rev {k}' else content end as content from files where doc_id % 7 <> {k})",
        )
        for k in range(4)
    },
    "anc": (("files",), "select f.path, array_to_string(parts[1:i], '/') as dir, i as level from (select path, string_split(path, '/') as parts from files) f, unnest(range(1, len(parts))) as t(i)"),
    "turns": ((), "select conv_id, turn, min(role) as role, min(text) as message from conversations group by 1, 2"),
    "lasts": (("turns",), "select conv_id, max(turn) as last, min(turn) as first from turns group by 1"),
    "commits": (
        ("turns", "lasts"),
        "select 'c-' || t.conv_id || '-' || t.turn as \"commit\", t.conv_id, t.turn, t.message, t.role, 1600000000 + t.conv_id * 3600 + t.turn * 60 as secs, ((t.conv_id % 25) - 12) * 60 as tz, t.turn > l.first as later "
        "from turns t join lasts l using (conv_id)",
    ),
    "edges": (
        ("commits", "lasts"),
        "select \"commit\", 'c-' || conv_id || '-' || (turn - 1) as parent, 0 as pos from commits where later "
        "union all select c.\"commit\", 'c-' || l.conv_id || '-' || l.last, 0 from commits c join lasts l on l.conv_id = c.conv_id - 1 where not c.later "
        "union all select c.\"commit\", 'c-' || l.conv_id || '-' || l.last, case when exists (select 1 from lasts x where x.conv_id = c.conv_id - 1) then 1 else 0 end from commits c join lasts l on l.conv_id = c.conv_id - 2 where not c.later and c.conv_id % 5 = 0",
    ),
    "refs": (
        ("lasts",),
        "select 'refs/heads/conv-' || conv_id as ref_name, 'c-' || conv_id || '-' || last as target, conv_id from lasts "
        "union all select 'refs/tags/v-' || conv_id, 'c-' || conv_id || '-' || last, conv_id from lasts where conv_id % 10 = 0 "
        "union all select 'refs/internal/mounts/m-' || conv_id, 'c-' || conv_id || '-' || last, conv_id from lasts where conv_id % 9 = 0",
    ),
    "tagged": (
        ("lasts",),
        "select 't-' || conv_id as tag, case when conv_id % 3 = 0 then 'tree-' || conv_id else 'c-' || conv_id || '-' || last end as target from lasts where conv_id % 2 = 0 "
        "union all select 't-t-' || conv_id, 't-' || conv_id from lasts where conv_id % 4 = 0",
    ),
    "ov": (
        ("snap3",),
        "select case when k = 3 then 'moved/doc-' || doc_id || '.txt' else path end as path, k <> 1 as present, 'file' as kind, false as opaque, "
        "case when k = 1 then null when k = 2 then " + _OID.format(c="(content || chr(10) || 'local')") + " else oid end as oid, case when k = 1 then null when k = 4 then 33261 + 33188 - mode else mode end as mode, "
        "case when k = 1 then null when k = 2 then size + 6 else size end as size, case when k = 3 then path end as renamed_from, case when k <> 3 then oid end as base_oid, case when k <> 3 then mode end as base_mode "
        "from (select *, doc_id % 13 as k from snap3 where not starts_with(path, 'src5/de/')) where k in (1, 2, 3, 4) "
        "union all select path, false, 'file', false, null, null, null, null, null, null from snap3 where doc_id % 13 = 3 and not starts_with(path, 'src5/de/') "
        "union all select 'new/doc-' || doc_id || '.txt', true, 'file', false, " + _OID.format(c="coalesce(text, '')") + ", 33188, strlen(coalesce(text, '')), null, null, null from documents where doc_id % 29 = 0 "
        "union all select 'src7/en', true, 'directory', true, null, null, null, null, null, null union all select 'src3/fr', false, 'directory', false, null, null, null, null, null, null union all select 'src5/de', false, 'directory', false, null, null, null, null, null, null",
    ),
    "gone": (("ov",), "select renamed_from as path from ov where present and renamed_from is not null and (exists (select 1 from ov o where o.path = ov.renamed_from and not o.present) or exists (select 1 from ov o where (not o.present or o.kind <> 'directory' or o.opaque) and starts_with(ov.renamed_from, o.path || '/')))"),
    "changes": (
        ("ov", "gone"),
        "select path, 'Deleted' as kind, null as \"from\", base_mode as old_mode, null::int as new_mode, base_oid as old_oid, null as new_oid, 0::bigint as new_size from ov where not present and base_oid is not null and path not in (select path from gone) "
        "union all select path, kind2, case when kind2 = 'Renamed' then renamed_from end, base_mode, mode, base_oid, oid, size from (select *, case when renamed_from in (select path from gone) then 'Renamed' when base_oid is null then 'Added' when base_oid <> oid then 'Modified' when base_mode <> mode then 'ModeChanged' end as kind2 from ov where present and kind <> 'directory') where kind2 is not null",
    ),
    # the files that a user of the overlay sees, with their contents and where the bytes are
    "seen": (
        ("snap3", "ov"),
        "select coalesce(r.path, s.path) as path, s.doc_id, s.content, 'base' as source from snap3 s left join (select * from ov where present and renamed_from is not null) r on r.renamed_from = s.path "
        "where r.path is not null or (not exists (select 1 from ov o where o.path = s.path) and not exists (select 1 from ov o where (not o.present or o.opaque or o.kind <> 'directory') and starts_with(s.path, o.path || '/'))) "
        "union all select o.path, null, coalesce(s.content || case when s.doc_id % 13 = 2 then chr(10) || 'local' else '' end, d.text, ''), 'local' from ov o left join snap3 s on s.path = o.path left join documents d on 'new/doc-' || d.doc_id || '.txt' = o.path "
        "where o.present and o.kind = 'file' and o.renamed_from is null and not exists (select 1 from ov b where (not b.present or b.kind <> 'directory') and starts_with(o.path, b.path || '/'))",
    ),
    "seen_lines": (("seen",), "select path, source, unnest(l) as text, unnest(range(1, len(l) + 1)) as line from (select path, source, case when content = '' then []::varchar[] when ends_with(content, chr(10)) then string_split(content, chr(10))[:-2] else string_split(content, chr(10)) end as l from seen)"),
    "obs": ((), "select event_id as seq, 'refs/heads/u-' || user_id as ref_name, case when event_type <> 'error' then event_type end as new_oid from events"),
    "lines": (("files",), "select doc_id as blob_key, path, unnest(l) as text, unnest(range(1, len(l) + 1)) as line from (select doc_id, path, case when content = '' then []::varchar[] when ends_with(content, chr(10)) then string_split(content, chr(10))[:-2] else string_split(content, chr(10)) end as l from files)"),
}


def with_ctes(sql: str) -> str:
    """The SQL with the CTEs it names in front."""
    import re

    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not order:
        return sql
    head = ", ".join(f"{n} as ({CTES[n][1]})" for n in order)
    body = sql.strip()
    return f"with recursive {head}, {body[15:]}" if body.lower().startswith("with recursive ") else f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_ctes(sql)
        return f

    return register
