"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

#: ``crc(x)``: unsigned CRC-32 of a string's UTF-8 bytes, one step a byte over a table made by rule.
CRC32 = """
crc_table as materialized (
  select list(c order by i) as crc_t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) as c from range(256) r(i)
  )
), hex_digits as (select '0123456789ABCDEF' as hex_d)
"""


def crc32(text: str) -> str:
    """SQL of the checksum of ``text``, a string expression; reads the columns of ``crc_table`` and ``hex_digits``."""
    h = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, length({h})::bigint, 2), lambda i: 16 * (instr(hex_d, {h}[i + 1]) - 1) + instr(hex_d, {h}[i + 2]) - 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])))"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str) -> str:
    return f"regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from {table}"


IMPORTANCE = f"""
with {CRC32}, docs as (select doc_id, {_words("documents")}), target as (select {_words("benchmark")}),
d_words as (select doc_id, unnest(ws) as w from docs), t_words as (select unnest(ws) as w from target),
counted as (
  select w, sum(s)::bigint as s, sum(t)::bigint as t from (select w, 1 as s, 0 as t from d_words union all select w, 0, 1 from t_words) group by w
), coded as (
  select w, s, t, {crc32("w")} % 10000 as bucket from counted, crc_table, hex_digits
), totals as (select sum(s) as s_all, sum(t) as t_all from counted),
gain as (
  select bucket, floor(1000 * ln((sum(t)::double + 1) * (max(s_all)::double + 10000) / ((sum(s)::double + 1) * (max(t_all)::double + 10000))))::bigint as g
  from coded, totals group by bucket
), weights as (
  select doc_id, sum(g)::bigint as weight from d_words join coded using (w) join gain using (bucket) group by doc_id
), scored as (
  select doc_id, coalesce(len(ws), 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    list_reduce(list_prepend(0::bigint, list_transform(range(8), lambda i: instr('0123456789abcdef', sha256('2024:' || doc_id::varchar)[i + 1]) - 1)), lambda a, x: a * 16 + x) as h
  from docs left join weights using (doc_id)
), noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from noisy where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= floor(10 * (select count(*) from ranked) / 100) then rank end as rank
from noisy left join ranked using (doc_id)
"""

SPELLING = f"""
with recursive {CRC32}, runs as (
  select coalesce(doc_id::varchar, '') as doc, {_lower("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} as run from documents
), counted as (select doc, run, count(*) as k, length(run) as size from runs where length(run) >= 6 group by all),
hashed as (select run, k, size, {crc32("doc || ':' || run")} as h from counted, crc_table, hex_digits),
dropped as (select case when h % 199 = 0 then substr(run, 1, h % size) || substr(run, h % size + 2) else run end as word, k from hashed),
words as (select word, sum(k)::bigint as n from dropped where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, unnest(range(1, length(word)::bigint + 1)) as i from words),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from cut),
near as (
  select a.word, b.word as other, b.n as m from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from words a join less b on a.word = b.rest
  union select b.word, a.word, a.n from words a join less b on a.word = b.rest
), best as (select word, count(*) as n_near, first(other order by m desc, other) as near, max(m) as m from near group by word),
formed as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * n then near end as form, case when m >= 5 * n then m end as form_n
  from words left join best using (word)
), chain as (
  select word, word as now, form as next from formed
  union all select c.word, f.word, f.form from chain c join formed f on c.next = f.word
)
select word, form, root, n, n_near, form_n from formed join (select word, now as root from chain where next is null) using (word)
"""
