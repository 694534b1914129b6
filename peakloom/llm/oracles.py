"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
bw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as g from (select *, least(8, len(w)) as m from b where len(w) > 0), unnest(range(1, len(w) - m + 2)) as r(i)),
dw as (select doc_id, s.m, i, array_to_string(w[i:i + s.m - 1], ' ') as g from d, (select distinct m from bw) s, unnest(range(1, greatest(1, len(w) - s.m + 2))) as r(i)),
h as (select doc_id, i, dw.m, item_id from dw join bw on dw.m = bw.m and dw.g = bw.g),
hit as (select doc_id, count(distinct p) as n_hit from h, unnest(range(i, i + m)) as r(p) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)"""

OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 1], ' ') as g from w, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) as r(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)),
e as (select x, y from l union all select y, x from l),
c(doc_id, other) as (select doc_id, doc_id from w union select c.doc_id, e.y from c join e on c.other = e.x),
m as (select doc_id, min(other) as component_id from c group by doc_id)
select m.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, m.doc_id = component_id as kept from m left join n using (doc_id)"""
