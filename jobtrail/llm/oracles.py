"""The same questions in plain SQL, without hashes, samples or automata."""

QUALITY_RULES = r"""
with d as (select doc_id, source as host, text, coalesce(text, '') as body from documents),
w as (select doc_id, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
tri as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3) x),
covered as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as p
    from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) t where c > 1) u
  group by doc_id),
texts as (select host, text, min(doc_id) as owner from d group by host, text),
line as (
  select host, owner, l,
         regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g') as norm
  from (select host, owner, unnest(string_split(coalesce(text, ''), chr(10))) as l from texts) x
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
held as (
  select host, owner, norm,
         sum(len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as words
  from line group by host, owner, norm),
frequent as (
  select host, norm, min(owner) as keeper from held group by host, norm having count(*) > 20),
lost as (
  select h.owner, sum(h.words) as words from held h join frequent f
    on h.host is not distinct from f.host and h.norm = f.norm and h.owner <> f.keeper
  group by h.owner),
own as (
  select d.doc_id, len(list_filter(string_split(d.body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
         - len(list_distinct(list_filter(string_split(d.body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
         t.owner
  from d join texts t on d.host is not distinct from t.host and d.text is not distinct from t.text),
s as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(n_dup_lines as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
         cast(len(ws) - coalesce(lost.words, 0) as bigint) as n_words_left
  from w join own using (doc_id) left join covered c using (doc_id) left join lost on lost.owner = own.owner)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_words_left >= 30 * n_words as kept
from s
"""

URL_RULES = r"""
with p as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p),
r(verdict, host, path) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
select u.page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
       coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') as verdict
from u left join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
group by u.page_id, u.host, u.path
"""

DECONTAMINATE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark where text is not null),
bw as (
  select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i:i + 9], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0) x),
dw as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as win
  from (select doc_id, ws, k, unnest(range(1, cast(len(ws) - k + 2 as bigint))) as i
        from d, (select distinct k from bw) ks where len(ws) >= k) x),
hit as (select doc_id, i, dw.k, item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
places as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, cast(i + k as bigint))) as p from hit) x group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) x group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(list, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""

NEAR_DUPLICATES = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0) x),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as same
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (
  select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 85 * (x.n + y.n - same)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (
  select a, b from edge
  union
  select reach.doc_id, edge.b from reach join edge on reach.other = edge.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles,
       cast(least(d.doc_id, coalesce(r.low, d.doc_id)) as bigint) as component_id,
       d.doc_id <= coalesce(r.low, d.doc_id) as kept
from d left join n using (doc_id)
left join (select doc_id, min(other) as low from reach group by doc_id) r using (doc_id)
"""

FILTER_AUDIT = r"""
with letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a join letters b on b.f <> a.f join letters c on c.f not in (a.f, b.f)
  join letters d on d.f not in (a.f, b.f, c.f) join letters e on e.f not in (a.f, b.f, c.f, d.f)),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
first as (select body, min(doc_id) as low from d group by body),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(ws) < 200 then 'A' else '' end
         || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
         || case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) then 'C' else '' end
         || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
         || case when coalesce(low < d.doc_id, false) then 'E' else '' end as fails
  from d join first using (body) left join l on l.doc_id = d.doc_id),
g as (select part, good, toxic, fails, count(*) as n from m group by part, good, toxic, fails),
x as (
  select part, filter_order, step, good, toxic, fails, n, substr(filter_order, step, 1) as f,
         contains(fails, substr(filter_order, step, 1)) as here,
         len(list_filter(range(1, step), lambda k: contains(fails, substr(filter_order, k, 1)))) > 0 as gone
  from g cross join steps),
s as (
  select part, filter_order, step, f,
         sum(case when not here and not gone then n else 0 end) as kept,
         sum(case when here and not gone then n else 0 end) as removed,
         sum(case when here and gone then n else 0 end) as redundant,
         sum(case when fails = f then n else 0 end) as unique_fails,
         sum(case when here and not gone and good then n else 0 end) as good_lost,
         sum(case when here and not gone and toxic then n else 0 end) as toxic_lost
  from x group by part, filter_order, step, f)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from s
"""

SUFFIX_DEDUP = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (
  select doc_id, i, substr(h, 2 * i + 1, 200) as s
  from (select doc_id, h, unnest(range(0, cast(length(h) // 2 - 99 as bigint))) as i from d where length(h) >= 200) x),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) x where k > 1),
run as (
  select doc_id, min(i) as b, max(i) + 100 as e
  from (select doc_id, i, sum(opens) over (partition by doc_id order by i) as run
        from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as opens
              from again) x) y
  group by doc_id, run),
cut as (select doc_id, b, e, coalesce(lag(e) over (partition by doc_id order by b), 0) as before from run),
kept as (
  select c.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (b - before)), '' order by b) as head, max(e) as last,
         sum(e - b) as removed, count(*) as spans
  from cut c join d using (doc_id) group by c.doc_id)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
       cast(coalesce(spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join kept k using (doc_id)
"""
