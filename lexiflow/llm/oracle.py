"""The same results as SQL, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op2_mixing"] = r"""
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('mix-1/' || coalesce(doc_id::varchar, '')) as draw
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, 3 * source_size as cap,
    [5, 2, 1][1 + (row_number() over (order by source asc nulls last) - 1) % 3]::bigint as w
  from totals),
summed as (
  select *,
    sum(source_size) over () - coalesce(sum(cap) over before, 0) as remaining,
    sum(w) over () - coalesce(sum(w) over before, 0) as weights
  from weighed
  window before as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, cap / w <= remaining / weights as is_full from summed),
shares as (
  select *,
    (select max_by(remaining, weights) from levels where not is_full) as level_left,
    (select max(weights) from levels where not is_full) as level_weights
  from levels),
targets as (
  select source, source_size,
    case when is_full then cap::double else (level_left * w)::double / level_weights::double end as target
  from shares),
steps as (
  select *,
    floor(case when source_size > 0 then target / source_size else 0 end * 16777216)::bigint as expected
  from targets),
ranked as (
  select *, row_number() over (partition by source order by size desc, draw, doc_id) as place from sized),
ends as (
  select r.doc_id, r.size, t.source, t.source_size, t.target, t.expected, place * expected as last
  from ranked r join steps t on r.source is not distinct from t.source),
offsets as (
  select source, k, ('0x' || substr(md5('mix-1:' || k || ':' || coalesce(source, '')), 1, 6))::bigint as start
  from steps, range(16) r(k)),
tried as (
  select e.source, k, start,
    abs(sum((((last + start) >> 24) - ((last - expected + start) >> 24)) * size) - any_value(target)) as miss
  from ends e join offsets o on e.source is not distinct from o.source
  group by e.source, k, start),
chosen as (select source, arg_min(start, (miss, k)) as start from tried group by source),
copied as (
  select e.*, ((last + start) >> 24) - ((last - expected + start) >> 24) as copies
  from ends e join chosen c on e.source is not distinct from c.source)
select doc_id, size, source_size, target, copies * size as taken, copies from copied
"""

SQL["op6_line_dedup"] = r"""
with docs as (select *, row_number() over () as row_no from documents),
parts as (
  select doc_id, text, source, row_no, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as place
  from docs where text is not null),
spread as (
  select trim(line) as line from parts where trim(line) <> ''
  group by 1 having count(distinct coalesce(source, chr(1))) >= 6),
marked as (
  select p.*, s.line is not null as wide,
    row_number() over (partition by trim(p.line) order by p.doc_id nulls last, p.place) as nth
  from parts p left join spread s on trim(p.line) = s.line),
rebuilt as (
  select row_no, count(*) filter (trim(line) <> '') as n_lines,
    count(*) filter (wide and nth > 1) as n_removed,
    coalesce(string_agg(line, chr(10) order by place) filter (not (wide and nth > 1)), '') as text
  from marked group by row_no)
select d.doc_id, coalesce(r.n_lines, 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed,
  case when d.text is not null then r.text end as text
from docs d left join rebuilt r using (row_no)
"""

SQL["op7_archive"] = r"""
with rows as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
marked as (
  select *, sha1(body) as payload_digest,
    case when payload_bytes >= 1000 then max(page_id) over (partition by body) end as largest
  from rows)
select page_id, payload_bytes, payload_digest,
  case when largest is not null and page_id is distinct from largest then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from largest then largest end as refers_to
from marked
"""

SQL["op9_top_k"] = r"""
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from rows q join rows c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from pairs qualify rank <= 5
"""

SQL["op11_hard_negatives"] = r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::bigint as score
  from rows a join rows c on a.vec_id % 50 = 0 and len(a.v) = len(c.v)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same and anchor_id <> vec_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id,
  (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

SQL["op12_divergence"] = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as (select lang, term from words group by all having count(distinct id) >= 10),
cells as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
langs as (
  select lang, count(*) as v, coalesce((select sum(n) from cells c where c.lang = l.lang), 0) as total
  from kept l group by lang),
groups as (
  select g.lang, g.source, coalesce(v, 0) as v, l.total as lang_total,
    coalesce((select sum(n) from cells c where c.lang = g.lang and c.source = g.source), 0) as total
  from (select distinct lang, source from docs) g left join langs l on g.lang = l.lang),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 
    (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v))::bigint as p,
    (1 + (1000000000::hugeint * (sum(coalesce(c.n, 0)) over (partition by g.lang, k.term) + 2)) // (g.lang_total + 2 * g.v))::bigint as q
  from groups g join kept k on g.lang = k.lang left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair_sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pair_sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from shares where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from found)
select * from ranked where part = 'pair' or rank <= 10
"""
