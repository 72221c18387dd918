"""DuckDB SQL for the queries that SQL can express on whole tables."""

_COMPONENTS = """
, reach(a, b) as (select id, id from nodes union select r.a, l.b from reach r join links l on l.a = r.b)
, components as (select a as id, min(b) as component_id from reach group by a)
"""

SQL = {
    "op4_embedding_near_dedup": """
with recursive v as (
  select vec_id as id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0)
, links as (select p.id as a, q.id as b from v p join v q on p.id <> q.id
            where list_inner_product(p.e, q.e) / (sqrt(list_inner_product(p.e, p.e)) * sqrt(list_inner_product(q.e, q.e))) >= 0.95)
, nodes as (select vec_id as id from embeddings)
"""
    + _COMPONENTS
    + """
select n.id as vec_id, (select count(*) from links l where l.a = n.id) as n_links, c.component_id, n.id = c.component_id as kept
from nodes n join components c on c.id = n.id
""",
    "op5_tool_calls": """
with recursive calls as (
  select conv_id, turn, turn // 2 as k, 'call_' || turn as call_id, text,
    case when (turn // 2) % 2 = 0 then 'answer' else 'search' end as name,
    case when turn // 2 > 0 then 'call_' || ((turn // 2 - 1) // 2 * 2 + turn % 2) end as needs
  from conversations where role = 'user')
, results as (select conv_id, 'call_' || (turn - 1) as call_id, text as content from conversations where role = 'assistant')
, levels(conv_id, call_id, level, unknown) as (
  select c.conv_id, c.call_id, 0, c.needs is not null from calls c
  where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.call_id = c.needs)
  union all
  select c.conv_id, c.call_id, l.level + 1, false from levels l join calls c on c.conv_id = l.conv_id and c.needs = l.call_id)
, rows as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id,
    case when c.call_id is null then 'orphan' when r.call_id is not null then 'answered' else 'pending' end as status,
    l.level, c.turn, c.text, c.name, c.needs, r.content, l.unknown
  from calls c left join levels l on l.conv_id = c.conv_id and l.call_id = c.call_id
  full join results r on r.conv_id = c.conv_id and r.call_id = c.call_id)
select conv_id, call_id, status, level, turn,
  case when status <> 'orphan' then text is not null and not unknown end as valid,
  case when status <> 'orphan' then concat_ws('; ',
    case when text is null and name = 'answer' then 'text: missing' when text is null then 'limit: missing; query: missing' end,
    case when unknown then 'needs: unknown call' end) end as errors,
  '{' || concat_ws(',',
    case when name = 'answer' then '"arguments":{' || concat_ws(',', '"text":' || to_json(text), '"turn":' || turn) || '}'
         when name = 'search' then '"arguments":{' || concat_ws(',', '"limit":' || length(text), '"query":' || to_json(text)) || '}' end,
    '"call_id":' || to_json(call_id), '"content":' || to_json(content), '"level":' || level,
    '"name":' || to_json(name), '"needs":' || to_json(needs), '"status":' || to_json(status)) || '}' as json
from rows
""",
    "op6_exact_top_k": """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: floor(256 * x::double)) as t from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
, scored as (
  select q.id as query_id, d.id as vec_id, list_inner_product(q.t, d.t)::bigint as score
  from v q join v d on q.id <> d.id where q.id % 50 = 0)
, ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op10_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents)
, shingled as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words)
, grams as (select doc_id, len(s) as n, unnest(s) as g from shingled)
, shared as (
  select p.doc_id as a, q.doc_id as b, any_value(p.n) as na, any_value(q.n) as nb, count(*) as c
  from grams p join grams q on p.g = q.g and p.doc_id <> q.doc_id group by 1, 2)
, links as (select a, b from shared where 100 * c >= 75 * (na + nb - c))
, nodes as (select doc_id as id from documents)
"""
    + _COMPONENTS
    + """
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id from shingled s join components c on c.id = s.doc_id
""",
    "op12_conversation_trie": """
with convs as (select distinct conv_id as c from conversations where conv_id is not null)
, heads as (
  select c, c - c % 100 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 as h
  from convs)
, turns as (
  select conv_id as c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t
  from conversations where conv_id is not null group by 1)
, rebuilt as (
  select h.c, coalesce(b.t[1:h.h], []) || coalesce(o.t[h.h + 1:], []) as t
  from heads h join turns o on o.c = h.c left join turns b on b.c = h.base)
, members as (select c, t, unnest(range(0, len(t) + 1)) as d from rebuilt)
, prefixes as (select c, d, t[1:d] as p, len(t) = d as ends from members)
, nodes as (
  select d, p, min(c) as conv_id, count(*) as n_convs, list(c order by c) as ids,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from prefixes group by d, p)
, linked as (select n.*, u.conv_id as parent_conv_id from nodes n left join nodes u on u.d = n.d - 1 and u.p = n.p[1:n.d - 1])
, childs as (select d - 1 as d, p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1, 2)
, own as (
  select l.*, coalesce(k.n, 0) as n_children, case when l.d = 0 then 0 else (l.n_convs - 1) * length(l.p[l.d].text) end as saved
  from linked l left join childs k on k.d = l.d and k.p = l.p)
, below as (select unnest(range(0, o.d + 1)) as d, o.p, o.n_children = 0 as leaf, o.saved from own o)
, subtree as (select d, p[1:d] as p, count(*) filter (leaf) as n_leaves, sum(saved)::bigint as saved_tokens from below group by 1, 2)
select o.conv_id, o.d as depth, o.parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
from own o join subtree s on s.d = o.d and s.p = o.p
""",
}
