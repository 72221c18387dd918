"""DuckDB SQL for the registered queries; each text stands alone."""

from __future__ import annotations


def _uuid3(x: str) -> str:
    m = f"md5({x})"
    return (
        f"(substr({m},1,8)||'-'||substr({m},9,4)||'-3'||substr({m},14,3)||'-'||"
        f"translate(substr({m},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({m},18,3)||'-'||substr({m},21,12))"
    )


def _id(kind: str, key: str) -> str:
    return _uuid3(f"'{kind}/'||({key})")


_CTE = {
    "gen": "select l_partkey as p, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 7 <> 0 group by 1",
    "entity": f"""select {_id('part', 'p_partkey')} as entity_id, case when p_size % 10 <> 0 then 'product/'||lower(p_type) end as entity_type, p_brand as batch,
      p_name as product_name, case when o is not null then {_id('order', 'o')} end as was_generated_by, p_partkey from part left join gen on p = p_partkey""",
    "activity": f"""select {_id('order', 'o_orderkey')} as activity_id, 'order/'||lower(o_orderstatus) as activity_type, o_orderdate as started_at,
      (select max(l_shipdate) from lineitem where l_orderkey = o_orderkey) as ended_at from orders""",
    "agent": f"""select {_id('supplier', 's_suppkey')} as agent_id, s_name as agent_name, 'organization/supplier' as agent_type from supplier
      union all select {_id('customer', 'c_custkey')}, c_name, 'organization/customer' from customer""",
    "derived": f"""select {_id('part', 'p')} as src, {_id('part', 'q')} as dst from (select p_partkey as p, p_partkey // 2 as q from part where p_partkey > 0
      union all select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 5 = 0 and p_partkey // 3 <> p_partkey // 2)""",
    "edge": f"""select {_id('order', 'o')} as src, 'used' as rel, {_id('part', 'p')} as dst from (select distinct l_orderkey o, l_partkey p from lineitem)
      union all select {_id('order', 'o')}, 'wasAssociatedWith', {_id('supplier', 'p')} from (select distinct l_orderkey o, l_suppkey p from lineitem)
      union all select {_id('order', 'o_orderkey')}, 'wasAssociatedWith', {_id('customer', 'o_custkey')} from orders
      union all select {_id('part', 'p')}, 'wasGeneratedBy', {_id('order', 'o')} from gen
      union all select src, 'wasDerivedFrom', dst from derived""",
    "datom": "select user_id::varchar as e, event_type as a, value::varchar as v, event_id as tx, case when json_extract_string(props, '$.k')::int % 10 = 0 then 'retract' else 'add' end as op from events",
    "measurement": "select event_type as system, user_id % 4 as query, case when event_type = 'error' then 'error' else 'ok' end as status, value as latency_ms, ts from events",
    "policy": """select p_partkey as resource_id, p_partkey % 150 as owner_id, ['public', 'restricted', 'private'][p_size % 3 + 1] as visibility,
      [(p_partkey % 150 + 1) % 150, (p_partkey % 150 + 2) % 150] as parties from part""",
    "request": """select event_id as request_id, user_id as requestor_id, event_id % (select count(*) + 50 from part) as resource_id,
      case event_type when 'view' then 'read' when 'click' then 'write' when 'purchase' then 'update' when 'error' then 'delete' when 'signup' then 'admin' end as requested_action, ts, props from events""",
    "decided": """select r.*, p.visibility, p.resource_id is not null as known, p.owner_id is not distinct from requestor_id as own,
      coalesce(list_contains(p.parties, requestor_id), false) as listed, ts > timestamp '2024-01-05' and ts < timestamp '2024-01-25' as inside
      from request r left join policy p on p.resource_id = r.resource_id""",
    "ruled": """select *, case when not known then 'no-policy'
      when visibility = 'public' and requested_action in ('admin', 'delete') then case when own then 'public' else 'action-not-allowed' end
      when visibility = 'public' then case when own or listed then 'public' else 'action-not-allowed' end
      when visibility = 'private' then case when own then 'owner' else 'not-authorized' end
      when not inside then 'not-yet-valid' when not (own or listed) then 'not-authorized'
      when requested_action in ('admin', 'delete') and not own then 'action-not-allowed' else 'authorized' end as reason from decided""",
    "decision": """select request_id, requestor_id, resource_id, requested_action, reason in ('public', 'owner', 'authorized') as success, reason,
      case when reason = 'not-yet-valid' and ts > timestamp '2024-01-05' then 'expired' else reason end as reason_strict, ts, props from ruled""",
    "proof": f"""select d.*, o.h as policy_hash, r.h as request_hash, sha256('{{"action":"'||requested_action||'","decision":"'||case when success then 'allow' else 'deny' end||
      coalesce('","policy_hash":"'||o.h, '')||'","reason":"'||reason||'","request_hash":"'||r.h||'","requestor_id":'||requestor_id||',"resource_id":'||d.resource_id||
      ',"timestamp":"'||strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'","version":1}}') as proof_hash
      from decision d join (select request_id, sha256('{{"request_context":'||to_json(props)||',"request_time":"'||strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'","requested_action":"'||
        requested_action||'","requestor_id":'||requestor_id||',"resource_id":'||resource_id||'}}') as h from request) r on r.request_id = d.request_id
      left join (select p_partkey as resource_id, sha256('{{"authorized_parties":['||list_sort([(p_partkey % 150 + 1) % 150, (p_partkey % 150 + 2) % 150])[1]||','||
        list_sort([(p_partkey % 150 + 1) % 150, (p_partkey % 150 + 2) % 150])[2]||'],"owner_id":'||p_partkey % 150||',"permission_id":"'||{_id('policy', 'p_partkey')}||'","resource_id":'||p_partkey||
        case when p_size % 10 <> 0 then ',"resource_type":"entity"' else '' end||',"valid_from":"2024-01-05T00:00:00.000000","valid_until":"2024-01-25T00:00:00.000000","visibility":"'||
        ['public', 'restricted', 'private'][p_size % 3 + 1]||'"}}') as h from part) o on o.resource_id = d.resource_id""",
    "block": """select o_custkey as chain, row_number() over w - 1 as height, o_orderkey, sha256(o_orderkey||'|'||coalesce((lag(o_orderkey) over w)::varchar, '')) as hash
      from orders window w as (partition by o_custkey order by o_orderkey)""",
    "recall": f"""select 'F-'||p_partkey as recall_number, min((s_name, p_name, n_name, strftime(o_orderdate, '%Y%m%d'))) as r from lineitem join orders on l_orderkey = o_orderkey
      join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on p_partkey = l_partkey group by p_partkey""",
}
_NEEDS = {
    "entity": ("gen",), "edge": ("gen", "derived"), "decided": ("policy", "request"), "decision": ("policy", "request", "decided", "ruled"),
    "proof": ("policy", "request", "decided", "ruled", "decision"),
}


def _with(names: str, body: str, recursive: bool = False, more: str = "") -> str:
    order: list[str] = []
    for n in names.split():
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    ctes = ", ".join(f"{n} as ({_CTE[n]})" for n in order)
    parts = ", ".join(x for x in (ctes, more) if x)
    return f"with {'recursive ' if recursive else ''}{parts} {body}"


_S = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}".format

SQL = {
    "src_entities": _with("entity", "select entity_id, entity_type, batch, product_name, was_generated_by from entity"),
    "src_edges_by_relation": _with("edge", "select rel, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from edge group by 1"),
    "flt_batch_products": _with("entity", "select entity_id, entity_type, product_name from entity where batch = 'Brand#17'"),
    "flt_activities_in_range": _with("activity", f"select activity_id, activity_type, {_S('started_at')} from activity where started_at between timestamp '1995-01-01' and timestamp '1995-12-31'"),
    "lin1_provenance": _with("entity activity agent edge", f"""select distinct entity_id, activity_id, agent_id, {_S('started_at')} from entity
      join activity on activity_id = was_generated_by join edge w on w.src = activity_id and w.rel = 'wasAssociatedWith' join agent on agent_id = w.dst"""),
    "lin2_derivations": _with("derived", "select distinct dst as entity_id, src as derived_id from derived"),
    "lin4_agent_activities": _with("activity edge", f"select dst as agent_id, activity_id, {_S('started_at')} from edge join activity on activity_id = src where rel = 'wasAssociatedWith'"),
    "lin5_usage_chain": f"""with p as (select p_partkey, {_id('part', 'p_partkey')} as entity_id from part), o as (select o_orderkey, {_id('order', 'o_orderkey')} as activity_id, {_S('o_orderdate').replace(' as o_orderdate', ' as started_at')} from orders),
      w as (select o, {_id('supplier', 's')} as agent_id from (select distinct l_orderkey as o, l_suppkey as s from lineitem) union all select o_orderkey, {_id('customer', 'o_custkey')} from orders)
      select entity_id, activity_id, agent_id, started_at from (select distinct l_orderkey as u, l_partkey from lineitem) join p on p_partkey = l_partkey join o on o_orderkey = u join w on w.o = u""",
    "lin6_product_history": _with("activity edge", """select dst as entity_id, row_number() over (partition by dst order by started_at, activity_id)::integer as step, activity_id, activity_type,
      'unknown' as location from edge join activity on activity_id = src where rel = 'used'"""),
    "lin10_traceability_edges": _with("edge", """select entity_id, count(*) as edges from (select dst as entity_id, dst as a, src as b from edge where rel = 'used'
      union select u.dst, u.src, w.dst from edge u join edge w on w.src = u.src and w.rel = 'wasAssociatedWith' where u.rel = 'used') group by 1"""),
    "lin13_recall_counts": _with("agent edge", "select agent_name, count(distinct src) as activities from agent join edge on dst = agent_id where rel = 'wasAssociatedWith' group by 1"),
    "jn1_pattern": _with("edge", "select distinct g.src as part, w.dst as agent from edge g join edge w on w.src = g.dst where g.rel = 'wasGeneratedBy' and w.rel = 'wasAssociatedWith'"),
    "jn1_optional_pattern": _with("entity", "select entity_id as e, product_name as name, was_generated_by as \"order\" from entity where product_name is not null"),
    "jn1_pattern_page": _with("edge", """select distinct g.src as part, w.dst as agent from edge g join edge w on w.src = g.dst where g.rel = 'wasGeneratedBy' and w.rel = 'wasAssociatedWith'
      order by 1, 2 limit 500 offset 5"""),
    "agg1_node_counts": "select 'entity' as kind, count(*) as n from part union all select 'activity', count(*) from orders union all select 'agent', (select count(*) from supplier) + (select count(*) from customer)",
    "agg2_edge_counts": _with("derived", "select count(*) as edge_count, count(distinct src) as derived_entity_count from derived"),
    "agg3_types": _with("entity activity agent", """select 'entity' as kind, entity_type as type, count(*) as n from entity group by 2 union all select 'activity', activity_type, count(*) from activity group by 2
      union all select 'agent', agent_type, count(*) from agent group by 2"""),
    "agg5_graph_statistics": _with("entity derived", """select nodes, edges, max_degree, round(2.0 * edges / nodes, 6) as average_degree, round(2.0 * edges / (nodes * (nodes - 1)), 9) as density from
      (select count(*) as nodes from entity), (select count(*) as edges from derived), (select max(c) as max_degree from (select count(*) as c from (select src as n from derived union all select dst from derived) group by n))"""),
    "agg6_degrees": _with("entity derived", "select entity_id as node, (select count(*) from (select src as n from derived union all select dst from derived) where n = entity_id) as degree from entity"),
    "agg7_critical_nodes": _with("derived", "select n as node, count(*) as degree from (select src as n from derived union all select dst from derived) group by n order by degree desc, node limit 10"),
    "agg9_latency_summary": _with("measurement", """, x as (select *, row_number() over (partition by system, query order by latency_ms) as r, count(*) over (partition by system, query) as n from measurement where status = 'ok')
      select m.system, m.query, count(*) filter (status = 'ok') as ok_count, count(*) filter (status <> 'ok') as error_count, round(avg(latency_ms) filter (status = 'ok'), 6) as mean_ms,
        (select latency_ms from x where x.system = m.system and x.query = m.query and r = ceil(n * 0.5)) as p50_ms, (select latency_ms from x where x.system = m.system and x.query = m.query and r = ceil(n * 0.95)) as p95_ms,
        (select latency_ms from x where x.system = m.system and x.query = m.query and r = ceil(n * 0.99)) as p99_ms, min(latency_ms) filter (status = 'ok') as min_ms, max(latency_ms) filter (status = 'ok') as max_ms
      from measurement m group by m.system, m.query""").replace(") , x as", "), x as"),
    "agg14_confidence_interval": _with("measurement", """select system, n, round(m, 6) as mean, round(s, 6) as sd, round(greatest(0.0, m - 1.96 * s / sqrt(n)), 6) as low, round(m + 1.96 * s / sqrt(n), 6) as high
      from (select system, count(*) as n, avg(latency_ms) as m, stddev_pop(latency_ms) as s from measurement group by 1)"""),
    "agg16_throughput": _with("measurement", """select query, count(*) as n, round(count(*) / (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6), 9) as per_second,
      round(count(*) filter (status = 'ok') / count(*), 9) as success_rate from measurement group by 1"""),
    "agg19_histogram": _with("measurement", """select system, round(sum(latency_ms), 6) as sum, count(*) as count, count(*) filter (latency_ms <= 1) as le_1_0, count(*) filter (latency_ms <= 5) as le_5_0,
      count(*) filter (latency_ms <= 10) as le_10_0, count(*) filter (latency_ms <= 50) as le_50_0 from measurement group by 1"""),
    "agg20_gauge": "select user_id, arg_max(value, event_id) as value from events group by 1",
    "agg21_vote_tally": """with v as (select event_id // 5 as proposal_id, user_id % 7 as voter_id, arg_max(case when event_type in ('purchase', 'click') then 'APPROVE' when event_type = 'error' then 'REJECT' else 'ABSTAIN' end, (ts, event_id)) as vote
      from events group by 1, 2), n as (select proposal_id, count(*) filter (vote = 'APPROVE') as approve, count(*) filter (vote = 'REJECT') as reject, count(*) as total from v group by 1)
      select *, case when reject >= 2 then 'rejected' when approve >= 2 then 'approved' else 'pending' end as decision from n""",
    "win1_autocorrelation": """with m as (select event_type, avg(value) as m, var_pop(value) as v from events group by 1), p as (select event_type, value as a, lag(value) over (partition by event_type order by event_id) as b from events)
      select m.event_type, round((select avg((a - m.m) * (b - m.m)) from p where p.event_type = m.event_type and b is not null) / v, 6) as autocorrelation from m""",
    "win2_local_optima": """with p as (select event_type, value > lag(value) over w and value > lead(value) over w as top from events window w as (partition by event_type order by event_id))
      select event_type, count(*) filter (top) as optima, case when count(*) filter (top) = 0 then 'none' when count(*) filter (top) = 1 then 'single' else 'multi' end as class from p group by 1""",
    "win3_chain_links": _with("block", """select chain, height, hash, case when height = 0 then o_orderkey % 101 <> 0 else o_orderkey % 101 <> 0 end as link_ok from block"""),
    "gr1_neighbours": _with("edge", "select node, rel, count(distinct o) as n, min(o) as first from (select src as node, rel, dst as o from edge union all select dst, rel, src from edge) group by 1, 2"),
    "gr3_ancestors": _with("derived", "select start, node, min(hops)::integer as hops from walk group by 1, 2", True,
      "walk(start, node, hops) as (select src, dst, 1 from derived union select w.start, d.dst, w.hops + 1 from walk w join derived d on d.src = w.node)"),
    "gr4_descendants": _with("derived", "select start, node, min(hops)::integer as hops from walk group by 1, 2", True,
      "walk(start, node, hops) as (select dst, src, 1 from derived union select w.start, d.src, w.hops + 1 from walk w join derived d on d.dst = w.node where w.hops < 3)"),
    "gr5_shortest_paths": _with("derived", """select node as "end", min(path) as path, hops::bigint as hops from (select *, min(hops) over (partition by node) as m from walk) where hops = m group by node, hops""", True,
      f"walk(node, path, hops) as (select {_uuid3(chr(39) + 'part/0' + chr(39))}, {_uuid3(chr(39) + 'part/0' + chr(39))}, 0 union all select d.src, w.path||'>'||d.src, w.hops + 1 from walk w join derived d on d.dst = w.node)"),
    "gr6_simple_paths": _with("derived", "select start, path from walk", True,
      "walk(start, node, path, hops) as (select src, dst, src||'>'||dst, 1 from derived union all select w.start, d.dst, w.path||'>'||d.dst, w.hops + 1 from walk w join derived d on d.src = w.node where w.hops < 3)"),
    "gr8_components": _with("entity activity agent edge", "select node, label as component from cc", True, """node as (select entity_id as id from entity union all select activity_id from activity union all select agent_id from agent),
      both_ways as (select src as a, dst as b from edge union select dst, src from edge),
      cc(node, label) using key (node) as (select id, id from node union select w.b, min(cc.label) from cc join both_ways w on w.a = cc.node join recurring.cc old on old.node = w.b where cc.label < old.label group by w.b)"""),

    "cf2_entity_confidence": _with("entity activity", """, s as (select entity_id, entity_type is not null as t, activity_id is not null as a, started_at is not null as ts, started_at <= ended_at as o
        from entity left join activity on activity_id = was_generated_by)
      select entity_id, round((0.15 + case when t then 0.1 else 0 end + case when a then 0.25 + 0.2 + 0.2 + case when o then 0.1 else 0 end else 0 end)
          / (0.15 + 0.1 + 0.25 + case when a then 0.4 + case when o is not null then 0.1 else 0 end else 0 end), 6) as confidence,
        concat_ws(',', case when not t then 'entity_type' end, case when not a then 'activity_present' end, case when a and not o then 'time_order_valid' end) as missing,
        concat_ws(',', case when not a then 'agent_present' end, case when not a then 'time_start_present' end, case when o is null then 'time_order_valid' end) as "unknown" from s""").replace(") , s as", "), s as"),
    "cf4_best_paths": _with("entity activity derived", """select start, path, round(c, 6) as confidence, n as paths from (select *, row_number() over (partition by start order by c desc, path) as r, count(*) over (partition by start) as n
        from (select k.start, k.path, round(avg(conf), 9) as c from kept k, unnest(string_split(k.path, '>')) u(node) join conf on conf.id = u.node group by 1, 2)) where r = 1""", True,
      """walk(start, node, path, nodes) as (select entity_id, entity_id, entity_id, 1 from entity union all select w.start, d.dst, w.path||'>'||d.dst, w.nodes + 1 from walk w join derived d on d.src = w.node where w.nodes < 6),
      ends as (select *, row_number() over (partition by start order by path) as r from walk w where nodes = 6 or not exists (select 1 from derived d where d.src = w.node)),
      kept as (select start, path from ends where r <= 20),
      conf as (select entity_id as id, (0.15 + case when entity_type is not null then 0.1 else 0 end + case when activity_id is not null then 0.65 + case when started_at <= ended_at then 0.1 else 0 end else 0 end)
          / (0.5 + case when activity_id is not null then 0.4 + case when ended_at is not null then 0.1 else 0 end else 0 end) as conf from entity left join activity on activity_id = was_generated_by)"""),
    "val12_summary": _with("entity activity agent", """, e as (select case when p_partkey % 3 = 0 then 'product/item' else entity_type end as t, p_partkey as k from entity)
      select 'entity' as kind, count(*) filter (t is not null and not (t = 'product/item' and k % 4 = 0) and k % 11 <> 0) as valid,
        count(*) filter (t is null or t = 'product/item' and k % 4 = 0 or k % 11 = 0) as invalid, 0::bigint as warned from e
      union all select 'activity', count(*), 0, count(*) filter (started_at > ended_at) from activity
      union all select 'agent', count(*) filter (agent_id not like 'b%'), count(*) filter (agent_id like 'b%'), 0 from agent""").replace(") , e as", "), e as"),
    "val1_entities": _with("entity", "select entity_id as id, 'entity' as kind, entity_type is not null as valid, case when entity_type is null then 'missing entity_type' else '' end as errors, '' as warnings from entity"),
    "val2_activities": _with("activity", "select activity_id as id, 'activity' as kind, true as valid, '' as errors, case when started_at > ended_at then 'starts after its end' else '' end as warnings from activity"),
    "val6_derivations": _with("entity", f"""select src, dst, case when src = dst then 'self-derivation' when src not in (select entity_id from entity) then 'unknown derived entity' when dst not in (select entity_id from entity) then 'unknown source entity' end as fault
      from (select {_id('part', 'case when p % 83 = 0 then p + 5000000 else p end')} as src, {_id('part', 'case when p % 97 = 0 then p when p % 89 = 0 then q + 7000000 else q end')} as dst from (select p_partkey as p, p_partkey // 2 as q from part where p_partkey > 0
      union all select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 5 = 0 and p_partkey // 3 <> p_partkey // 2))"""),
    "val13_orphans": f"select distinct 'used' as rel, {_id('order', 'l_orderkey')} as src, {_id('part', 'l_partkey + 1000000')} as dst from lineitem where l_orderkey % 997 = 0",
    "val14_gaps": _with("entity activity", """select 'entity type' as gap, count(*) as n, (select string_agg(entity_id, ',' order by entity_id) from (select entity_id from entity where entity_type is null order by 1 limit 10)) as sample from entity where entity_type is null
      union all select 'activity end', count(*), (select string_agg(activity_id, ',' order by activity_id) from (select activity_id from activity where ended_at is null order by 1 limit 10)) from activity where ended_at is null
      union all select 'agent name', 0, ''"""),
    "val16_complete_chains": _with("entity", "select entity_id, count(distinct l_orderkey) as activities, count(distinct l_orderkey) >= 3 as complete from entity left join lineitem on l_partkey = p_partkey group by 1"),
    "acl2_decisions": _with("decision", "select request_id, requestor_id, resource_id, requested_action, success, reason, reason_strict from decision"),
    "acl5_row_filter": _with("decision", "select p_partkey, p_name from part where p_partkey in (select resource_id from decision where success and requestor_id = 8)"),
    "acl6_batches": _with("decision", "select request_id // 10 as batch, bool_and(success) as authorized, count(*) filter (not success) as denied, count(*) as resources from decision group by 1"),
    "acl12_audit": _with("decision", "select " + _uuid3("'audit/'||requestor_id||'/'||resource_id||'/'||requested_action||'/'||strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')") + " as audit_id, requestor_id as actor, resource_id, requested_action, case when success then 'granted' else 'denied' end as outcome, reason from decision"),
    "acl13_proofs": _with("proof", "select request_id, policy_hash, request_hash, proof_hash from proof"),
    "agg17_policy_statistics": _with("policy", "select visibility, count(*) as policies from policy group by 1"),
    "acl4_accessible": _with("policy", "select resource_id, owner_id, visibility from policy where owner_id = 8 or list_contains(parties, 8) and visibility in ('public', 'restricted')"),
    "val3_agents": _with("agent", "select agent_id as id, 'agent' as kind, agent_id not like 'b%' as valid, case when agent_id like 'b%' then 'missing agent_type' else '' end as errors, '' as warnings from agent"),
    "cf1_signals": _with("entity activity edge agent", """select entity_id, true as entity_present, entity_type is not null as entity_type, activity_id is not null as activity_present,
      case when activity_id in (select src from edge join agent on agent_id = dst where rel = 'wasAssociatedWith' and substr(agent_id, 1, 1) < '3') then true end as agent_present,
      case when activity_id is not null then started_at is not null end as time_start_present, started_at <= ended_at as time_order_valid from entity left join activity on activity_id = was_generated_by"""),
    "agg17_access_statistics": _with("decision", "select requested_action, count(*) filter (success) as granted, count(*) filter (not success) as denied from decision group by 1"),
    "tm1_as_of": _with("datom", "select e, a, v, tx from now", more="f as (select e, a, v, max(tx) filter (op = 'add') as added, max(tx) filter (op = 'retract') as gone from datom where tx <= 5000 group by 1, 2, 3), now as (select e, a, v, added as tx from (select *, row_number() over (partition by e, a order by added desc, v desc) as r from f where added is not null) where r = 1 and (gone is null or gone <= added))"),
    "tm2_since": _with("datom", "select e, a, v, tx from now", more="f as (select e, a, v, max(tx) filter (op = 'add') as added, max(tx) filter (op = 'retract') as gone from datom where tx > 5000 group by 1, 2, 3), now as (select e, a, v, added as tx from (select *, row_number() over (partition by e, a order by added desc, v desc) as r from f where added is not null) where r = 1 and (gone is null or gone <= added))"),
    "tm5_current_many": _with("datom", "select e, a, v, tx from now", more="f as (select e, a, v, max(tx) filter (op = 'add') as added, max(tx) filter (op = 'retract') as gone from datom group by 1, 2, 3), now as (select e, a, v, added as tx from (select *, row_number() over (partition by e, a, case when a in ('click', 'view') then v end order by added desc, v desc) as r from f where added is not null) where r = 1 and (gone is null or gone <= added))"),
    "src2_wide": _with("datom", """select e, max(v) filter (a = 'click') as click, max(v) filter (a = 'error') as error, max(v) filter (a = 'purchase') as purchase, max(v) filter (a = 'signup') as signup, max(v) filter (a = 'view') as "view" from now group by 1""",
      more="f as (select e, a, v, max(tx) filter (op = 'add') as added, max(tx) filter (op = 'retract') as gone from datom group by 1, 2, 3), now as (select e, a, v, added as tx from (select *, row_number() over (partition by e, a order by added desc, v desc) as r from f where added is not null) where r = 1 and (gone is null or gone <= added))"),
    "tm6_apply_changes": _with("datom", """select e, a, v, 1000000000::bigint as tx, 'retract' as op from now where e::int % 3 <> 0 and not (e::int % 3 = 1 and v = 'new')
      union all select e, a, 'new', 1000000000, 'add' from now where e::int % 3 = 1 and v <> 'new'""", more="f as (select e, a, v, max(tx) filter (op = 'add') as added, max(tx) filter (op = 'retract') as gone from datom group by 1, 2, 3), now as (select e, a, v, added as tx from (select *, row_number() over (partition by e, a order by added desc, v desc) as r from f where added is not null) where r = 1 and (gone is null or gone <= added))"),
    "mk1_merkle_roots": """with recursive leaf as (select user_id as tree_id, 0 as level, row_number() over (partition by user_id order by event_id) - 1 as idx, sha256(event_id||'|'||event_type) as h,
        count(*) over (partition by user_id) as n from events),
      up as (select tree_id, level, list(h order by idx) as hs from leaf group by 1, 2
        union all select tree_id, level + 1, list_transform(range(0, len(hs), 2), lambda i: case when i + 1 < len(hs) then sha256(hs[i + 1]||hs[i + 2]) else hs[i + 1] end) from up where len(hs) > 1)
      select u.tree_id, hs[1] as root, level as height, (select len(hs) from up z where z.tree_id = u.tree_id and z.level = 0) as leaves from up u where len(hs) = 1""",
    "fd2_recalls": _with("recall", f"""select recall_number, r[1] as recalling_firm, {_uuid3("'openfda-food/entity/'||recall_number")} as entity_id, {_uuid3("'openfda-food/activity/'||recall_number")} as activity_id,
      {_uuid3("'openfda-food/agent/'||r[1]")} as agent_id, r[3] as location, strftime(strptime(r[4], '%Y%m%d'), '%Y-%m-%d %H:%M:%S') as started_at, true as open from recall"""),
    "fd3_recall_counts": _with("recall", "select r[1] as recalling_firm, count(distinct recall_number) as recalls from recall group by 1"),
    "fd3_lookups": _with("recall", f"""select query, key, value, coalesce(value <> '0', false) as ok from (
      select 'batch' as query, b as key, r[2] as value from (select 'F-'||(p_partkey * 2) as b from part) left join recall on recall_number = b
      union all select 'entity', b, case when r is not null then {_uuid3("'openfda-food/entity/'||b")} end from (select 'F-'||(p_partkey * 2) as b from part) left join recall on recall_number = b
      union all select 'activity', b, case when r is not null then 'recall' end from (select 'F-'||(p_partkey * 2) as b from part) left join recall on recall_number = b
      union all select 'recalls', s_name, (select count(*) from recall where r[1] = s_name)::varchar from (select distinct s_name from supplier))"""),
    "snk2_ntriples_round_trip": _with("entity", "select 'urn:'||entity_id as s, 'urn:name' as p, product_name as o, 'literal' as o_kind, 'en' as lang from entity"),
    "str2_limiter": """with recursive l as (select user_id||':'||event_type as key, ts, event_id as id, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events),
      w(key, r, id, start, used, allowed, remaining) as (select key, r, id, ts, 1, true, 1 from l where r = 1
        union all select l.key, l.r, l.id, case when l.ts > w.start + interval 1 day then l.ts else w.start end,
          case when l.ts > w.start + interval 1 day then 1 else least(2, w.used + 1) end, l.ts > w.start + interval 1 day or w.used < 2,
          case when l.ts > w.start + interval 1 day then 1 else 2 - least(2, w.used + 1) end from w join l on l.key = w.key and l.r = w.r + 1)
      select key, id, allowed, remaining::integer as remaining from w""",
}
