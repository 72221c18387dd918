"""Registered queries of graph views, link checks, transfers, rules and run summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.functions.ids import uuid3
from tracework.operators import access, bridge, graph, ledger, lineage, quality, stats, views
from tracework.operators.components import hub_join
from tracework.oracles import _id, _uuid3, _with
from tracework.plans import model
from tracework.plans.materialize import materialize

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _node(kind: str, key):
    return uuid3(F.concat(F.lit(f"{kind}/"), key.cast("string")))



_WALK = "walk(start, node, hops) as (select src, dst, 1 from derived union select w.start, d.dst, w.hops + 1 from walk w join derived d on d.src = w.node), up as (select start, node, min(hops) as hops from walk group by 1, 2)"
_RUNS = """x as (select *, row_number() over (partition by system, query, run order by latency_ms) as r, count(*) over (partition by system, query, run) as n from
      (select event_type as system, user_id % 4 as query, event_id % 5 as run, value as latency_ms from events where event_type <> 'error')),
    s as (select system, query, run, count(*) as ok_count, round(avg(latency_ms), 6) as mean_ms, max(latency_ms) filter (r = ceil(n * 0.5)) as p50_ms, max(latency_ms) filter (r = ceil(n * 0.95)) as p95_ms,
      max(latency_ms) filter (r = ceil(n * 0.99)) as p99_ms, min(latency_ms) as min_ms, max(latency_ms) as max_ms from x group by 1, 2, 3)"""


def _runs(spark, d):
    runs = model.measurements(spark, d).where("status = 'ok'").withColumn("run", F.col("iteration") % 5)
    return stats.latency_summary(runs, "system", "query", "run")


# Views of the graph


@_query(_with("derived entity", "select root, (select count(*) from n x where x.root = r.root) as nodes, (select count(*) from e x where x.root = r.root) as edges from (select distinct root from n) r",
  more="""n as (select entity_id as root, entity_id as node from entity union select src, dst from derived where src in (select entity_id from entity)
    union select dst, src from derived where dst in (select entity_id from entity)),
  e as (select a.root, d.src, d.dst from derived d join n a on a.node = d.src join n b on b.node = d.dst and b.root = a.root)"""))  # fmt: skip
def gr10_subgraphs(spark, d):
    nodes, edges = views.subgraphs(model.derivations(spark, d), model.entities(spark, d).select("entity_id"))
    e = edges.groupBy("root").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.groupBy("root").agg(F.count(F.lit(1)).alias("nodes")).join(e, "root", "left").select("root", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@_query(_with("derived entity", """select start, row_number() over (partition by start order by hops desc, node)::integer as step, node from
  (select start, node, hops from up where start in (select entity_id from entity) union all select entity_id, entity_id, 0 from entity)""", True, _WALK))  # fmt: skip
def gr7_supply_chains(spark, d):
    rows = views.supply_chains(model.key_derivations(spark, d), model.keyed(spark, d)["entities"], lambda c: _node("part", F.col(c)))
    return model.named(rows.drop("hops"), {"start": "part", "node": "part"})


@_query(_with("derived entity activity", f"""select start, row_number() over (partition by start order by t, node)::integer as position, node, strftime(t, '%Y-%m-%d %H:%M:%S') as started_at from
  (select p.start, p.node, a.started_at as t from (select start, node from up union select node, start from up) p join entity s on s.entity_id = p.start
    join entity e on e.entity_id = p.node join activity a on a.activity_id = e.was_generated_by)""", True, _WALK))  # fmt: skip
def gr15_timelines(spark, d):
    m, made = model.keyed(spark, d), model.generation(spark, d).toDF("entity_id", "was_generated_by")
    r = views.timelines(model.key_derivations(spark, d), m["entities"].join(made, "entity_id", "left"), m["activities"], lambda c: _node("part", F.col(c)))
    return model.named(r, {"start": "part", "node": "part"}).select("start", "position", "node", _stamp("started_at"))


@_query(_with("derived entity", """select count(hops) as reachable_pairs, round(coalesce(avg(hops + 1), 0), 6) as average_path_length, coalesce(max(hops + 1), 0)::integer as diameter, (select count(*) from few) as sample_size
  from few a join few b on a.i <> b.i and b.i <= case when a.i <= 50 then 51 else 50 end join up on up.start = b.node and up.node = a.node""", True,
  _WALK + ", few as (select entity_id as node, row_number() over (order by entity_id) as i from entity order by 1 limit 100)"))
def gr9_path_lengths(spark, d):
    return views.path_lengths(model.derivations(spark, d), model.entities(spark, d).select("entity_id"))


def _typed(spark, d):
    return (
        model.entities(spark, d).select(F.col("entity_id").alias("id"), F.coalesce("entity_type", "batch", "product_name").alias("label"), F.lit("entity").alias("type"))
        .unionByName(model.activities(spark, d).select(F.col("activity_id").alias("id"), F.col("activity_type").alias("label"), F.lit("activity").alias("type")))
        .unionByName(model.agents(spark, d).select(F.col("agent_id").alias("id"), F.col("agent_type").alias("label"), F.lit("agent").alias("type")))
    )


_TYPED = """node as (select entity_id as id, coalesce(entity_type, batch, product_name) as label, 'entity' as type from entity
  union all select activity_id, activity_type, 'activity' from activity union all select agent_id, agent_type, 'agent' from agent)"""


@_query(_with("entity activity agent edge", """select 'nodes' as measure, '' as name, count(*)::double as value from node union all select 'edges', '', count(*) from edge
  union all select 'average degree', '', round(2.0 * (select count(*) from edge) / (select count(*) from node), 6)
  union all select 'greatest degree', '', max(c) from (select count(*) as c from (select src as n from edge union all select dst from edge) group by n)
  union all select 'node type', type, count(*) from node group by type union all select 'relation', rel, count(*) from edge group by rel""", more=_TYPED))  # fmt: skip
def agg4_kg_statistics(spark, d):
    return views.kg_statistics(_typed(spark, d), model.edges(spark, d))


#: Components by least labels, in DuckDB's keyed recursion.
_COMPONENTS = """both_ways as (select src as a, dst as b from edge union select dst, src from edge),
  cc(node, label) using key (node) as (select id, id from node union select w.b, min(cc.label) from cc join both_ways w on w.a = cc.node join recurring.cc old on old.node = w.b where cc.label < old.label group by w.b)"""


@_query(_with("entity activity agent edge", """select (select count(*) from node) as nodes, (select count(distinct label) from cc) as components, (select count(*) from edge) as edges, (select count(distinct label) from cc) <= 1 as connected""", True, _TYPED + ", " + _COMPONENTS))
def agg8_analysis(spark, d):
    return views.analysis(*model.tagged(spark, d))


def named_components(nodes, edges):
    """``node, component`` by identifiers: components are found by numbers, and named after the least identifier in each."""
    found = materialize(graph.components(nodes, edges).withColumn("name", model.tag_name("node")))
    least = materialize(found.groupBy("component").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("rows")))
    return hub_join(found, least, "component").select(F.col("name").alias("node"), F.col("least").alias("component"))


_MANY = _COMPONENTS.replace("from edge union", "from part_of union").replace("from edge)", "from part_of)")


@_query(_with("entity activity agent edge derived", "select node, label as component from cc", True,
  _TYPED + ", part_of as (select distinct d.src, d.dst from derived d where substr(d.src, 1, 1) not in ('0', '1', '2')), " + _MANY))
def gr8_many_components(spark, d):
    """Components of all nodes where some derivations are the only edges: most nodes are alone, and there are many small trees."""
    nodes, edges = model.tagged(spark, d)
    kept = F.substring(model.tag_name("src"), 1, 1).isin("0", "1", "2")
    return named_components(nodes, edges.where((F.col("rel") == "wasDerivedFrom") & ~kept))


@_query(_with("entity activity agent edge", """select count(hops) as reachable_pairs, round(coalesce(avg(hops + 1), 0), 6) as average_path_length, coalesce(max(hops + 1), 0)::integer as diameter, (select count(*) from few) as sample_size
  from few a join few b on a.i <> b.i and b.i <= case when a.i <= 50 then 51 else 50 end join w on w.start = a.node and w.node = b.node and hops > 0""", True,
  _TYPED + """, few as (select id as node, row_number() over (order by id) as i from node order by 1 limit 100),
  w(start, node, hops) using key (start, node) as (select node, node, 0 from few union select w.start, e.src, min(w.hops + 1) from w join edge e on e.dst = w.node
    left join recurring.w old on old.start = w.start and old.node = e.src where old.node is null group by 1, 2)"""))  # fmt: skip
def gr9_path_lengths_all(spark, d):
    """Distances among the first hundred nodes of all classes, over all relations, by numbers."""
    nodes, edges = model.tagged(spark, d, once=False)
    return views.path_lengths(edges, nodes, name=model.tag_name)


@_query(_with("entity activity agent edge", """select label as component, count(*) as size from cc group by 1""", True, _TYPED + ", " + _COMPONENTS))
def gr8_component_sizes(spark, d):
    return named_components(*model.tagged(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@_query(_with("entity activity agent edge", """select '{"id":"'||id||'","label":"'||label||'","type":"'||type||'"}' as value from node
  union all select '{"id":"'||src||'-'||dst||'-'||rel||'","source":"'||src||'","target":"'||dst||'","label":"'||rel||'"}' from edge""", more=_TYPED))  # fmt: skip
def snk5_elements(spark, d):
    return views.elements(_typed(spark, d), model.edges(spark, d))


@_query(_with("entity activity agent edge", """select 0 as part, 'digraph G {' as value union all select 3, '}' union all select 1, '  "'||id||'" [label="'||label||'"];' from node
  union all select 2, '  "'||src||'" -> "'||dst||'" [label="'||rel||'"];' from edge""", more=_TYPED))  # fmt: skip
def snk6_dot(spark, d):
    return views.dot(_typed(spark, d), model.edges(spark, d))


# Checks


@_query(f"""select distinct {_id('part', 'p')} as src, {_id('order', 'o')} as dst, case when p not in (select p_partkey from part) then 'entity not found' when o not in (select o_orderkey from orders) then 'activity not found' end as fault from
  (select l_partkey + case when l_suppkey % 10 = 0 then 100000000 else 0 end as p, l_orderkey + case when l_linenumber = 3 then 100000000 else 0 end as o from lineitem)""")
def val4_entity_activity_links(spark, d):
    lost = lambda c, key: F.col(key) + F.when(c, 100_000_000).otherwise(0)
    lines = model.table(spark, d, "lineitem")
    links = lines.select(
        _node("part", lost(F.col("l_suppkey") % 10 == 0, "l_partkey")).alias("src"), _node("order", lost(F.col("l_linenumber") == 3, "l_orderkey")).alias("dst")
    ).distinct()
    nodes = _typed(spark, d).select("id", F.col("type").alias("kind"))
    return quality.check_links(links, nodes, nodes)


@_query(_with("edge agent", """select distinct src, d as dst, case when d = src then 'not of kind agent' when agent_id is null then 'agent not found' end as fault from
  (select src, case when substr(dst, 1, 1) = 'a' then src when substr(dst, 1, 1) = 'b' then 'x'||dst else dst end as d from edge where rel = 'wasAssociatedWith') left join agent on agent_id = d"""))
def val5_activity_agent_links(spark, d):
    head = F.substring("dst", 1, 1)
    links = model.edges(spark, d).where("rel = 'wasAssociatedWith'").select(
        "src", F.when(head == "a", F.col("src")).when(head == "b", F.concat(F.lit("x"), "dst")).otherwise(F.col("dst")).alias("dst")
    ).distinct()
    nodes = _typed(spark, d).select("id", F.col("type").alias("kind"))
    return quality.check_links(links, nodes, nodes, "activity", "agent")


@_query(_with("entity derived", """select entity_id as id, errors = '' as valid, errors from (select entity_id, concat_ws('; ', case when t is null then 'missing entity_type' end,
    case when t = 'product/item' and p_partkey % 4 = 0 then 'missing product_name' end, case when p_partkey % 11 = 0 then 'empty batch' end,
    case when g is not null and p_partkey % 13 = 0 then 'activity not found' end,
    (select string_agg('unknown source entity', '; ') from derived where src = entity_id and dst not in (select entity_id from entity))) as errors
  from (select *, case when p_partkey % 3 = 0 then 'product/item' else entity_type end as t, was_generated_by as g from entity))"""))
def val11_entity_results(spark, d):
    return quality.entity_results(odd_entities(spark, d), model.activities(spark, d), model.edges(spark, d))


def odd_entities(spark, d):
    """The entities, some without a name, a batch or an activity that exists."""
    key = F.col("p_partkey")
    return model.entities(spark, d).withColumns({
        "entity_type": F.when(key % 3 == 0, "product/item").otherwise(F.col("entity_type")),
        "product_name": F.when(key % 4 != 0, F.col("product_name")),
        "batch": F.when(key % 11 == 0, "").otherwise(F.col("batch")),
        "was_generated_by": F.when(key % 13 == 0, F.concat(F.lit("x"), "was_generated_by")).otherwise(F.col("was_generated_by")),
    })


#: Simple cycles of a table ``d`` (src, dst), each from its smallest node on.
_CYCLES = """cyc(start, node, path) as (select src, dst, [src] from d where dst >= src
    union all select c.start, d.dst, list_append(c.path, c.node) from cyc c join d on d.src = c.node where c.node <> c.start and d.dst >= c.start and not list_contains(c.path[2:], d.dst) and d.dst <> c.node)"""
_TANGLED = f"d as (select src, dst from derived union select {_id('part', '1')}, {_id('part', '3')} union select {_id('part', '2')}, {_id('part', '2')})"


def _tangled(spark, d):
    """The derivations with two more that close cycles."""
    extra = spark.createDataFrame([(1, 3), (2, 2)], "s long, t long")
    return model.derivations(spark, d).unionByName(extra.select(_node("part", F.col("s")).alias("src"), _node("part", F.col("t")).alias("dst")))


@_query(_with("derived", "select array_to_string(path, '>') as cycle from cyc where node = start", True, f"{_TANGLED}, {_CYCLES}"))
def gr17_cycles(spark, d):
    return graph.cycles(_tangled(spark, d)).select(F.array_join("cycle", ">").alias("cycle"))


@_query(_with("derived entity activity", """select o as orphans, c as cycles, g::bigint as gaps, o = 0 as valid from (select count(*) as o from d where dst not in (select entity_id from entity)), (select count(*) as c from cyc where node = start),
  (select (select count(*) from entity where entity_type is null) + (select count(*) from activity where ended_at is null) as g)""", True, f"{_TANGLED}, {_CYCLES}"))  # fmt: skip
def val15_consistency(spark, d):
    e, a, g = model.entities(spark, d), model.activities(spark, d), model.agents(spark, d)
    tangled = _tangled(spark, d)
    edges = model.edges(spark, d).where("rel != 'wasDerivedFrom'").unionByName(tangled.select("src", F.lit("wasDerivedFrom").alias("rel"), "dst"))
    return quality.consistency(quality.orphans(e, a, g, edges), graph.cycles(tangled), quality.gaps(e, a, g))


@_query(_with("request", """select request_id, concat_ws('; ', case when request_id % 19 = 0 then 'missing requestor_id' end, case when request_id % 23 = 0 then 'unknown action' end) as faults from request"""))
def val25_request_faults(spark, d):
    r = model.requests(spark, d)
    return access.request_faults(r.withColumns({
        "requestor_id": F.when(F.col("request_id") % 19 != 0, F.col("requestor_id")),
        "requested_action": F.when(F.col("request_id") % 23 == 0, "own").otherwise(F.col("requested_action")),
    }))


# Access


@_query(_with("request", """select request_id, requested_action = 'read' and requestor_id % 3 = 1 and coalesce(requestor_id % 7 >= 3 and requestor_id % 5 <> 0, false) as success,
  case when requested_action = 'read' and requestor_id % 3 = 1 and requestor_id % 7 >= 3 and requestor_id % 5 <> 0 then 'attribute-authorized' else 'attribute-not-authorized' end as reason from request"""))
def acl8_attributes(spark, d):
    who = F.col("requestor_id")
    r = model.requests(spark, d).withColumns({"department": F.concat(F.lit("d"), (who % 3).cast("string")), "level": F.when(who % 5 != 0, who % 7)})
    return access.by_attributes(r, {"action": "read", "department": "d1", "level": 3, "shift": "any"}).select("request_id", "success", "reason")


@_query("""select resource_id, owner_id, visibility from (select event_id % 200 as resource_id, arg_max(user_id, event_id) as owner_id, arg_max(case when event_type = 'view' then 'public' else 'private' end, event_id) as visibility,
  arg_max(event_type, event_id) as t from events group by 1) where t <> 'error'""")
def acl11_current_policies(spark, d):
    kind = F.col("event_type")
    log = model.table(spark, d, "events").select(
        (F.col("event_id") % 200).alias("resource_id"), "event_id", F.col("user_id").alias("owner_id"), F.when(kind == "view", "public").otherwise("private").alias("visibility"),
        F.when(kind == "error", "remove").otherwise("put").alias("op"),
    )
    return access.current_policies(log, "event_id").select("resource_id", "owner_id", "visibility")


@_query(_with("proof", "select request_id, request_id % 17 <> 0 as valid from proof"))
def acl14_verified_proofs(spark, d):
    policies = model.policies(spark, d)
    decisions = materialize(access.decide(model.requests(spark, d), policies))
    changed = F.when(F.col("request_id") % 17 == 0, F.lit("0" * 64)).otherwise(F.col("proof_hash"))
    return access.verify_proof(access.proof(decisions, policies).withColumn("proof_hash", changed), decisions, policies)


# Transfers


def _payloads(spark, d):
    e, a, g = model.entities(spark, d), model.activities(spark, d), model.agents(spark, d)
    return bridge.payloads(lineage.provenance(e, a, g, model.edges(spark, d)), e, a, g)


@_query(_with("entity activity agent edge", """, f as (select entity_id, min((activity_id, agent_id)) as r from entity join activity on activity_id = was_generated_by
    join edge w on w.src = activity_id and w.rel = 'wasAssociatedWith' join agent on agent_id = w.dst group by 1)
  select entity_id, activity_id, agent_id, sha256('{"activity":{"activity_id":"'||activity_id||'","activity_type":"'||activity_type||'","started_at":"'||strftime(started_at, '%Y-%m-%d %H:%M:%S')||
    '"},"agent":{"agent_id":"'||agent_id||'","agent_name":"'||agent_name||'","agent_type":"'||agent_type||'"},"entity":{"batch":"'||batch||'","entity_id":"'||entity_id||'"'||
    coalesce(',"entity_type":"'||entity_type||'"', '')||',"product_name":"'||product_name||'"},"relationships":{"used":"'||entity_id||'","was_associated_with":"'||agent_id||'","was_generated_by":"'||activity_id||'"}}') as tx_hash
  from f join entity using (entity_id) join activity on activity_id = r[1] join agent on agent_id = r[2]""").replace(") , f as", "), f as"))  # fmt: skip
def br1_payloads(spark, d):
    return _payloads(spark, d).select("entity_id", "activity_id", "agent_id", "tx_hash")


def _transfers(spark, d):
    e = model.entities(spark, d)
    p = _payloads(spark, d).join(e.select("entity_id", "p_partkey"), "entity_id")
    k = F.col("p_partkey")
    return p.withColumns({
        "transfer_id": k,
        "used": F.when(k % 11 != 0, F.col("used")),
        "tx_hash": F.when(k % 13 == 0, "bad").otherwise(F.col("tx_hash")),
        "batch": F.when(k % 17 == 0, "changed").otherwise(F.col("batch")),
        "merkle_root": F.when(k % 5 != 0, F.col("merkle_root")),
        "merkle_proof": F.when(k % 5 != 0, F.col("merkle_proof")),
        "signatures": F.slice(F.array(*map(F.lit, "abc")), 1, (k % 4).cast("int")),
    })


_DECIDED = """t as (select distinct p_partkey as k from entity join edge on rel = 'wasAssociatedWith' and src = was_generated_by),
  c as (select k as transfer_id, case when k % 11 = 0 then 'invalid payload' when (k % 13 = 0 or k % 17 = 0) and k % 5 <> 0 then 'invalid proof' end as reason, k % 4 as signed from t),
  w as (select transfer_id, reason, case when reason is not null then 'failed' when signed < 2 then 'pending' else 'executed' end as status, signed from c)"""


@_query(_with("entity edge", "select transfer_id, status, reason, case when status = 'pending' then (2 - signed)::integer end as needed from w", more=_DECIDED))
def br2_decisions(spark, d):
    return bridge.decide(_transfers(spark, d), 2).select("transfer_id", "status", "reason", "needed")


@_query(_with("entity edge", f"""select transfer_id, 'orders' as source_chain, {_uuid3("'bridge/orders/'||transfer_id")} as entity_id, entity_type, case when transfer_id % 17 = 0 then 'changed' else batch end as batch
  from w join entity on p_partkey = transfer_id where status = 'executed' and transfer_id % 6 <> 0""", more=_DECIDED))
def br3_target_rows(spark, d):
    decided = materialize(bridge.decide(_transfers(spark, d), 2))
    return bridge.target_rows(decided, decided.where("transfer_id % 6 = 0"), "orders")


@_query(_with("entity edge", "select status, count(*) as n, coalesce(sum(case when status = 'pending' then 2 - signed end), 0)::bigint as signatures_needed from w group by 1", more=_DECIDED))
def br4_summary(spark, d):
    return bridge.summary(bridge.decide(_transfers(spark, d), 2))


#: Levels of the trees of users' events, and each leaf folded with its siblings up to the root.
_FOLDED = """leaf as (select user_id as tree_id, row_number() over (partition by user_id order by event_id) - 1 as idx, sha256(event_id||'|'||event_type) as h from events),
  up as (select tree_id, 0 as level, list(h order by idx) as hs from leaf group by 1
    union all select tree_id, level + 1, list_transform(range(0, len(hs), 2), lambda i: case when i + 1 < len(hs) then sha256(hs[i + 1]||hs[i + 2]) else hs[i + 1] end) from up where len(hs) > 1),
  fold(tree_id, idx, leaf, level, h, steps) as (select tree_id, idx, h, 0, h, 0 from leaf
    union all select f.tree_id, f.idx, f.leaf, f.level + 1, case when xor(f.idx >> f.level, 1) >= len(u.hs) then f.h when (f.idx >> f.level) % 2 = 0 then sha256(f.h||u.hs[xor(f.idx >> f.level, 1) + 1]) else sha256(u.hs[xor(f.idx >> f.level, 1) + 1]||f.h) end,
      f.steps + case when xor(f.idx >> f.level, 1) >= len(u.hs) then 0 else 1 end from fold f join up u on u.tree_id = f.tree_id and u.level = f.level where len(u.hs) > 1),
  done as (select f.*, f.h = u.hs[1] as ok from fold f join up u on u.tree_id = f.tree_id and u.level = f.level where len(u.hs) = 1)"""
_MK3 = f"with recursive {_FOLDED} select tree_id, idx, leaf, (32 * steps)::bigint as proof_bytes, ok from done"


@_query(f"with recursive {_FOLDED} select tree_id, count(*) as proofs, bool_and(ok) as ok from done group by 1")
def mk4_batches(spark, d):
    leaves = model.table(spark, d, "events").select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("text"))
    levels = ledger.merkle_levels(leaves, "user_id", "event_id", "text")
    roots = ledger.merkle_roots(levels)
    proofs = ledger.merkle_proofs(levels).join(roots.select("tree_id", "root", "leaves"), "tree_id")
    ok = F.bool_and(ledger.verify(F.col("leaf"), F.col("path"), F.col("root"))) & (F.count(F.lit(1)) == F.max("leaves"))
    return proofs.groupBy("tree_id").agg(F.count(F.lit(1)).alias("proofs"), ok.alias("ok"))


# Run summaries


@_query(f"""with {_RUNS} select system, query, count(*) as runs, sum(ok_count)::bigint as total_ok_count, 0::bigint as total_error_count, round(avg(mean_ms), 6) as mean_of_mean_ms, round(median(p50_ms), 6) as median_p50_ms,
  round(avg(p95_ms), 6) as mean_p95_ms, min(p95_ms) as min_p95_ms, max(p95_ms) as max_p95_ms, round(median(p95_ms), 6) as median_p95_ms, round(avg(p99_ms), 6) as mean_p99_ms, min(min_ms) as min_observed_ms, max(max_ms) as max_observed_ms
  from s group by 1, 2""")
def agg10_reruns(spark, d):
    return stats.rerun_summary(_runs(spark, d), "system", "query")


@_query(f"with {_RUNS} select system, run, " + ", ".join(f"max(p95_ms) filter (query = {q}) as p95_{q}, round(max(mean_ms) filter (query = {q}), 6) as mean_{q}" for q in range(4)) + " from s group by 1, 2")
def agg13_scale_table(spark, d):
    runs = _runs(spark, d).withColumn("row", F.concat_ws("/", "system", F.col("run").cast("string")))
    table = stats.scale_table(runs, "row", "query", [0, 1, 2, 3])
    part = lambda i: F.split_part("row", F.lit("/"), F.lit(i))
    return table.select(part(1).alias("system"), part(2).cast("long").alias("run"), *[c for c in table.columns if c != "row"])


@_query("select event_type, round(avg(value), 6) as mean, round(var_pop(value), 6) as variance, round(stddev_pop(value), 6) as deviation from events group by 1")
def agg15_moments(spark, d):
    return stats.moments(model.table(spark, d, "events"), "event_type", "value")


@_query("select 'shard='||(user_id % 8)||',type='||event_type as labels, sum(case when event_id % 3 = 0 then -1 else 1 end)::bigint as value from events group by 1")
def agg18_counters(spark, d):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 8).cast("string"))
    return stats.counters(model.table(spark, d, "events").select(labels.alias("l"), (F.col("event_id") % 3 != 0).alias("up")), "l", "up")


SQL["mk3_verified_proofs"] = _MK3
