"""Registered queries of stored logs and tables, incremental ingest, and the batch forms of streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.functions.ids import uuid3
from tracework.operators.match import Query
from tracework.oracles import _id, _with
from tracework.plans import model
from tracework.plans.materialize import scratch
from tracework.sources import factlog, idindex
from tracework.streaming import streams
from tracework.streaming.ingest import Ingest

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Transactions in a range of the stored tables here, at least: longer logs have wider ranges, not more of them.
_WIDTH = 1000


def _log(spark, d):
    """The fact log, written to folders by attribute and range of transactions: where, and the width of a range."""
    path, log = scratch(spark), model.datoms(spark, d)
    width = factlog.fit_width(log, _WIDTH)
    factlog.write_log(log, path, width)
    return path, width


@_query(_with("datom", "select e, a, v, tx, op from datom where a in ('click', 'purchase') and tx > 2000 and tx <= 5000"))
def src1_stored_log(spark, d):
    path, width = _log(spark, d)
    return factlog.read_log(spark, path, 5000, ("click", "purchase"), after=2000, width=width)


_HELD = """f as (select * from datom where v is not null and e is not null),
  g as (select e, a, v, tx, max(op = 'add') as added from f group by 1, 2, 3, 4),
  taken as (select e, a, v, tx from f where op = 'retract' group by 1, 2, 3, 4),
  one as (select e, a, tx, max(v) as v from g where added group by 1, 2, 3),
  held as (select e, a, v, tx as valid_from, least(lead(tx) over (partition by e, a order by tx),
      (select min(t.tx) from taken t where t.e = one.e and t.a = one.a and t.v = one.v and t.tx > one.tx)) as valid_to from one)"""


@_query(_with("datom", "select e, a, v, valid_from, valid_to from held", more=_HELD))
def tm4_validity(spark, d):
    return factlog.validity(model.datoms(spark, d))


def _stored_validity(spark, d):
    path, log = scratch(spark), model.datoms(spark, d)
    width = factlog.fit_width(log, _WIDTH)
    factlog.write_validity(factlog.validity(log), path, width)
    return path, width


@_query(_with("datom", "select e, a, v, valid_from as tx from held where a in ('click', 'view') and valid_from <= 5000 and (valid_to is null or valid_to > 5000)", more=_HELD))
def tm1_stored_as_of(spark, d):
    path, width = _stored_validity(spark, d)
    valid = factlog.read_validity(spark, path, 5000, ("click", "view"), width)
    return factlog.at(valid, 5000)


@_query(_with("datom", """select p.e, p.tx, a, m[2] as v, m[1] as since from (select p.e, p.tx, d.a, max((d.tx, d.v)) as m from (select user_id::varchar as e, event_id as tx from events) p
    join datom d on d.e = p.e and d.tx <= p.tx and d.op = 'add' and d.v is not null group by 1, 2, 3) p
  where not exists (select 1 from datom r where r.op = 'retract' and r.e = p.e and r.a = p.a and r.v = p.m[2] and r.tx > p.m[1] and r.tx <= p.tx)"""))  # fmt: skip
def tm1_at_pairs(spark, d):
    """What each user's entity held at every one of its events."""
    path, width = _stored_validity(spark, d)
    valid = factlog.read_validity(spark, path, width=width)
    pairs = model.table(spark, d, "events").select(F.col("user_id").cast("string").alias("e"), F.col("event_id").alias("tx"))
    return factlog.at_pairs(valid, pairs, _WIDTH)


@_query("""with b as (select user_id::varchar as e, event_type as a, value::varchar as v, event_id // (select max(event_id) // 4 + 1 from events) as batch, event_id, json_extract_string(props, '$.k')::int % 10 = 0 as gone from events where value is not null),
  adds as (select e, a, batch, arg_max(v, event_id) as v from b where not gone group by 1, 2, 3),
  last as (select e, a, max(batch) as batch from adds group by 1, 2)
select e, a, v, batch + 1 as tx from (select l.e, l.a, x.v, (select min(y.batch) from adds y where y.e = l.e and y.a = l.a and y.v = x.v and y.batch <= l.batch
    and not exists (select 1 from adds z where z.e = l.e and z.a = l.a and z.batch between y.batch and l.batch and z.v <> x.v)) as batch from last l join adds x using (e, a, batch))""")  # fmt: skip
def str5_ingested_state(spark, d):
    """The current state after four batches of assertions, each merged into the parts that its entities fall into."""
    events = model.table(spark, d, "events").where("value is not null")
    size = events.agg(F.max("event_id")).first()[0] // 4 + 1
    k = F.get_json_object("props", "$.k").cast("int")
    changes = events.where(k % 10 != 0).select(
        F.col("user_id").cast("string").alias("e"), F.col("event_type").alias("a"), F.col("value").cast("string").alias("v"), F.lit("add").alias("op"),
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / size).alias("batch"),
    )
    into = Ingest(spark, scratch(spark), parts=16)
    for number in range(4):
        into.step(changes.where(F.col("batch") == number).drop("batch"), number)
    return into.state()


@_query(_with("measurement", """select 'query="'||query||'",system="'||system||'"' as labels, count(*) as n, round(coalesce(sum(latency_ms), 0), 6) as sum, count(latency_ms) as count, count(*) filter (latency_ms <= 1) as le_1_0,
  count(*) filter (latency_ms <= 5) as le_5_0, count(*) filter (latency_ms <= 10) as le_10_0, count(*) filter (latency_ms <= 50) as le_50_0 from measurement group by 1"""))  # fmt: skip
def str3_histograms(spark, d):
    """Histograms by window, merged by label map: the batch form of the stream."""
    rows = model.measurements(spark, d)
    return streams.merged_histograms(streams.windowed_histogram(rows, "ts", ["system", "query"], "latency_ms", [1.0, 5.0, 10.0, 50.0], "1 day"))


@_query(_with("measurement", """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start, system, count(*) as n, round(sum(latency_ms), 6) as total from measurement group by 1, 2"""))
def str3_counters(spark, d):
    rows = streams.windowed_counters(model.measurements(spark, d), "ts", "system", "latency_ms", "1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "system", "n", F.round("total", 6).alias("total"))


@_query(_with("decision", """select requestor_id as actor, resource_id, requested_action, case when success then 'granted' else 'denied' end as outcome, reason from decision where ts >= timestamp '2024-01-10'"""))
def str4_audit(spark, d):
    """The batch form of the streamed audit: requests from a time on, against all policies."""
    rows = model.requests(spark, d).where("request_time >= timestamp '2024-01-10'")
    return streams.access_audit(rows, model.policies(spark, d)).drop("request_time", "audit_id")


_LIMITED = """with recursive e as (select user_id as k, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type <> 'signup'),
  w as (select k, r, ts as start, 1 as n, event_id, true as allowed, 2 as remaining from e where r = 1
    union all select e.k, e.r, case when e.ts > w.start + interval 6 hour then e.ts else w.start end,
      case when e.ts > w.start + interval 6 hour then 1 when w.n < 3 then w.n + 1 else w.n end, e.event_id,
      e.ts > w.start + interval 6 hour or w.n < 3, 3 - case when e.ts > w.start + interval 6 hour then 1 when w.n < 3 then w.n + 1 else w.n end from w join e on e.k = w.k and e.r = w.r + 1)
select k::varchar as key, event_id as id, allowed, remaining from w union all select user_id::varchar, event_id, true, null from events where event_type = 'signup'"""


@_query(_LIMITED)
def str2_limiter_with_skips(spark, d):
    """The limiter with requests that pass uncounted."""
    events = model.table(spark, d, "events")
    log = events.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"), "event_type")
    return streams.limit_requests(log, 3, 6 * 3600.0, F.col("event_type") == "signup").select("key", "id", "allowed", "remaining")


# Lookups by a stored index


def _id_index(spark, d):
    path, rows = scratch(spark), None
    for kind in model.KINDS:
        one = model.ids_of(spark, d, kind)
        rows = one if rows is None else rows.unionByName(one)
    idindex.write_id_index(rows, path)
    return path


@_query(f"""select {_id('part', 'p_partkey')} as id, 'part' as kind, p_partkey::bigint as key from part where p_partkey in (17, 18)
  union all select {_id('order', 'o_orderkey')}, 'order', o_orderkey from orders where o_orderkey = 1 union all select {_id('customer', 'c_custkey')}, 'customer', c_custkey from customer where c_custkey = 7""")
def flt1_by_index(spark, d):
    names = ("part/17", "part/18", "order/1", "customer/7", "customer/none")
    ids = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(uuid3(F.col("n"))).collect()]
    return idindex.find_ids(spark, _id_index(spark, d), ids)


@_query(f"""select {_id('order', 'o_orderkey')} as id, 'order' as kind, o_orderkey::bigint as key from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)""")
def flt13_by_index(spark, d):
    """The orders of large lines, by a table of identifiers."""
    asked = model.table(spark, d, "lineitem").where("l_quantity > 45").select(uuid3(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string"))).alias("x"))
    return idindex.find_many(spark, _id_index(spark, d), asked)


# Triple patterns


def _triples(spark, d):
    e = model.entities(spark, d)
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for p, c in (("type", "entity_type"), ("batch", "batch"), ("name", "product_name"))))
    facts = e.select(F.col("entity_id").alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o").where("o is not null")
    return facts.unionByName(model.edges(spark, d).select(F.col("src").alias("s"), F.col("rel").alias("p"), F.col("dst").alias("o")))


@_query(_with("entity", "select entity_id as e, entity_type as type, product_name as name, was_generated_by as \"order\" from entity where batch = 'Brand#17' and entity_type is not null"))
def jn1_star(spark, d):
    """Four patterns of one subject, three of them needed, by one aggregation and one join."""
    q = Query().single("type", "batch", "name", "wasGeneratedBy").find("?e", "?type", "?name", "?order")
    q = q.where(("?e", "batch", "Brand#17"), ("?e", "type", "?type"), ("?e", "name", "?name")).optional(("?e", "wasGeneratedBy", "?order"))
    return q.execute(_triples(spark, d))


@_query(_with("entity edge", """select distinct e.entity_id as e, x.o as "order", x.c as agent from entity e left join (select g.src as e, g.dst as o, w.dst as c from edge g join edge w on w.src = g.dst and w.rel = 'wasAssociatedWith'
    where g.rel = 'wasGeneratedBy' and substr(w.dst, 1, 1) = 'a') x on x.e = e.entity_id"""))  # fmt: skip
def jn1_optional_group(spark, d):
    """Entities with their order and its agent where both are there: the group comes whole or not at all."""
    triples = _triples(spark, d).where("p != 'wasAssociatedWith' or substring(o, 1, 1) = 'a'")
    q = Query().find("?e", "?order", "?agent").where(("?e", "name", "?name")).optional(("?e", "wasGeneratedBy", "?order"), ("?order", "wasAssociatedWith", "?agent"))
    return q.distinct().execute(triples)


@_query(_with("entity edge", """select distinct n.product_name as name, g.dst as "order" from (select entity_id as e, product_name from entity where batch = 'Brand#17') n join edge g on g.src = n.e and g.rel = 'wasGeneratedBy'"""))
def jn1_parts(spark, d):
    """A part that shares no variable with the rest only has to be there."""
    q = Query().single("batch", "name", "wasGeneratedBy").find("?name", "?order").where(("?x", "used", "?y"), ("?e", "batch", "Brand#17"), ("?e", "name", "?name"), ("?e", "wasGeneratedBy", "?order"))
    return q.distinct().execute(_triples(spark, d))
