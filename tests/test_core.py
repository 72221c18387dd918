"""Small tables with known answers for the provenance operators."""

import datetime as dt
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tracework.functions import ids
from tracework.operators import access, confidence, graph, ledger, quality, timetravel
from tracework.operators.match import Query
from tracework.sources import files, rdf, recalls, turtle
from tracework.streaming import ingest, streams


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_known_uuid(spark):
    row = spark.range(1).select(ids.uuid3(F.lit("openfda-food/entity/F-0001-2024")).alias("u"), ids.uuid3(F.lit("uht-seed/entity/chocolate")).alias("c")).first()
    assert row.u == "87996074-8112-3534-95f7-729dfdc28a47"
    assert row.c == "fea469b0-2c41-3154-878e-babce33ea5df"


def test_dates_places_and_curies(spark):
    r = spark.createDataFrame([("20240230", " ", None, "US"), ("20240229", "A", "B", "")], "d string, c string, s string, k string")
    out = r.select(ids.strict_date(F.col("d")).alias("t"), ids.place(F.col("c"), F.col("s"), F.col("k")).alias("p")).collect()
    assert [x.t for x in out] == [None, dt.datetime(2024, 2, 29)] and [x.p for x in out] == ["US", "A, B"]
    m = F.create_map(F.lit("ex"), F.lit("http://e/"))
    got = spark.createDataFrame([("ex:a",), ("no:a",), ("http://x:1",), ("plain",)], "t string").select(ids.expand_curie(F.col("t"), m).alias("u"))
    assert [x.u for x in got.collect()] == ["http://e/a", "no:a", "http://x:1", None]


def test_diamond_paths_and_depth(spark):
    e = edges(spark, ("m1", "s"), ("m2", "s"), ("e", "m1"), ("e", "m2"))
    got = graph.ancestors(e, spark.createDataFrame([("e",)], "n string")).collect()
    assert {(x.node, x.hops) for x in got} == {("m1", 1), ("m2", 1), ("s", 2)}
    assert {x.node for x in graph.ancestors(e, spark.createDataFrame([("e",)], "n string"), 1).collect()} == {"m1", "m2"}
    p = graph.shortest_paths(e, spark.createDataFrame([("s", "e"), ("s", "s"), ("e", "s")], "start string, end string")).collect()
    assert {(x.start, x.end, tuple(x.path), x.hops) for x in p} == {("s", "e", ("s", "m1", "e"), 2), ("s", "s", ("s",), 0)}


def test_cycles_end_and_are_listed_once(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("x", "x"), ("y", "a"))
    assert {tuple(x.cycle) for x in graph.cycles(e).collect()} == {("a", "b", "c"), ("c", "d"), ("x",)}
    got = graph.ancestors(e, spark.createDataFrame([("a",)], "n string")).collect()
    assert {x.node for x in got} == {"a", "b", "c", "d"}


def test_simple_paths_have_no_bound_but_the_depth(spark):
    n = 101
    layers = spark.range(2).crossJoin(spark.range(n).select(F.col("id").alias("a"))).crossJoin(spark.range(n).select(F.col("id").alias("b")))
    e = layers.select(F.concat_ws("/", "id", "a").alias("src"), F.concat_ws("/", F.col("id") + 1, "b").alias("dst"))
    found = graph.simple_paths(e, spark.range(n).select(F.concat(F.lit("0/"), "id").alias("n")), 2)
    assert found.count() == n * n + n * n * n


def test_long_rings_and_chains_are_whole(spark):
    ring = edges(spark, *((f"{k:02}", f"{(k + 1) % 10:02}") for k in range(10)))
    assert [tuple(x.cycle) for x in graph.cycles(ring).collect()] == [tuple(f"{k:02}" for k in range(10))]
    assert graph.cycles(ring, 9).count() == 0
    chain = edges(spark, *((f"{k + 1:03}", f"{k:03}") for k in range(66)))
    found = graph.shortest_paths(chain, spark.createDataFrame([("000", "066"), ("066", "000")], "start string, end string")).collect()
    assert [(x.end, x.hops) for x in found] == [("066", 66)]


def test_components_with_isolated_hub_and_empty(spark):
    n = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "n string")
    got = graph.components(n, edges(spark, ("e2", "e1"))).collect()
    assert {(x.node, x.component) for x in got} == {("e1", "e1"), ("e2", "e1"), ("e3", "e3")}
    hub = edges(spark, *((f"c{i:04}", "a") for i in range(1000)), *((f"c{i:04}", f"c{i + 1:04}") for i in range(999)))
    assert {x.component for x in graph.components(n.where("false"), hub).collect()} == {"a"}
    assert graph.components(n, edges(spark, ("x", "x")).where("false")).count() == 3


def test_degree_and_density(spark):
    n = spark.createDataFrame([("a",)], "n string")
    e = edges(spark, ("a", "p"), ("a", "q"))
    assert graph.degrees(n, e).first().degree == 2
    assert graph.statistics(n, e).first().density is None


def test_confidence_cases(spark):
    t = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    ent = spark.createDataFrame(
        [("1", "t", "full"), ("2", "t", None), ("3", "t", "noagent"), ("4", "t", "noend"), ("5", "t", "late"), ("6", None, "nostart")],
        "entity_id string, entity_type string, was_generated_by string",
    )
    act = spark.createDataFrame(
        [("full", *t), ("noagent", *t), ("noend", t[0], None), ("late", t[1], t[0]), ("nostart", None, None)],
        "activity_id string, started_at timestamp, ended_at timestamp",
    )
    e = spark.createDataFrame([(a, "wasAssociatedWith", "g") for a in ("full", "noend", "late", "nostart")], "src string, rel string, dst string")
    e = e.unionByName(spark.createDataFrame([("noagent", "wasAssociatedWith", "ghost")], "src string, rel string, dst string"))  # no such agent
    found = confidence.contexts(ent, act, e, spark.createDataFrame([("g",)], "agent_id string"))
    got = {x.entity_id: x for x in confidence.score(confidence.signals(found)).collect()}
    want = {"1": 1.0, "2": 0.5, "3": 1.0, "4": 1.0, "5": 0.9, "6": 0.6 / 0.9}
    assert {k: round(v.confidence, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert "agent_present" in got["3"].unknown and "time_order_valid" in got["5"].missing


def test_paths_end_at_roots_and_cap(spark):
    e = edges(spark, ("e", "m1"), ("e", "m2"), ("m1", "s"), ("m2", "s"), ("a", "b"), ("b", "a"))
    got = confidence.derive_paths(e, spark.createDataFrame([("e",), ("a",), ("z",)], "n string")).collect()
    assert {tuple(x.path) for x in got} == {("e", "m1", "s"), ("e", "m2", "s"), ("a", "b"), ("z",)}
    one = confidence.derive_paths(e, spark.createDataFrame([("e",)], "n string"), max_paths=1).collect()
    assert [tuple(x.path) for x in one] == [("e", "m1", "s")]


def expected_access(who, action, visibility, at):
    """What each requestor (owner, party, stranger) gets, as a table written out by visibility, time and action."""
    shared = action in ("read", "write", "update")
    allowed = who == "owner" and (shared or action in ("delete", "admin")) or who == "party" and shared
    if visibility == "public":
        return "public" if allowed else "action-not-allowed"
    if visibility == "private":
        return "not-authorized" if who != "owner" else "owner" if allowed else "action-not-allowed"
    if visibility != "restricted":
        return "invalid-visibility"
    if at != "inside":
        return "not-yet-valid"
    return "not-authorized" if who == "stranger" else "authorized" if allowed else "action-not-allowed"


def test_access_by_action_visibility_window_and_requestor(spark):
    schema = "resource_id long, owner_id long, visibility string, authorized_parties array<long>, valid_from timestamp, valid_until timestamp"
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)
    kinds = ["public", "private", "restricted", "secret", None]
    policies = spark.createDataFrame([(i, 10, v, [20], start, end) for i, v in enumerate(kinds)], schema)
    times = {"before": dt.datetime(2024, 1, 1), "start": start, "inside": dt.datetime(2024, 1, 10), "end": end, "after": dt.datetime(2024, 2, 1)}
    cases = [
        (w, a, i, t) for w in ("owner", "party", "stranger") for a in ("read", "write", "update", "delete", "admin", "dance", None) for i in range(len(kinds)) for t in times
    ]
    number = {"owner": 10, "party": 20, "stranger": 30}
    rows = [(n, number[w], i, a, times[t]) for n, (w, a, i, t) in enumerate(cases)]
    asked = "request_id long, requestor_id long, resource_id long, requested_action string, request_time timestamp"
    got = {r.request_id: r for r in access.decide(spark.createDataFrame(rows, asked), policies).collect()}
    assert len(got) == len(cases)
    for n, (w, a, i, t) in enumerate(cases):
        want = expected_access(w, a, kinds[i], t)
        assert (got[n].reason, got[n].success) == (want, want in ("public", "owner", "authorized")), (w, a, kinds[i], t)
        assert got[n].reason_strict == ("expired" if want == "not-yet-valid" and t in ("end", "after") else want)
    # Windows with one end or none, a missing policy, null parties and requestors, and a policy of another resource.
    more = spark.createDataFrame([(1, 10, "restricted", [20], None, end), (2, 10, "restricted", None, start, None), (3, 10, "restricted", [20], None, None), (4, None, "private", None, None, None)], schema)
    odd = [(0, 20, 1, "read", times["after"]), (1, 20, 1, "read", times["before"]), (2, 10, 2, "admin", times["after"]), (3, 20, 2, "read", times["after"]), (4, 20, 3, "read", None),
           (5, 20, 9, "read", start), (6, None, 4, "read", start), (7, 10, 1, "read", None)]
    got = {r.request_id: r.reason for r in access.decide(spark.createDataFrame(odd, asked), more).collect()}
    assert got == {0: "expired", 1: "authorized", 2: "authorized", 3: "not-authorized", 4: "authorized", 5: "no-policy", 6: "not-authorized", 7: "expired"}
    pair = spark.createDataFrame([(0, 10, 7, "read", start)], asked).crossJoin(policies.where("resource_id = 0").withColumnRenamed("resource_id", "policy_resource_id"))
    assert access.decide_pairs(pair).first().reason == "resource-mismatch"
    mine = access.accessible(policies, {"requestor_id": 20, "requested_action": "read", "request_time": times["inside"]})
    assert sorted(r.visibility for r in mine.collect()) == ["public", "restricted"] and mine.columns == policies.columns


def test_roles_proofs_and_grants(spark):
    schema = "resource_id long, owner_id long, visibility string, authorized_parties array<long>, valid_from timestamp, valid_until timestamp"
    policies = spark.createDataFrame([(1, 10, "restricted", [20], None, None), (2, 10, "private", [20], None, None), (3, 10, "public", [20], None, None)], schema)
    asked = "request_id long, requestor_id long, resource_id long, requested_action string, request_time timestamp"
    requests = spark.createDataFrame([(0, 10, 1, "delete", None), (1, 20, 1, "read", None), (2, 20, 1, "write", None), (3, 30, 1, "read", None)], asked)
    roles = spark.createDataFrame([(20, "user"), (20, "guest"), (40, "admin")], "requestor_id long, role string")
    allowed = spark.createDataFrame([("user", "read"), ("admin", "write")], "role string, requested_action string")
    got = {r.request_id: (r.success, r.reason) for r in access.by_roles(requests, roles, allowed, policies).collect()}
    yes, no = (True, "role-authorized"), (False, "role-not-authorized")
    assert got == {0: yes, 1: yes, 2: no, 3: no}
    assert [r.requestor_id for r in access.granters_by_roles(roles).collect()] == [40]
    decisions = access.decide(requests, policies)
    proofs = access.proof(decisions, policies)
    assert all(r.valid for r in access.verify_proof(proofs, decisions, policies).collect())
    later = policies.withColumn("valid_until", F.lit("2030-01-01").cast("timestamp"))  # the window is part of the policy's digest
    assert not any(r.valid for r in access.verify_proof(proofs, decisions, later).collect())
    changes = spark.createDataFrame([(1, 40, "grant"), (1, 20, "revoke")], "resource_id long, party long, op string")
    assert {x.resource_id: x.authorized_parties for x in access.grant(policies, changes).collect()} == {1: [40], 2: [20], 3: [20]}
    assert {r.visibility: r.policies for r in access.policy_statistics(policies).collect()} == {"restricted": 1, "private": 1, "public": 1}


def test_time_travel(spark):
    log = spark.createDataFrame(
        [("e", "name", "v1", 1, "add"), ("e", "name", "v1", 2, "retract"), ("e", "name", "v2", 2, "add"), ("e", "tag", "x", 1, "add"), ("e", "tag", "y", 1, "add"), ("e", "tag", "x", 3, "retract")],
        "e string, a string, v string, tx long, op string",
    )
    get = lambda df: {(x.a, x.v) for x in df.collect()}
    assert get(timetravel.as_of(log, 1, ("tag",))) == {("name", "v1"), ("tag", "x"), ("tag", "y")}
    assert get(timetravel.as_of(log, None, ("tag",))) == {("name", "v2"), ("tag", "y")}
    assert timetravel.history(log, "nobody").count() == 0
    new = spark.createDataFrame([("e", "name", "v3", "add"), ("f", "name", "z", "add")], "e string, a string, v string, op string")
    got = {(x.e, x.v, x.op) for x in timetravel.apply_changes(log.where("a = 'name'"), new, 9).collect()}
    assert got == {("e", "v2", "retract"), ("e", "v3", "add"), ("f", "z", "add")}
    assert [(x.tx, x.a, x.op, x.v) for x in timetravel.history(log, "e").orderBy("position").collect()] == [
        (1, "name", "add", "v1"), (1, "tag", "add", "x"), (1, "tag", "add", "y"), (2, "name", "retract", "v1"), (2, "name", "add", "v2"), (3, "tag", "retract", "x")
    ]


def test_change_batches_chain_with_reads(spark):
    shape, many = "e string, a string, v string, tx long, op string", ("tag",)
    log = spark.createDataFrame([], shape)

    def change(log, tx, rows, seq=False, **kw):
        batch = spark.createDataFrame(rows, "e string, a string, v string, op string" + ", seq int" * seq)
        new = timetravel.apply_changes(log, batch, tx, many, **kw).collect()
        return spark.createDataFrame([*log.collect(), *new], shape), {(x.e, x.a, x.v, x.op) for x in new}

    now = lambda log: {(x.e, x.a, x.v) for x in timetravel.as_of(log, None, many).collect()}
    log, new = change(log, 1, [("x", "name", "v1", "add"), ("x", "tag", "p", "add"), ("x", "tag", "q", "add"), ("x", "id", "7", "add")])
    assert len(new) == 4
    log, new = change(log, 2, [("x", "name", "v2", "add"), ("x", "tag", "p", "add"), ("x", "tag", "q", "retract")])
    assert new == {("x", "name", "v1", "retract"), ("x", "name", "v2", "add"), ("x", "tag", "q", "retract")}
    assert now(log) == {("x", "name", "v2"), ("x", "tag", "p"), ("x", "id", "7")}
    assert {x.v for x in timetravel.as_of(log, 1, many).collect()} == {"v1", "p", "q", "7"}
    # Two values at once: the later of the batch; the same value again, and retracting another than is there: no change.
    log, new = change(log, 3, [("x", "name", "b", "add", 1), ("x", "name", "a", "add", 2)], True)
    assert new == {("x", "name", "v2", "retract"), ("x", "name", "a", "add")}
    log, new = change(log, 4, [("x", "name", "a", "add"), ("x", "name", "a", "retract"), ("x", "id", "8", "retract")])
    assert new == set()
    # An entity found again by its identity; an entity taken away whole, but for what is asserted at once.
    log, new = change(log, 5, [("new", "id", "7", "add"), ("new", "name", "c", "add")], identity=("id",))
    assert new == {("x", "name", "a", "retract"), ("x", "name", "c", "add")}
    log, new = change(log, 6, [("x", None, None, "retract-entity"), ("x", "tag", "z", "add")])
    assert new == {("x", "name", "c", "retract"), ("x", "tag", "p", "retract"), ("x", "id", "7", "retract"), ("x", "tag", "z", "add")}
    assert now(log) == {("x", "tag", "z")}
    wide = timetravel.wide(timetravel.as_of(log, 2, many), ["name", "tag", "gone"], many).collect()
    assert [tuple(r) for r in wide] == [("x", "v2", ["p"], None)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_merkle(spark, n):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = [h(str(i)) for i in range(n)]
    while len(row) > 1:
        row = [h(row[i] + row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    levels = ledger.merkle_levels(spark.createDataFrame([(1, i, str(i)) for i in range(n)], "t long, i long, x string"), "t", "i", "x")
    roots = ledger.merkle_roots(levels)
    assert roots.first().root == row[0]
    proofs = ledger.merkle_proofs(levels).join(roots, "tree_id")
    good = proofs.select(ledger.verify(F.col("leaf"), F.col("path"), F.col("root")).alias("ok"), ledger.verify(F.lit("0" * 64), F.col("path"), F.col("root")).alias("no"), ledger.verify(F.lit("zz"), F.col("path"), F.col("root")).alias("bad")).collect()
    assert len(good) == n and all(x.ok and not x.no and not x.bad for x in good)


def test_quality(spark):
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "zz")], "src string, dst string").withColumn("rel", F.lit("wasDerivedFrom"))
    ent = spark.createDataFrame([("a", "t"), ("b", None), ("c", "t"), ("c", "t")], "entity_id string, entity_type string")
    assert {x.fault for x in quality.check_derivations(e, ent.distinct()).collect()} == {"self-derivation", None, "unknown source entity"}
    assert quality.duplicates(ent, "entity_id").collect()[0].id == "c"
    assert {x.id: x.errors for x in quality.validate(ent.distinct(), "entity").collect()}["b"] == "missing entity_type"


def test_patterns_with_optional(spark):
    t = spark.createDataFrame([("x", "name", "n"), ("x", "made", "y"), ("z", "name", "m")], "s string, p string, o string")
    q = Query().find("?a", "?n", "?b").where(("?a", "name", "?n")).optional(("?a", "made", "?b")).order_by("?a")
    assert [tuple(r) for r in q.execute(t).collect()] == [("x", "n", "y"), ("z", "m", None)]


def test_rdf_round_trip_and_blank_nodes(spark):
    lines = ["<u:a> <u:p> <u:b> .", '<u:a> <u:p> "x \\" y"@en .', '<u:a> <u:p> "1"^^<u:int> .', "_:b1 <u:p> _:b10 .", "# no", "@prefix a: <b> .", "bad", ""]
    t = rdf.parse_ntriples(spark.createDataFrame([(v, d) for d in ("d1", "d2") for v in lines], "value string, doc string"))
    assert t.count() == 8
    s = rdf.skolemize(t, "doc").where("o_kind = 'blank'").collect()
    assert len({x.s for x in s}) == 2 and all(x.s != x.o for x in s)
    odd = ['say "hi"', "back\\slash \\n", "new\nline\ttab\r", "é 漢 😀", "x" * 20_000 + '"', "it's", ""]
    triples = spark.createDataFrame([("u:s", "u:p", o, "literal", None, None) for o in odd], "s string, p string, o string, o_kind string, datatype string, lang string")
    out = rdf.to_ntriples(triples)
    assert all("\n" not in x.value for x in out.collect())
    assert sorted(x.o for x in rdf.parse_ntriples(out).collect()) == sorted(odd)
    more = spark.createDataFrame([('<a> <b> "\\u00e9\\U0001F600 \\\\u0041 \\\'q\\\'" .',), ('<a> <b> "x" . # end',)], "value string")
    assert {x.o for x in rdf.parse_ntriples(more).collect()} == {"é😀 \\u0041 'q'", "x"}
    assert [x.value for x in rdf.rejected_lines(spark.createDataFrame([(v,) for v in lines], "value string")).collect()] == ["bad"]
    assert rdf.blank_nodes_left(t).first().left_over == 2 and rdf.blank_nodes_left(rdf.skolemize(t, "doc")).first().valid
    assert {x.n for x in rdf.blank_node_statistics(spark.createDataFrame([(v,) for v in lines], "value string")).collect()} == {1}


def test_reading_and_ingesting_ntriples(spark, tmp_path):
    uuid = "3f2504e0-4f89-31d3-9a0c-0305e82c3301"
    for name in ("a.nt", "b.nt"):
        (tmp_path / name).write_text(
            f'_:b1 <http://p#type> <http://p#Entity> .\n_:b1 <http://p#wasGeneratedBy> <{uuid}> .\n_:b1 <http://p#used> <urn:x> .\n'
            f'<urn:{name}> <urn:n> "12"^^<x#integer> .\n<urn:{name}> <urn:n> "no"^^<x#integer> .\n<urn:{name}> <urn:t> "true"^^<x#boolean> .\n'
        )
    triples = rdf.read_ntriples(spark, str(tmp_path))
    rows = rdf.ingest(triples, 5).collect()
    assert len({r.e for r in rows if r.a == "prov/entity-type"}) == 2 and all(r.tx == 5 and r.op == "add" for r in rows)
    assert {(r.a, r.v, r.type) for r in rows} == {
        ("prov/entity-type", "http://p#Entity", "string"), ("prov/wasGeneratedBy", uuid, "ref"), ("http___p_used", "urn:x", "string"),
        ("urn_n", "12", "bigint"), ("urn_t", "true", "boolean"),
    }
    kinds = [(r.k, r.f) for r in spark.createDataFrame([(x,) for x in ("a.rdf", "a.ttl", "a.nt", "a.n3", "a.jsonld", "a")], "k string").select("k", rdf.rdf_format(F.col("k")).alias("f")).collect()]
    assert [f for _, f in kinds] == ["rdf/xml", "turtle", "n-triples", "n3", "jsonld", "turtle"]


def test_turtle_in_and_out(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(
        '@prefix ex: <http://e.org/> .\n@prefix uht: <http://u.org#> .\n# all of it\n'
        'ex:milk a prov:Entity ;\n  uht:batch "RAW-1" ; # a # comment\n  uht:litres 12.5 ;\n  uht:n 3 ;\n  uht:ok true ;\n  uht:note "a # \\"b\\""@en ;\n'
        '  prov:wasGeneratedBy ex:run ;\n  uht:at "2024-01-01T00:00:00"^^xsd:dateTime .\n\nex:run a prov:Activity .\nex:boss prov:knows <http://e.org/you> .\nnonsense here\n'
    )
    t = turtle.read_turtle(spark, str(tmp_path))
    got = {(r.s.split("/")[-1], re.split("[#/]", r.p)[-1], r.o, r.o_kind, r.datatype and r.datatype.split("#")[1], r.lang) for r in t.collect()}
    assert got == {
        ("milk", "type", "http://www.w3.org/ns/prov#Entity", "uri", None, None), ("milk", "batch", "RAW-1", "literal", None, None),
        ("milk", "litres", "12.5", "literal", "decimal", None), ("milk", "n", "3", "literal", "integer", None), ("milk", "ok", "true", "literal", "boolean", None),
        ("milk", "note", 'a # "b"', "literal", None, "en"), ("milk", "wasGeneratedBy", "http://e.org/run", "uri", None, None),
        ("milk", "at", "2024-01-01T00:00:00", "literal", "dateTime", None), ("run", "type", "http://www.w3.org/ns/prov#Activity", "uri", None, None),
        ("boss", "knows", "http://e.org/you", "uri", None, None),
    }
    kinds = {r.s.split("/")[-1]: (r.kind, r.attributes) for r in turtle.by_class(t).collect()}
    assert {k: v for k, (v, _) in kinds.items()} == {"milk": "entity", "run": "activity", "boss": "entity"} and kinds["milk"][1]["http://u.org#n"] == ["3"]
    out = turtle.to_turtle(t, {"prov": turtle.PREFIXES["prov"], "xsd": turtle.PREFIXES["xsd"], "e": "http://e.org/"})
    again = turtle.parse_turtle(out.selectExpr("'d' as doc", "part * 100000 + monotonically_increasing_id() as pos", "value"))
    columns = ["s", "p", "o", "o_kind", "datatype", "lang"]
    assert sorted(map(tuple, again.select(columns).collect()), key=str) == sorted(map(tuple, t.select(columns).collect()), key=str)


def test_files_of_records(spark, tmp_path):
    record = {"recall_number": "F-1", "event_id": "2", "recalling_firm": "Firm é", "product_description": "p"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"records": [record, {**record, "recall_number": "F-2"}]}, indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"results": [{**record, "recall_number": "F-3"}]}))
    (tmp_path / "in" / "c.json").write_text(json.dumps({**record, "recall_number": "F-4"}) + "\n" + json.dumps({**record, "recall_number": "F-5"}) + "\n")
    rows = files.read_recalls(spark, str(tmp_path / "in"))
    assert sorted(r.recall_number for r in rows.collect()) == ["F-1", "F-2", "F-3", "F-4", "F-5"] and files.read_recalls(spark, str(tmp_path / "in"), 2).count() == 2
    digests = {r.file.split("/")[-1]: r.sha256 for r in files.file_digests(spark, str(tmp_path / "in")).collect()}
    assert digests["b.json"] == hashlib.sha256((tmp_path / "in" / "b.json").read_bytes()).hexdigest()
    hexed = files.encode_payloads(rows)
    odd = spark.createDataFrame([("0x",), ("0xzz",), ("0xff00",), (b"other:{}".hex(),), (None,)], "input string")
    assert sorted(r.recall_number for r in files.decode_payloads(hexed.unionByName(odd)).collect()) == ["F-1", "F-2", "F-3", "F-4", "F-5"]
    lines = spark.createDataFrame([("m", "run_id=r=1"), ("m", " k = v "), ("m", "no"), ("n", "k=")], "file string, value string")
    assert {r.file: r.manifest for r in files.parse_manifests(lines).collect()} == {"m": {"run_id": "r=1", "k": "v"}, "n": {"k": ""}}
    files.write_csv(spark.createDataFrame([("q", 1.5)], "query string, mean_ms double"), str(tmp_path / "csv"))
    back = files.read_summaries(spark, str(tmp_path / "csv"), "query string, mean_ms double").first()
    assert (back.query, back.mean_ms) == ("q", 1.5) and back.file.endswith(".csv")
    files.write_json(spark.createDataFrame([("q", None)], "a string, b string"), str(tmp_path / "json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"a":"q"}']
    (tmp_path / "doc.json").write_text(json.dumps({"agents": {"farmer": {"name": "A"}}, "products": {"milk": {"batch": "RAW-MILK-1"}}, "activities": {}}))
    docs = files.read_documents(spark, str(tmp_path / "doc.json"))
    assert [(r.key, r.attributes) for r in docs["products"].collect()] == [("milk", {"batch": "RAW-MILK-1"})] and docs["activities"].count() == 0
    (tmp_path / "bundles.json").write_text('{"entity":{"entity_id":"e"},"activities":[{"activity_id":"a"},{"activity_id":"b"}],"agents":[]}\n{"entity":{"entity_id":"f"},"activities":[{"activity_id":"a"}]}\n')
    parts = files.read_bundles(spark, str(tmp_path / "bundles.json"))
    assert {k: v.count() for k, v in parts.items()} == {"entities": 2, "activities": 2, "agents": 0}
    shape = "id string, name string, namespace string, format string, version string, loaded_at timestamp"
    t0 = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "a", "n", "turtle", "1", t0), ("2", "b", "n", "turtle", "1", t0)], shape)
    new = files.register(old, spark.createDataFrame([("3", "a", "n", "turtle", "2", t0), ("4", "c", "m", "n3", "1", t0)], shape))
    assert {(r.name, r.version) for r in new.collect()} == {("a", "2"), ("b", "1"), ("c", "1")} and files.by_name(new, "a").first().id == "3"
    assert {r.name: r.loaded for r in files.is_loaded(new, spark.createDataFrame([("a",), ("z",)], "name string")).collect()} == {"a": True, "z": False}


def test_scalar_screens(spark):
    row = spark.range(1).select(
        ids.suspicious(F.lit("x" * 9), 8).alias("a"), ids.suspicious(F.lit("JavaScript:1"), 80).alias("b"), ids.suspicious(F.lit("fine"), 80).alias("c"),
        ids.instant(F.lit("2024-01-02T03:04:05Z")).alias("d"), ids.instant(F.lit("2024-13-02")).alias("e"), ids.instant(F.lit("x")).alias("f"),
        ids.combined_score([(F.lit(0.5), 0.6), (F.lit(1.0), 0.4)], F.lit(0.1)).alias("g"), ids.combined_score([(F.lit(0.1), 1.0)], F.lit(0.5)).alias("h"),
        ids.normalise_linear(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("i"), ids.normalise_linear(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("j"), ids.normalise_linear(F.lit(99.0), F.lit(0.0), F.lit(10.0), True).alias("k"),
        ids.sigmoid(F.lit(250.0), 0.01, 250.0).alias("l"), ids.is_hex64(F.lit("a" * 64)).alias("m"), ids.is_uuid(F.lit("zz")).alias("n"), ids.xsd_type(F.lit("http://x#dateTime")).alias("o"),
        files.located(F.create_map(F.lit("district"), F.lit("D"), F.lit("province"), F.lit("P"))).alias("p"), files.located(F.create_map(F.lit("address"), F.lit("A"))).alias("q"), files.located(F.lit(None).cast("map<string,string>")).alias("r"),
        turtle.strip_quotes(F.lit('"""x"""')).alias("s"), turtle.strip_comment(F.lit('a "#" <u#v> # b')).alias("t"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("too long", "suspicious", None, dt.datetime(2024, 1, 2, 3, 4, 5), None, None)
    assert (round(row.g, 6), row.h, row.i, row.j, row.k, row.l, row.m, row.n, row.o) == (0.6, 0.0, 0.5, 0.5, 0.0, 0.5, True, False, "timestamp")
    assert (row.p, row.q, row.r, row.s, row.t.strip()) == ("D, P", "A", "Unknown Location", "x", 'a "#" <u#v>')


def test_recalls(spark):
    c = "recall_number string, event_id string, recalling_firm string, product_description string, city string, state string, country string, recall_initiation_date string, report_date string, termination_date string"
    r = spark.createDataFrame([("F-0001-2024", "1", "Firm", "p", "", "TX", "US", "20240230", "20240105", None), ("F-2", "1", " ", "p", "", "", "", "", "", "")], c)
    got = recalls.normalise(r).collect()
    assert len(got) == 1 and got[0].location == "TX, US" and got[0].started_at == dt.datetime(2024, 1, 5) and got[0].ended_at is None


def test_limiter_window_starts_at_first_request(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate((50, 70, 80, 115, 121))], "key string, ts timestamp, id long")
    got = {x.id: x.allowed for x in streams.limit_requests(log, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_streaming_counters_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", float(m)) for m in range(6)], "ts timestamp, label string, x double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_counters(stream, "ts", "label", "x", "2 minutes").writeStream.outputMode("complete").format("memory").queryName("counters").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from counters").collect()}
    want = {tuple(r) for r in streams.windowed_counters(rows, "ts", "label", "x", "2 minutes").collect()}
    assert got == want and len(got) == 6


def _drain(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def _stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(folder / f"{k}"))
        for f in (folder / f"{k}").glob("part-*"):
            f.rename(folder / f"{k}-{f.name}")
            os.utime(folder / f"{k}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*.parquet")


def test_streamed_changes_make_a_log(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    shape = "id long, e string, a string, v string, op string, ts timestamp"
    rows = [[(1, "x", "name", "v1", "add", t0), (1, "x", "name", "v1", "add", t0)], [(2, "x", "name", "v2", "add", t0), (1, "x", "name", "v1", "add", t0)]]
    (tmp_path / "in").mkdir()
    stream = _stream(spark, tmp_path / "in", [spark.createDataFrame(r, shape) for r in rows])
    q = ingest.ingest_stream(stream, str(tmp_path / "log"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {(r.v, r.tx, r.op) for r in log.collect()} == {("v1", 1, "add"), ("v1", 2, "retract"), ("v2", 2, "add")}
    assert [r.v for r in timetravel.as_of(log).collect()] == ["v2"]


def test_streamed_audit_is_the_batch_audit(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 10)
    shape = "request_id long, requestor_id long, resource_id long, requested_action string, request_time timestamp"
    rows = [spark.createDataFrame([(i, i % 5, i % 4, "read", t0) for i in range(k, k + 10)], shape) for k in (0, 10)]
    pol = spark.createDataFrame([(r, r + 1, v, [2, 3], None, None) for r, v in ((0, "public"), (1, "private"), (2, "restricted"))], "resource_id long, owner_id long, visibility string, authorized_parties array<long>, valid_from timestamp, valid_until timestamp")
    got = {tuple(r) for r in _drain(streams.access_audit(_stream(spark, tmp_path, rows), pol), "audited")}
    want = {tuple(r) for r in streams.access_audit(rows[0].unionByName(rows[1]), pol).collect()}
    assert got == want and len(got) == 20
