"""Small tables with known answers for views, link checks, transfers, rules and run summaries."""

import datetime as dt

from pyspark.sql import functions as F

from tracework.operators import access, bridge, quality, stats, views


def test_subgraph_depth_and_unknown_root(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("c", "a")], "src string, dst string")
    roots = spark.createDataFrame([("b",)], "n string")
    nodes, inside = views.subgraphs(e, roots, 1)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"}
    assert {(r.src, r.dst) for r in inside.collect()} == {("b", "a"), ("c", "b"), ("c", "a")}
    nodes, inside = views.subgraphs(e, roots, 0)
    assert [r.node for r in nodes.collect()] == ["b"] and inside.count() == 0


def test_links_name_the_first_fault(spark):
    nodes = spark.createDataFrame([("e", "entity"), ("a", "activity")], "id string, kind string")
    links = spark.createDataFrame([("e", "a"), ("x", "y"), ("e", "y"), ("a", "a"), ("e", "e"), (None, "a")], "src string, dst string")
    got = {(r.src, r.dst): r.fault for r in quality.check_links(links, nodes, nodes).collect()}
    assert got == {
        ("e", "a"): None, ("x", "y"): "entity not found", ("e", "y"): "activity not found",
        ("a", "a"): "not of kind entity", ("e", "e"): "not of kind activity", (None, "a"): "entity not found",
    }


def test_places(spark):
    rows = [(None, None), ("", "text"), ("Rome", "text"), ('{"lat":1,"lng":2}', "map"), ('{"lat":1}', "map"), ("4", "other")]
    got = spark.createDataFrame(rows, "l string, k string").select(quality.location_fault(F.col("l"), F.col("k")).alias("f")).collect()
    assert [r.f for r in got] == [None, "empty location", None, None, "location without lat and lng", "location is neither text nor map"]


def test_transfer_tests_come_in_order(spark):
    e = spark.createDataFrame([("e", "t", "b1", "name")], "entity_id string, entity_type string, batch string, product_name string")
    a = spark.createDataFrame([("a", "made", None), ("b", "made", None)], "activity_id string, activity_type string, started_at timestamp")
    g = spark.createDataFrame([("g", "G", "org"), ("h", "H", "org")], "agent_id string, agent_name string, agent_type string")
    p = bridge.payloads(spark.createDataFrame([("e", "b", "g"), ("e", "a", "h")], "entity_id string, activity_id string, agent_id string"), e, a, g)
    assert p.first().activity_id == "a"
    two, none = F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>")
    cases = [
        p.withColumn("transfer_id", F.lit(1)).withColumn("signatures", two),
        p.withColumn("transfer_id", F.lit(2)).withColumn("signatures", none),
        p.withColumn("transfer_id", F.lit(3)).withColumn("signatures", none).withColumn("merkle_root", F.lit(None).cast("string")),
        p.withColumn("transfer_id", F.lit(4)).withColumn("signatures", two).withColumn("used", F.lit("other")),
        p.withColumn("transfer_id", F.lit(5)).withColumn("signatures", two).withColumns({"merkle_root": F.lit(None).cast("string"), "merkle_proof": F.lit(None).cast(bridge.PATH), "tx_hash": F.lit("no")}),
    ]
    cases.append(p.withColumn("transfer_id", F.lit(6)).withColumn("signatures", two).withColumn("batch", F.lit("another")))  # the proof covers it
    rows = cases[0]
    for c in cases[1:]:
        rows = rows.unionByName(c)
    decided = bridge.decide(rows, 2)
    got = {r.transfer_id: (r.status, r.reason, r.needed) for r in decided.collect()}
    assert got == {
        1: ("executed", None, None), 2: ("pending", None, 2), 3: ("failed", "invalid proof", None),
        4: ("failed", "invalid payload", None), 5: ("executed", None, None), 6: ("failed", "invalid proof", None),
    }
    new = bridge.target_rows(decided, decided.where("transfer_id = 5"), "north").collect()
    assert [(r.transfer_id, r.source_chain, r.entity_type, r.batch) for r in new] == [(1, "north", "t", "b1")]


def test_rules_and_policy_log(spark):
    r = spark.createDataFrame([(1, "read", 3), (2, "read", None), (3, "write", 9)], "request_id int, requested_action string, level int")
    got = access.by_attributes(r, {"action": "read", "level": 3, "other": 1}).orderBy("request_id").collect()
    assert [x.success for x in got] == [True, False, False]
    log = spark.createDataFrame([("r", 1, "a", "put"), ("r", 2, "b", "put"), ("s", 1, "a", "put"), ("s", 2, "a", "remove")], "resource_id string, i int, owner_id string, op string")
    assert [(x.resource_id, x.owner_id) for x in access.current_policies(log, "i").collect()] == [("r", "b")]
    q = spark.createDataFrame([(1, None, 1, "own", dt.datetime(2024, 1, 1))], "request_id int, requestor_id int, resource_id int, requested_action string, request_time timestamp")
    assert access.request_faults(q).first().faults == "missing requestor_id; unknown action"


def test_counters_and_empty_statistics(spark):
    rows = spark.createDataFrame([({"b": "2", "a": "1"}, True), ({"a": "1", "b": "2"}, False), ({}, True)], "l map<string,string>, up boolean")
    assert {(r.labels, r.value) for r in stats.counters(rows, "l", "up").collect()} == {("a=1,b=2", 0), ("", 1)}
    none = spark.createDataFrame([], "id string, type string"), spark.createDataFrame([], "src string, rel string, dst string")
    assert {(r.measure, r.value) for r in views.kg_statistics(*none).collect()} == {("nodes", 0), ("edges", 0), ("average degree", 0), ("greatest degree", 0)}
