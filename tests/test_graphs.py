"""Closures, components, cycles and distances against plain versions."""

import random

import pytest

from pyspark.sql import functions as F

from tracework import catalogue, catalogue_views
from tracework.operators import components, graph, lineage, views
from tracework.operators.components import forest_components
from tracework.plans.materialize import written


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, "r", b) for a, b in pairs], "src long, rel string, dst long")


def plain_reach(pairs):
    out = {}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for start in {x for p in pairs for x in p}:
        frontier, hops = {start}, 0
        while frontier:
            hops += 1
            frontier = {b for a in frontier for b in after.get(a, ()) if (start, b) not in out}
            out.update({(start, b): hops for b in frontier})
    return out


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    chain = [(i, i + 1) for i in range(600)]
    with written() as tables:
        got = graph.closure(edges_of(spark, chain)).cache()
        assert len(tables) == 12  # the edges, ten rounds, and one that found nothing
    assert got.count() == 600 * 601 // 2
    assert got.where("hops != node - start").count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_closure_and_reach_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    want, edges = plain_reach(pairs), edges_of(spark, pairs)
    assert {(r.start, r.node): r.hops for r in graph.closure(edges).collect()} == want
    starts = spark.createDataFrame([(1,), (2,), (3,), (99,), (1,)], "x long")
    for few in (False, True):
        for depth in (None, 1, 3, 5):
            got = {(r.start, r.node): r.hops for r in graph.reach(edges, starts, depth, few).collect()}
            assert got == {k: h for k, h in want.items() if k[0] in (1, 2, 3) and (depth is None or h <= depth)}
    sample = spark.createDataFrame([(i, i) for i in range(40)], "node long, i int")
    got = {(r.start, r.end): r.hops for r in graph.hops_between(edges, sample).collect()}
    assert got == {k: h for k, h in want.items() if k[0] != k[1]}
    wide = spark.createDataFrame([(i % 40 if i < 40 else 1000 + i, i) for i in range(130)], "node long, i int")  # three words
    assert {(r.start, r.end): r.hops for r in graph.hops_between(edges, wide).collect()} == got


def test_distances_over_a_ring(spark):
    ring = edges_of(spark, [(i, (i + 1) % 5) for i in range(5)])
    row = views.path_lengths(ring, spark.createDataFrame([(i,) for i in range(5)], "x long")).first()
    assert (row.reachable_pairs, row.diameter, row.sample_size) == (20, 5, 5) and row.average_path_length == 3.5
    none = views.path_lengths(ring.where("false"), spark.createDataFrame([(1,)], "x long")).first()
    assert (none.reachable_pairs, none.diameter, none.average_path_length) == (0, 0, 0.0)


def test_forests_of_many_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    for a, b in real:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in real for x in p}
    edges = edges_of(spark, pairs).repartition(7)
    for at_once in (1 << 20, 50):  # the second never fits one task: forests twice, then star steps
        got = forest_components(edges, at_once=at_once).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    texts = edges.selectExpr("cast(src as string) as src", "cast(dst as string) as dst")
    assert len({r.component for r in forest_components(texts).collect()}) == len(set(want.values()))


def test_cycles_stay_inside_strong_components(spark):
    # Two rings joined by layers of three nodes, each layer joined fully to the next: 3 ** 6 ways across, none on a cycle.
    ring = lambda k: [(k, k + 1), (k + 1, k + 2), (k + 2, k)]
    layers = [[100 + 10 * j + i for i in range(3)] for j in range(6)]
    bridge = [(2, x) for x in layers[0]] + [(a, b) for p, q in zip(layers, layers[1:]) for a in p for b in q] + [(x, 50) for x in layers[-1]]
    edges = edges_of(spark, ring(0) + ring(50) + bridge + [(7, 7), (8, 9)])
    strong = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert strong == {0: 2, 1: 2, 2: 2, 50: 52, 51: 52, 52: 52, 7: 7}
    assert sorted(r.cycle for r in graph.cycles(edges).collect()) == [[0, 1, 2], [7], [50, 51, 52]]
    assert graph.cycles(edges_of(spark, [(1, 2), (2, 3)])).count() == 0
    both = edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)])
    assert sorted(r.cycle for r in graph.cycles(both).collect()) == [[1, 2], [1, 2, 3], [3]]
    assert sorted(r.cycle for r in graph.cycles(both, 2).collect()) == [[1, 2], [3]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_go_through_one_shuffle(spark):
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (1, 4)] + [(9, 100 + i) for i in range(25)]
    edges = edges_of(spark, pairs)
    counts = graph.neighbour_counts(edges)
    assert plan_of(counts).count("Exchange") == 1
    assert {(r.node, r.n, r.first) for r in counts.where("node < 10").collect()} == {(1, 2, 2), (2, 1, 1), (3, 1, 3), (4, 1, 1), (9, 25, 100)}
    turned = lambda c: F.concat(F.lit("k"), (1000 - F.col(c)).cast("string"))
    assert {(r.node, r.first) for r in graph.neighbour_counts(edges, turned).where("node in (1, 9)").collect()} == {(1, "k996"), (9, "k876")}
    lists = {(r.node, r.part): r.neighbours for r in graph.neighbour_parts(edges, 10, turned).where("node < 10").collect()}
    assert lists[(1, 0)] == ["k996", "k998"] and [len(lists[(9, p)]) for p in (0, 1, 2)] == [10, 10, 5] and (9, 3) not in lists
    assert lists[(9, 0)] + lists[(9, 1)] + lists[(9, 2)] == sorted(f"k{1000 - 100 - i}" for i in range(25))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_networks_and_their_counts(spark, seed):
    rng = random.Random(seed)
    triples = {(rng.randrange(12), rng.choice(["used", "wasDerivedFrom", "wasDerivedFrom"]), rng.randrange(14)) for _ in range(30)} | {(3, "wasDerivedFrom", 3)}
    edges = spark.createDataFrame([*triples, *list(triples)[:5]], "src long, rel string, dst long")
    nodes, roots = spark.createDataFrame([(i,) for i in range(11)], "id long"), spark.createDataFrame([(i,) for i in range(9)], "id long")
    want = {}
    for root in range(9):
        ids, frontier = {root}, {root}
        for _ in range(2):
            frontier = {s for s, rel, d in triples if rel == "wasDerivedFrom" and d in frontier}
            ids |= frontier
        want[root] = (ids & set(range(11)), {t for t in triples if t[0] in ids or t[2] in ids})
    n, e = graph.network(nodes, edges, roots, 2, up=False)
    assert sorted((r.root, r.id) for r in n.collect()) == sorted((k, i) for k, (ids, _) in want.items() for i in ids)
    assert sorted((r.root, r.src, r.rel, r.dst) for r in e.collect()) == sorted((k, *t) for k, (_, ts) in want.items() for t in ts)
    got = {r.root: (r.nodes, r.edges) for r in graph.network_counts(nodes, edges, roots, 2, up=False).collect()}
    assert got == {k: (len(ids), len(ts)) for k, (ids, ts) in want.items()}


def test_traceability_rows_are_not_shuffled_once_made(spark):
    rows = [("a1", "used", "e1"), ("a1", "used", "e1"), ("a1", "wasAssociatedWith", "g1"), ("a1", "wasAssociatedWith", "g1"), ("a1", "used", "e2")]
    out = lineage.traceability_edges(spark.createDataFrame(rows, "src string, rel string, dst string"))
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert sorted(map(tuple, out.collect())) == sorted((e, s, d, n) for e in ("e1", "e2") for s, d, n in ((e, "a1", "used"), ("a1", "g1", "wasAssociatedWith")))


def test_orphans_where_the_table_has_parts_of_the_lost_keys(spark, tmp_path):
    import duckdb

    sf = "/root/testdata/sf0.001"
    names = ("part", "lineitem", "orders", "supplier", "customer", "nation")
    keys, more = set(), [1_000_000 + r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    while more:  # all that these parts derive from is there
        keys.update(more)
        more = [k for p in more for k in (p // 2, p // 3) if k >= 200 and k not in keys]
    for name in names:
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "part":
            others = spark.createDataFrame([(k,) for k in keys], "p_partkey long").crossJoin(rows.limit(1).drop("p_partkey"))
            rows = rows.unionByName(others.select(rows.columns))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in names:
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["val13_orphans"]).fetchall()
    assert want and sorted(map(tuple, catalogue.queries()["val13_orphans"](spark, str(tmp_path)).collect())) == sorted(want)


def test_first_nodes_by_their_names(spark):
    ring = edges_of(spark, [(i, (i + 1) % 5) for i in range(5)])
    nodes = spark.createDataFrame([(i,) for i in range(5)], "x long")
    row = views.path_lengths(ring, nodes, 2, 1, name=lambda c: (9 - F.col(c)).cast("string")).first()  # the nodes 4 and 3
    assert (row.reachable_pairs, row.diameter, row.sample_size, row.average_path_length) == (2, 5, 2, 3.5)


@pytest.mark.parametrize("depth", [None, 2])
def test_paths_between_grow_from_the_fewer_side(spark, depth):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)})
    edges = edges_of(spark, pairs)

    def plain(path, end):
        if path[-1] == end:
            return [path]
        return [p for a, b in pairs if a == path[-1] and b not in path and (depth is None or len(path) <= depth) for p in plain([*path, b], end)]

    for asked in ([(i, 0) for i in range(9)], [(i, e) for i in range(8) for e in (0, 3)], [(1, i) for i in range(9)]):
        with written() as tables:
            got = graph.paths_between(edges, spark.createDataFrame(asked, "s long, e long"), depth)
            rows = sorted((r.start, r.end, tuple(r.path)) for r in got.collect())
        assert rows == sorted((s, e, tuple(p)) for s, e in asked for p in plain([s], e))
        fewer_ends = len({e for _, e in asked}) < len({s for s, _ in asked})
        assert any("before" in t.columns for t in tables) == fewer_ends


def test_timelines_take_one_closure(spark):
    edges = edges_of(spark, [(2, 1), (3, 2)])
    ents = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "entity_id long, was_generated_by long")
    acts = spark.createDataFrame([(10, 5), (20, 5)], "activity_id long, started_at long")
    with written() as tables:
        r = views.timelines(edges, ents, acts, lambda c: (-F.col(c)).cast("long"))
        assert sorted((x.start, x.position, x.node) for x in r.collect()) == [(1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 2, 1)]
    assert len(tables) == 3  # the edges, one round, and one that found nothing
    chain = views.supply_chains(edges, ents.select("entity_id"), lambda c: (-F.col(c)).cast("long"))
    assert [(x.step, x.node) for x in chain.where("start = 3").orderBy("step").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_paths_are_not_joined_through_the_driver(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("d", "b")], "src string, dst string")
    found = graph.shortest_paths(e, spark.createDataFrame([("a", x) for x in "abcdx"], "start string, end string"))
    assert {(r.end, "".join(r.path), r.hops) for r in found.collect()} == {("a", "a", 0), ("b", "ab", 1), ("c", "ac", 1), ("d", "abd", 2)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_are_not_joined_through_the_driver(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "src long, dst long")
    found = graph.components(spark.range(1, 7), e)
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_component_of_all_nodes_is_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 50, raising=False)
    # Too many edges for one task: forests twice, then star steps.
    monkeypatch.setattr(graph, "forest_components", lambda e: forest_components(e.repartition(8), at_once=20))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = spark.range(0, 3200, 4)
        edges = edges_of(spark, [(4 * i, 0 if i % 3 else 4 * i - 4) for i in range(1, 790)])
        got = catalogue_views.named_components(nodes, edges)
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert got.count() == 800 and got.select("component").distinct().count() == 11 and most < 400
        assert got.where("node = component").count() == 11
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hub_join_leaves_the_rows_of_hubs_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 3)
    rows = spark.createDataFrame([(k, v) for k in (1, 2, None) for v in range(5 - (k or 0) * 2 + 2)], "k long, v long")
    keys = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("m"))
    got = components.hub_join(rows, keys, "k")
    assert sorted((r.k, r.v, r.m) for r in got.collect()) == sorted([(1, v, 4) for v in range(5)] + [(2, v, 2) for v in range(3)])
    assert got.columns == ["k", "v", "m"]


def test_components_of_loops_and_half_edges(spark):
    found = graph.components(spark.range(1, 2), edges_of(spark, [(1, 2), (5, 5), (2, 2), (None, 3), (7, None)]))
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (5, 5), (3, 3), (7, 7), (None, None)}


def test_best_paths_are_written_as_numbers(spark):
    d = "/root/testdata/sf0.001"
    with written() as tables:
        rows = catalogue.flagship(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/part.parquet").count() and all(r.path.startswith(r.start) for r in rows)
    kinds = [dict(t.dtypes) for t in tables]
    assert {k["path"] for k in kinds if "path" in k} == {"array<bigint>"} and not any("entity_id" in k and k["entity_id"] == "string" for k in kinds)


def test_edges_that_no_path_between_the_nodes_asked_for_can_take_are_left_out(spark):
    """A path of four hops over nodes not asked for, with ends that lead nowhere, starts that nothing leads to, a cycle and copies of edges."""
    way = [(0, 1), (1, 2), (2, 3), (3, 4), (3, 1)]
    dead = [(k, 100 + i) for k in range(5) for i in range(20)] + [(200 + i, k) for k in range(5) for i in range(20)]
    some = spark.createDataFrame([(0, 0), (4, 1), (102, 2), (200, 3), (999, 4)], "node long, i long")
    step = spark.createDataFrame(way * 2 + dead, "node long, dst long")
    left = sorted(tuple(r) for r in graph._between(step, some.select("node")).collect())
    assert left == sorted([*way, *((k, 102) for k in range(5)), *((200, k) for k in range(5))])
    got = {tuple(r) for r in graph.hops_between(step.withColumnRenamed("node", "src"), some).collect()}
    assert got == {(0, 4, 4), (0, 102, 1), (200, 4, 1), (200, 0, 1), (200, 102, 2), (4, 102, 1)}


def test_names_of_paths_are_made_once_for_many_paths(spark):
    """Batches are cut by nodes, so a long path is no larger a piece than itself; nothing is left out, and no digest is made a path."""
    paths = spark.range(0, 500, 1, 3).select(F.col("id").alias("start"), F.expr("transform(sequence(0, cast(id % 40 as int)), i -> if(i = 0, id, id div shiftleft(1L, i)))").alias("path"))
    named = graph.path_names(paths, lambda k: f"n{k}", " ", nodes=50)
    want = sorted((f"n{r.start}", " ".join(f"n{k}" for k in r.path)) for r in paths.collect())
    assert sorted(tuple(r) for r in named.collect()) == want and graph.path_names(paths.where("false"), str).count() == 0
    from tracework import catalogue_more

    plan = catalogue_more.gr6_paths_to_origin(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan


def test_kinds_of_edges_are_counted_before_they_meet_their_other_end(spark):
    """Edges with an end that is no node count nothing, edges and nodes that come twice count twice; digests are not needed to count."""
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b")], "id long, type string")
    edges = spark.createDataFrame([(1, "r", 2), (1, "r", 2), (2, "r", 3), (3, "s", 1), (1, "r", 9), (9, "r", 1), (None, "r", 1), (3, "s", 3)], "src long, rel string, dst long")
    got = {tuple(r) for r in graph.edge_kinds(nodes, edges).select("relation", "from_type", "to_type", "n").collect()}
    assert got == {("r", "a", "a", 2), ("r", "b", "a", 2), ("s", "a", "b", 2), ("s", "b", "b", 4)}
    from tracework import catalogue_more

    plan = catalogue_more.gr12_full_graph(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan


def test_lists_of_neighbours_are_named_after_they_are_made(spark):
    """Copies of edges make no part longer, nor a node a hub whose different neighbours fit one part; hubs and others get the same names."""
    pairs = [(1, 2), (1, 4), (3, 1)] + [(9, 100 + i) for i in range(25)] + [(7, 50), (7, 51)] * 9
    edges = spark.createDataFrame([(s, "r", d) for s, d in pairs], "src long, rel string, dst long")
    turned, text = lambda c: F.concat(F.lit("k"), (1000 - F.col(c)).cast("string")), lambda k: f"k{1000 - k}"
    both = [{(r.node, r.rel, r.part): r.neighbours for r in graph.neighbour_parts(edges, 10, turned, *t).collect()} for t in ((), (text,))]
    assert both[0] == both[1] and both[1][(1, "r", 0)] == ["k996", "k997", "k998"] and both[1][(7, "r", 0)] == ["k949", "k950"]
    assert [len(both[1][(9, "r", p)]) for p in (0, 1, 2)] == [10, 10, 5]
    plan = graph.neighbour_parts(edges.where("src < 9"), 100, turned, text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "concat(k" not in plan
    cut = graph._named_lists(spark.range(0, 300, 1, 2).selectExpr("id as node", "'r' as rel", "sequence(id, id + id % 7) as o"), text, nodes=20)
    assert {r.node: r.neighbours for r in cut.collect()} == {k: sorted(text(i) for i in range(k, k + k % 7 + 1)) for k in range(300)}


def test_edges_whose_ends_lie_in_no_set_are_not_looked_up(spark):
    """With nodes that cannot lie in a set, the same edges come out; those between such nodes are in no join, those of one such end in one."""
    rng = random.Random(4)
    derived = {(2 * rng.randrange(9), "wasDerivedFrom", 2 * rng.randrange(9)) for _ in range(20)}
    triples = [*derived, *((rng.randrange(18), "used", rng.randrange(18)) for _ in range(80)), (None, "used", 2), (2, "used", None), (3, None, 2)]
    edges = spark.createDataFrame(triples * 2, "src long, rel string, dst long")
    nodes, roots = spark.createDataFrame([(i,) for i in range(15)], "id long"), spark.createDataFrame([(i,) for i in range(0, 18, 4)], "id long")
    for up, down in ((True, True), (False, True), (True, False)):
        plain, told = (graph.network(nodes, edges, roots, 2, up, down, may=may) for may in (None, lambda c: F.col(c) % 2 == 0))
        for a, b in zip(plain, told):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    e = spark.range(1000).selectExpr("id * 2 + 1 as src", "'used' as rel", "id * 2 + 1 as dst").unionByName(edges)
    with written() as tables:
        graph.network(nodes, e, roots, 2, may=lambda c: F.col(c) % 2 == 0)
        assert all(t.count() < 500 for t in tables)
