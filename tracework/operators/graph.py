"""Traversals and graph statistics. ``edges``: ``src`` derived, ``dst`` source."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.operators.components import forest_components
from tracework.operators.ranges import running
from tracework.plans.materialize import drop, materialize


def neighbours(edges: DataFrame) -> DataFrame:
    """``node, rel, neighbours`` (sorted, distinct), both directions."""
    both = edges.select(F.col("src").alias("node"), "rel", F.col("dst").alias("o")).unionByName(
        edges.select(F.col("dst").alias("node"), "rel", F.col("src").alias("o"))
    )
    return both.groupBy("node", "rel").agg(F.array_sort(F.collect_set("o")).alias("neighbours"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """``node, rel, o``: neighbours in both directions, as often as edges say it."""
    return edges.select(F.col("src").alias("node"), "rel", F.col("dst").alias("o")).unionByName(
        edges.select(F.col("dst").alias("node"), "rel", F.col("src").alias("o"))
    )


def _near(edges: DataFrame) -> DataFrame:
    """``node, rel, o``: neighbours in both directions, each once; rows of one node and relation lie in one partition, in one shuffle."""
    return _both_ways(edges).repartition("node", "rel").distinct()


def neighbour_counts(edges: DataFrame, name: Callable[[str], Column] = F.col) -> DataFrame:
    """``node, rel, n, first``: how many different neighbours, and the least by ``name``, both directions; a hub's list is never held."""
    return _near(edges).groupBy("node", "rel").agg(F.count(F.lit(1)).alias("n"), F.min(name("o")).alias("first"))


def neighbour_parts(edges: DataFrame, size: int = 1000, name: Callable[[str], Column] = F.col, text: Callable[[int], str] | None = None) -> DataFrame:
    """``node, rel, part, neighbours``: sorted distinct neighbours (by ``name``) in both directions, ``size`` to a part; a hub's list is never in one row.

    Only nodes that more than ``size`` edges say to be neighbours are numbered by ranges; the lists of all others are
    one row each, and their rows are shuffled once. With ``text``, what ``name`` gives for one node, names are made
    by Arrow in tasks after the lists, so what is shuffled, sorted and spilled is as narrow as the nodes.
    """
    both = _both_ways(edges)
    many = materialize(both.groupBy("node", "rel").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > size).select("node", "rel"))
    line = lambda rows, *by: rows.groupBy("node", "rel", *by).agg(F.array_sort(F.collect_set("o")).alias("neighbours"))
    hubs = not many.isEmpty()
    few = (both.join(many, ["node", "rel"], "left_anti") if hubs else both).repartition("node", "rel")
    few = line(few.withColumn("o", name("o"))) if text is None else _named_lists(few.groupBy("node", "rel").agg(F.collect_set("o").alias("o")), text)
    few = few.select("node", "rel", F.lit(0).cast("long").alias("part"), "neighbours")
    if not hubs:
        return few
    near = both.join(many, ["node", "rel"], "left_semi").distinct().withColumn("o", name("o"))
    return few.unionByName(line(running(near, ["node", "rel"], ["o"]), F.expr(f"(n - 1) div {size}").alias("part")))


def _named_lists(lists: DataFrame, text: Callable[[int], str], nodes: int = 1 << 20) -> DataFrame:
    """``node, rel, neighbours`` of lists ``node, rel, o``: the names of the nodes in each, sorted; at most ``nodes`` of them, or one list, at once."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            step = max(1, nodes * len(batch) // max(1, len(batch.column("o").flatten())))
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                codes = some.column("o").flatten().dictionary_encode()
                names = pa.array([text(k) for k in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
                sizes = pc.list_value_length(some.column("o")).to_numpy()
                order = pc.sort_indices(pa.table({"of": np.repeat(np.arange(len(some)), sizes), "name": names}), sort_keys=[("of", "ascending"), ("name", "ascending")])
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("rel"), pa.ListArray.from_arrays(ends, names.take(order))], names=["node", "rel", "neighbours"])

    kinds = dict(lists.dtypes)
    return lists.select("node", "rel", "o").mapInArrow(rows, f"node {kinds['node']}, rel {kinds['rel']}, neighbours array<string>")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, node, hops``: what each node reaches along ``src -> dst``, by fewest hops (``max_depth`` at most, if given).

    Rounds double the length: whatever is farther than ``2 ** k`` hops is reached
    over a node at exactly that distance, so pairs of exactly ``2 ** k`` hops meet
    all pairs known, and every pair is made by few meetings. A round is written
    once and stays part of the result; there are as many as the greatest distance
    has bits. A node is its own relative only if a cycle leads back to it.
    """
    known = materialize(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).where("start is not null and node is not null").distinct().withColumn("hops", F.lit(1)))
    length = 1
    while max_depth is None or length < max_depth:
        far = known.where(F.col("hops") == length).select("start", F.col("node").alias("over"))
        on = known.select(F.col("start").alias("over"), "node", (F.col("hops") + length).alias("hops"))
        if max_depth is not None:
            on = on.where(F.col("hops") <= max_depth)
        new = far.join(on, "over").groupBy("start", "node").agg(F.min("hops").alias("hops")).join(known, ["start", "node"], "left_anti")
        new = materialize(new)
        if new.isEmpty():
            drop(new)
            break
        known, length = known.unionByName(new), 2 * length
    return known


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, few: bool = False, rounds: int = 10_000) -> DataFrame:
    """``start, node, hops``: what each start reaches along ``src -> dst``, by fewest hops.

    By ``closure``, of which the starts keep their part. With ``few`` starts in a
    large graph a frontier goes on from them instead, hop by hop: each round joins
    it with the edges and keeps pairs not reached before, so cycles end.
    """
    first = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    if not few:
        return closure(edges, max_depth).join(first, "start", "left_semi")
    step = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = first.withColumn("node", F.col("start"))
    done = None
    for hops in range(1, (max_depth if max_depth is not None else rounds) + 1):
        new = frontier.join(step, frontier["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        if done is not None:
            new = new.join(done, ["start", "node"], "left_anti")
        new = materialize(new.withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            break
        done = new if done is None else done.unionByName(new)
        frontier = new.select("start", "node")
    else:
        if max_depth is None:
            raise RuntimeError(f"no end after {rounds} rounds")
    drop(step)
    if done is None:
        return first.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).where("false")
    return done


def _between(step: DataFrame, some: DataFrame) -> DataFrame:
    """The edges ``node, dst``, each once, that a path between two of ``some`` (``node``) can take, as far as the ends of an edge tell.

    A path goes on from every node but its last, and came to every node but its
    first: edges to a node that leads nowhere, or from one that nothing leads to, are left out.
    """
    on = step.select("node").unionByName(some).distinct().withColumnRenamed("node", "dst").hint("shuffle_hash")
    back = step.select(F.col("dst").alias("node")).unionByName(some).distinct().hint("shuffle_hash")
    # Inner joins with distinct keys: semijoins would be taken apart and done for each part of a union.
    return step.join(on, "dst").join(back, "node").select("node", "dst").distinct()


def hops_between(edges: DataFrame, some: DataFrame) -> DataFrame:
    """``start, end, hops`` for all pairs of a sample of nodes (``node``, ``i`` from 0, at most a few hundred): the fewest hops along ``src -> dst``.

    Each node carries one bitmap of the sources that have reached it, as words of
    60 bits; a round is one ``bit_or`` over the frontier's edges, whatever the
    number of sources.
    """
    size = int(some.agg(F.max("i")).first()[0] or 0) + 1
    words = [f"w{k}" for k in range(-(-size // 60))]
    step = materialize(_between(edges.select(F.col("src").alias("node"), "dst").where("node is not null and dst is not null"), some.select("node")))
    bit = lambda k: F.when(F.expr(f"i div 60 = {k}"), F.expr("shiftleft(1L, cast(i % 60 as int))")).otherwise(0)
    frontier = materialize(some.select("node", *(bit(k).cast("long").alias(w) for k, w in enumerate(words))))
    seen, last, out = frontier, frontier, None
    for hops in count(1):
        met = frontier.join(step, "node").groupBy(F.col("dst").alias("node")).agg(*(F.bit_or(w).alias(w) for w in words))
        old = seen.select("node", *(F.col(w).alias(f"old_{w}") for w in words))
        both = met.join(old, "node", "full").select("node", *(F.coalesce(w, F.lit(0)).alias(w) for w in words), *(F.coalesce(f"old_{w}", F.lit(0)).alias(f"old_{w}") for w in words))
        new = [F.col(w).bitwiseAND(F.bitwise_not(F.col(f"old_{w}"))).alias(w) for w in words]
        both = materialize(both.select("node", *new, *(F.col(w).bitwiseOR(F.col(f"old_{w}")).alias(f"all_{w}") for w in words)))
        some_new = " or ".join(f"{w} != 0" for w in words)
        fresh = both.where(some_new).select("node", *words)
        if fresh.isEmpty():
            break
        hit = materialize(fresh.join(some.select("node", F.col("i").alias("end")), "node").withColumn("hops", F.lit(hops)), 0)  # the sample's own rows at most
        out = hit if out is None else out.unionByName(hit)
        drop(last)
        frontier, last = fresh, both
        seen = both.select("node", *(F.col(f"all_{w}").alias(w) for w in words))
    if out is None:
        return some.select(F.col("node").alias("start"), F.col("node").alias("end"), F.lit(0).alias("hops")).where("false")
    starts = some.select(F.col("node").alias("start"), "i")
    at = F.expr("case " + " ".join(f"when i div 60 = {k} then {w}" for k, w in enumerate(words)) + " end")
    pairs = out.select(F.col("node").alias("end"), "hops", *words).crossJoin(F.broadcast(starts))  # sources, a few hundred, beside the sample's rows
    return pairs.where(at.bitwiseAND(F.expr("shiftleft(1L, cast(i % 60 as int))")) != 0).select("start", "end", "hops")


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, few: bool = False) -> DataFrame:
    return reach(edges, starts, max_depth, few)


def descendants(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, few: bool = False) -> DataFrame:
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, max_depth, few)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``start, end, path, nodes, hops``: the smallest of the shortest paths from start down to end.

    ``pairs`` has start and end. A pair of one node is its own path; pairs
    without a path (of ``max_hops`` at most, if given) give no row. Only the smallest path to a node stays in each
    round, which keeps the smallest path to every later node too.

    Files of paths are much smaller than their rows, as paths begin alike, so joins
    are asked to shuffle: by the size of its files a table would go through the driver.
    """
    step = materialize(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()).hint("merge")
    pairs = materialize(pairs.select("start", "end").distinct()).hint("merge")
    frontier = materialize(
        pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    )
    done = frontier
    for _ in count() if max_hops is None else range(max_hops):
        new = (
            frontier.join(step, "node")
            .select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
            .groupBy("start", "node")
            .agg(F.min("path").alias("path"))
            .join(done.select("start", "node").hint("merge"), ["start", "node"], "left_anti")
        )
        new = materialize(new.select("start", "node", "path"))
        if new.isEmpty():
            break
        done, frontier = done.unionByName(new), new
        open_ = pairs.join(done.select("start", F.col("node").alias("end")).hint("merge"), ["start", "end"], "left_anti")
        if open_.isEmpty():
            break
    return pairs.join(done.withColumnRenamed("node", "end").hint("merge"), ["start", "end"]).select(
        "start", "end", "path", F.size("path").alias("nodes"), (F.size("path") - 1).alias("hops")
    )


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """``start, path``: all simple paths from each start along ``src -> dst`` of 1 to ``max_depth`` hops.

    Every round is written to the shared folder; their number is not bounded but by the depth.
    """
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    frontier = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumns(
        {"node": F.col("start"), "path": F.array("start")}
    )
    out = None
    for _ in range(max_depth):
        new = frontier.join(step, "node").where(~F.array_contains("path", F.col("dst")))
        new = materialize(new.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if new.isEmpty():
            break
        out = new if out is None else out.unionByName(new)
        frontier = new
    return (frontier.where("false") if out is None else out).select("start", "path")


def paths_between(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, end, path``: all simple paths along ``src -> dst`` from start to end (first two columns of ``pairs``).

    A path grows only over nodes from which its end can be reached. A pair of one
    node is its own path, and only that. Without ``max_depth`` (hops), the rounds
    go on until no path is open; a graph with many cycles has very many paths.
    Where there are fewer ends than starts, paths grow from the ends, so what many
    starts share is written once.
    """
    step = materialize(edges.select(F.col("src").alias("node"), "dst").where("src is not null and dst is not null").distinct())
    pairs = materialize(pairs.select(F.col(pairs.columns[0]).alias("start"), F.col(pairs.columns[1]).alias("end")).distinct())
    ends = pairs.select("end").distinct()
    if ends.count() < pairs.select("start").distinct().count():
        return _paths_from_ends(step, pairs, max_depth)
    leads = descendants(edges, ends, few=True).select(F.col("start").alias("end"), "node")
    leads = materialize(leads.unionByName(ends.select("end", F.col("end").alias("node"))).distinct())
    own = pairs.where("start = end").select("start", "end", F.array("start").alias("path"))
    frontier = pairs.where("start != end").withColumns({"node": F.col("start"), "path": F.array("start")})
    out = own
    for _ in count() if max_depth is None else range(max_depth):
        new = frontier.join(step, "node").where(~F.array_contains("path", F.col("dst")))
        new = new.select("start", "end", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = materialize(new.join(leads, ["end", "node"], "left_semi").select("start", "end", "node", "path"))
        if new.isEmpty():
            break
        out = out.unionByName(new.where("node = end").select("start", "end", "path"))
        frontier = new.where("node != end")
    return out


def network(
    nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, up: bool = True, down: bool = True, may: Callable[[str], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes ``root, id, ...`` within ``depth`` derivations of each root, and the edges ``root, src, rel, dst`` that touch them.

    ``up`` alone is the provenance graph of a root, ``down`` alone its subgraph,
    both its network. Edges are those of any relation with an end in the set.
    ``may`` tells by a node alone whether a root, or what derives or is derived from
    one, can be such a node: an end that cannot lie in a set is not looked up.
    """
    ids = _around(edges, roots, depth, up, down)
    can = lambda c: F.coalesce(may(c), F.lit(False))
    every = edges.select("src", "rel", "dst")
    once = every.distinct() if may is None else materialize(every.where(can("src")).distinct())
    touch = lambda e, c: e.join(ids.withColumnRenamed("id", c), c).select("root", "src", "rel", "dst")
    # An edge is found twice only if both of its ends lie in some set; the others need no look at the rows found.
    some = ids.select(F.col("id").alias("src")).distinct().withColumn("_inner", F.lit(True))
    marked = (once if may is None else once.where(can("dst"))).join(some, "src", "left")
    inner = touch(marked.where("_inner"), "dst").join(ids.withColumnRenamed("id", "src"), ["root", "src"], "left_anti").select("root", "src", "rel", "dst")
    found = touch(once, "src").unionByName(touch(marked.where("_inner is null"), "dst")).unionByName(inner)
    if may is not None:
        found = found.unionByName(touch(every.where(~can("src") & can("dst")).distinct(), "dst"))
    return ids.join(nodes, "id").select("root", *nodes.columns), found


def network_counts(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, up: bool = True, down: bool = True) -> DataFrame:
    """``root, nodes, edges``: how many of each ``network`` has, without its rows: a node's edges are counted once, and those with both ends in a set taken off once."""
    ids = _around(edges, roots, depth, up, down)
    once = edges.select("src", "rel", "dst").distinct()
    own = once.select(F.col("src").alias("id")).unionByName(once.where("src != dst").select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    there = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("m"))  # as many rows as a join with the nodes gives
    some = ids.select("id").distinct()
    pairs = once.where("src != dst").join(some.withColumnRenamed("id", "src"), "src", "left_semi").join(some.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    both = ids.withColumnRenamed("id", "src").join(pairs, "src").join(ids.withColumnRenamed("id", "dst"), ["root", "dst"]).groupBy("root").agg(F.sum("k").alias("twice"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = ids.join(own, "id", "left").join(there, "id", "left").groupBy("root").agg(F.sum(zero("m")).alias("nodes"), F.sum(zero("n")).alias("ends"))
    return per.where("nodes > 0").join(both, "root", "left").select("root", "nodes", (F.col("ends") - zero("twice")).alias("edges"))


def _paths_from_ends(step: DataFrame, pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """``paths_between`` from the ends on, over nodes that a start of the end reaches. ``step``: node, dst."""
    leads = frontier = pairs.select("end", F.col("start").alias("node"))
    while True:
        new = frontier.join(step, "node").select("end", F.col("dst").alias("node")).distinct().join(leads, ["end", "node"], "left_anti")
        new = materialize(new.select("end", "node"))
        if new.isEmpty():
            break
        leads, frontier = leads.unionByName(new), new
    asked = pairs.where("start != end").select("end", F.col("start").alias("node"), F.lit(True).alias("asked"))
    leads = leads.join(asked, ["end", "node"], "left").select("end", F.col("node").alias("before"), "asked")
    every = materialize(step.select(F.col("node").alias("before"), F.col("dst").alias("node")).join(leads, "before").select("end", "node", "before", "asked"))
    # Paths to nodes that nothing comes before are done: they are not moved again.
    on = every.select("end", F.col("node").alias("before")).distinct().withColumn("on", F.lit(True))
    way = materialize(every.join(on, ["end", "before"], "left").select("end", "node", "before", "asked", "on"))
    drop(every)
    out = pairs.where("start = end").select("start", "end", F.array("start").alias("path"))
    frontier = pairs.select("end").distinct().select("end", F.col("end").alias("node"), F.array("end").alias("path"))
    for _ in count() if max_depth is None else range(max_depth):
        new = frontier.join(way, ["end", "node"]).where(~F.array_contains("path", F.col("before")))
        new = materialize(new.select("end", F.col("before").alias("node"), F.concat(F.array("before"), F.col("path")).alias("path"), "asked", "on"))
        if new.isEmpty():
            break
        out = out.unionByName(new.where("asked").select(F.col("node").alias("start"), "end", "path"))
        frontier = new.where("on").select("end", "node", "path")
    return out


def _around(edges: DataFrame, roots: DataFrame, depth: int, up: bool, down: bool) -> DataFrame:
    """``root, id``: the roots and what lies within ``depth`` derivations of each, written once."""
    derived = edges.where("rel = 'wasDerivedFrom'").select("src", "dst")
    first = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    ids = first.select("root", F.col("root").alias("id"))
    for walk in [w for w, on in ((ancestors, up), (descendants, down)) if on]:
        ids = ids.unionByName(walk(derived, first, depth).select(F.col("start").alias("root"), F.col("node").alias("id")))
    return materialize(ids.distinct())


def knowledge_graph(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, type`` and edges ``from, to, relation`` of the given ids and what touches them; of all without ids.

    Labels fall back on the id. Edges go from source to derived, as the views show them.
    """
    if ids is not None:
        key = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        nodes = nodes.join(key, "id", "left_semi")
        either = edges.join(key.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(key.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns))
        edges = either.distinct()
    return nodes.select("id", F.coalesce("label", "id").alias("label"), "type"), edges.select(
        F.col("dst").alias("from"), F.col("src").alias("to"), F.col("rel").alias("relation")
    )


def edge_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``relation, from_type, to_type, n``: how many edges (``src, rel, dst``, from source to derived as the views show them) lie between nodes (``id, type``) of which types.

    Edges meet the types at ``src`` first and are counted by what they share, so only counts meet those at ``dst``.
    """
    kind = lambda c, name: nodes.select(F.col("id").alias(c), F.col("type").alias(name)).hint("shuffle_hash")
    one = edges.join(kind("src", "to_type"), "src").groupBy("dst", "rel", "to_type").agg(F.count(F.lit(1)).alias("n"))
    both = one.join(kind("dst", "from_type"), "dst").groupBy(F.col("rel").alias("relation"), "from_type", "to_type")
    return both.agg(F.sum("n").alias("n"))


def one_hop(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``root, id, label, type`` and edges ``root, source, target, label, id`` of each root and its neighbours that exist, each once."""
    first = roots.select(F.col(roots.columns[0]).alias("root")).distinct().join(nodes.select(F.col("id").alias("root")), "root", "left_semi")
    both = edges.select(F.col("src").alias("root"), "rel", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("root"), "rel", F.col("src").alias("other")))
    near = both.join(first, "root", "left_semi").join(nodes.select(F.col("id").alias("other")), "other", "left_semi").distinct()
    ids = first.select("root", F.col("root").alias("id")).unionByName(near.select("root", F.col("other").alias("id"))).distinct()
    return ids.join(nodes, "id").select("root", "id", "label", "type"), near.select(
        "root", F.col("root").alias("source"), F.col("other").alias("target"), F.col("rel").alias("label"), F.concat_ws("-", "root", "other", "rel").alias("id")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes (first column of ``nodes``) and ends of edges; lone nodes are components."""
    found = forest_components(edges)
    loops = edges.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))  # no others have ends that are not found
    every = (
        nodes.select(F.col(nodes.columns[0]).alias("node"))
        .unionByName(loops.select(F.col("src").alias("node")))
        .unionByName(loops.select(F.col("dst").alias("node")))
        .distinct()
    )
    lone = every.join(found.select("node").hint("merge"), "node", "left_anti")
    return found.unionByName(lone.select("node", F.col("node").alias("component")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree``: ends of edges at each node, 0 for lone nodes."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    count = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return (
        nodes.select(F.col(nodes.columns[0]).alias("node"))
        .join(count, "node", "left")
        .select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    )


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average and greatest degree, density (null below two nodes)."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("nodes")
    return d.crossJoin(e).select(  # two rows of totals
        "nodes",
        "edges",
        "max_degree",
        F.when(n > 0, 2 * F.col("edges") / n).alias("average_degree"),
        F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).alias("density"),
    )


def critical_nodes(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of greatest degree, ties by id."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "node").limit(k)


def cyclic_core(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Edges left after taking away, again and again, nodes without a way in or out."""
    e = materialize(edges.select("src", "dst").distinct())
    n = e.count()
    for _ in range(rounds):
        kept = materialize(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
                e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
            )
        )
        m = kept.count()
        if m == n:
            return kept.select("src", "dst")
        e, n = kept, m
    raise RuntimeError(f"no end after {rounds} rounds")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes that lie on cycles: the greatest node of each strongly connected component.

    Forward and backward colouring: in the edges left by ``cyclic_core`` each node
    takes the greatest node that leads to it; of the nodes of one colour, those that
    lead back to the node the colour is named after are its component. They go, and
    the rest is coloured anew. Every step is linear in the edges left.
    """
    left, out = cyclic_core(edges), None
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = materialize(ends.withColumn("colour", F.col("node")))
        while True:
            into = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("more"))
            new = materialize(colour.join(into, "node", "left").select("node", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            drop(colour)
            colour = new.select("node", "colour")
            if not moved:
                break
        one = left.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c")
        one = materialize(one)
        found = frontier = materialize(colour.where("node = colour"))
        while not frontier.isEmpty():
            back = one.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), F.col("c").alias("colour")).distinct()
            frontier = materialize(back.join(found, "node", "left_anti"))
            found = found.unionByName(frontier)
        found = materialize(found)
        out = found if out is None else out.unionByName(found)
        rest = left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = cyclic_core(rest)
    alone = edges.where("src = dst").select(F.col("src").alias("node"))
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    # A component of one node lies on a cycle only if that node is its own neighbour.
    many = out.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
    kept = out.join(many, "colour", "left_semi").select("node", "colour").unionByName(out.join(alone, "node", "left_semi").select("node", "colour"))
    return kept.distinct().withColumnRenamed("colour", "component")


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """``cycle``: simple cycles (of ``max_length`` nodes at most, if given), from the smallest id on, each once.

    Paths are followed inside strongly connected components only: what lies between two cycles costs nothing.
    """
    own = materialize(strong_components(edges))
    inside = edges.select("src", "dst").distinct().join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a = b")
    core = materialize(inside.select("src", "dst"))
    step = core.select(F.col("src").alias("node"), "dst")
    loops = core.where("src = dst").select(F.array("src").alias("cycle"))
    frontier = core.select("src").distinct().select(F.col("src").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"))
    out = loops
    for _ in count() if max_length is None else range(max_length - 1):  # a cycle starts at its smallest node, so paths stay above it
        frontier = materialize(
            frontier.join(step, "node")
            .where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            .select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        )
        if frontier.isEmpty():
            break
        back = core.select(F.col("src").alias("node"), F.col("dst").alias("start"))
        out = out.unionByName(frontier.join(back, ["node", "start"]).select(F.col("path").alias("cycle")))
    return out.distinct()


def path_text(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """``path_id, text``: labels (node, label) of a path joined by arrows, in order; ids where no label is given."""
    at = paths.select("path_id", F.posexplode("path").alias("pos", "node")).join(labels, "node", "left")
    return at.groupBy("path_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "node").alias("label")))), lambda x: x["label"]
            ),
            " -> ",
        ).alias("text")
    )


def path_names(paths: DataFrame, name: Callable[[int], str], between: str = ">", nodes: int = 1 << 20) -> DataFrame:
    """``start, path``: paths of numbers (``path``, from its start on) as text: names of the nodes joined by ``between``.

    By Arrow in tasks: paths of a batch share most of their nodes, and a node's name
    is made once for all of them. At most ``nodes`` nodes, or one path, are turned into text at once.
    """

    def rows(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column(0)
            step = max(1, nodes * len(lists) // max(1, len(lists.flatten())))
            for at in range(0, len(lists), step):
                some = lists.slice(at, step)
                codes = some.flatten().dictionary_encode()
                names = pa.array([name(k) for k in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
                ends = pc.subtract(some.offsets, some.offsets[0])
                texts = pc.binary_join(pa.ListArray.from_arrays(ends, names), between)
                yield pa.RecordBatch.from_arrays([names.take(ends[:-1]), texts], names=["start", "path"])

    return paths.select("path").mapInArrow(rows, "start string, path string")


def path_edges(paths: DataFrame) -> DataFrame:
    """``src, dst``: neighbours in the paths, each pair once."""
    at = paths.select("path_id", F.posexplode("path").alias("pos", "src"))
    nxt = F.lead("src").over(W.partitionBy("path_id").orderBy("pos"))
    return at.withColumn("dst", nxt).where("dst is not null").select("src", "dst").distinct()
