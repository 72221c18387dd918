"""Views of the graph for display: subgraphs, chains, timelines, statistics, element rows and DOT lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.operators import graph
from tracework.plans.materialize import materialize


def subgraphs(edges: DataFrame, roots: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes ``root, node`` and edges ``root, src, dst`` around each root: ancestors, descendants and itself."""
    roots = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    nodes = roots.select("root", F.col("root").alias("node"))
    if depth > 0:
        for walk in (graph.ancestors, graph.descendants):
            nodes = nodes.unionByName(walk(edges, roots, depth).select(F.col("start").alias("root"), "node"))
    nodes = materialize(nodes.distinct())
    inside = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src")
    return nodes, inside.join(nodes.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi").select("root", "src", "dst")


def supply_chains(edges: DataFrame, entities: DataFrame, name: Callable[[str], Column] = F.col) -> DataFrame:
    """``start, step, node``: from the farthest origin to the entity itself, equal distances by id (by ``name``, made after the shuffle)."""
    first = entities.select(F.col(entities.columns[0]).alias("start"))
    rows = graph.ancestors(edges, first).unionByName(first.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")))
    step = F.row_number().over(W.partitionBy("start").orderBy(F.desc("hops"), name("node")))
    return rows.repartition("start").select("start", step.alias("step"), "node", "hops")


def timelines(edges: DataFrame, entities: DataFrame, activities: DataFrame, name: Callable[[str], Column] = F.col) -> DataFrame:
    """``start, position, node, started_at``: relatives of each entity by the start of what generated them, then by ``name``.

    Descendants are the ancestors' pairs turned round, so one closure serves both.
    """
    first = entities.select(F.col("entity_id").alias("start"))
    up = graph.closure(edges).select("start", "node")
    both = up.unionByName(up.select(F.col("node").alias("start"), F.col("start").alias("node")))
    related = both.join(first.distinct(), "start", "left_semi").distinct()
    when = entities.select(F.col("entity_id").alias("node"), F.col("was_generated_by").alias("activity_id")).join(activities.select("activity_id", "started_at"), "activity_id")
    position = F.row_number().over(W.partitionBy("start").orderBy("started_at", name("node")))
    return related.join(when.select("node", "started_at"), "node").repartition("start").select("start", position.alias("position"), "node", "started_at")


def path_lengths(edges: DataFrame, nodes: DataFrame, sample: int = 100, targets: int = 50, name: Callable[[str], Column] = F.col) -> DataFrame:
    """One row: mean and greatest shortest path in nodes among the first ``sample`` ids (by ``name``) of any class, each with its first ``targets`` others.

    Paths lead from sources to what derives from them, over all edges given.
    """
    # Names are made once a node: an order by an expression makes both anew for every comparison.
    some = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("_name", name("node")).orderBy("_name").limit(sample)
    some = materialize(some.select("node", F.row_number().over(W.orderBy("_name")).alias("i")), 0)  # at most ``sample`` rows
    end = some.select(F.col("node").alias("end"), F.col("i").alias("j"))
    pairs = some.join(F.broadcast(end), F.col("i") != F.col("j")).where(F.col("j") <= F.when(F.col("i") <= targets, targets + 1).otherwise(targets))
    hops = graph.hops_between(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), some.select("node", (F.col("i") - 1).alias("i")))
    found = pairs.join(hops.withColumnRenamed("start", "node"), ["node", "end"]).agg(
        F.count(F.lit(1)).alias("reachable_pairs"), F.round(F.coalesce(F.avg(F.col("hops") + 1), F.lit(0.0)), 6).alias("average_path_length"),
        F.coalesce(F.max(F.col("hops") + 1), F.lit(0)).alias("diameter"),
    )
    return found.crossJoin(some.agg(F.count(F.lit(1)).alias("sample_size")))  # one row each


def kg_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``measure, name, value``: counts, nodes by type, edges by relation, greatest and average degree."""
    total = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))  # one row each
    ends = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    row = lambda df, measure, name, value: df.select(F.lit(measure).alias("measure"), name.alias("name"), value.cast("double").alias("value"))
    none = F.lit("")
    return (
        row(total, "nodes", none, F.col("n"))
        .unionByName(row(total, "edges", none, F.col("m")))
        .unionByName(row(total, "average degree", none, F.round(F.when(F.col("n") > 0, 2 * F.col("m") / F.col("n")).otherwise(0), 6)))
        .unionByName(row(ends.agg(F.coalesce(F.max("d"), F.lit(0)).alias("d")), "greatest degree", none, F.col("d")))
        .unionByName(row(nodes.groupBy("type").count(), "node type", F.col("type"), F.col("count")))
        .unionByName(row(edges.groupBy("rel").count(), "relation", F.col("rel"), F.col("count")))
    )


def analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, and whether the graph is connected."""
    c = graph.components(nodes, edges).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("components"))
    return c.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).withColumn("connected", F.col("components") <= 1)  # one row each


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: one JSON text for each node (id, label, type) and each link (id, source, target, label)."""
    n = nodes.select(F.to_json(F.struct("id", "label", "type")).alias("value"))
    key = F.concat_ws("-", "src", "dst", "rel").alias("id")
    return n.unionByName(edges.select(F.to_json(F.struct(key, F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("label"))).alias("value")))


#: Shape and colour of each type of node in the hierarchical form.
SHAPES = {"entity": ("ellipse", "#C8E6C9"), "activity": ("box", "#BBDEFB"), "agent": ("diamond", "#FFE0B2")}


def dot(nodes: DataFrame, edges: DataFrame, form: str = "plain", centre: str | None = None) -> DataFrame:
    """``part, value``: lines of a DOT digraph, in order of ``part``; nodes and edges in any order within it.

    ``form``: plain, hierarchical (from top to bottom, shapes by type) or radial
    (circles, the centre doubled).
    """
    spark = nodes.sparkSession
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = {"plain": ["digraph G {"], "hierarchical": ["digraph SupplyChain {", "  rankdir=TB;"], "radial": ["digraph RadialGraph {", "  rankdir=LR;"]}[form]
    ends = spark.createDataFrame([(0, line) for line in head] + [(3, "}")], "part int, value string")
    more = F.lit("")
    if form == "hierarchical":
        pick = lambda i, default: F.coalesce(*(F.when(F.col("type") == t, v[i]) for t, v in SHAPES.items()), F.lit(default))
        more = F.concat(F.lit(" shape="), pick(0, "box"), F.lit(" fillcolor="), quote(pick(1, "#EEEEEE")), F.lit(" style=filled"))
    elif form == "radial":
        more = F.when(F.col("id") == centre, " shape=doublecircle fontsize=14").otherwise(" shape=circle fontsize=10")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.coalesce("label", F.lit(""))), more, F.lit("];")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("rel")), F.lit("];")).alias("value"))
    return ends.unionByName(n).unionByName(e)
