"""Explainable confidence of provenance: signals, weighted scores, ranked paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.operators.lineage import relation
from tracework.plans.materialize import materialize

#: Weights of the signals; policy counts only where a weight is given.
WEIGHTS = {
    "entity_present": 0.15, "entity_type": 0.10, "activity_present": 0.25, "agent_present": 0.20,
    "time_start_present": 0.20, "time_order_valid": 0.10, "policy_present": 0.0,
}


def contexts(entities: DataFrame, activities: DataFrame, edges: DataFrame, agents: DataFrame) -> DataFrame:
    """Each entity with what is found of its provenance: activity, times, and whether one of its agents exists."""
    named = relation(edges, "wasAssociatedWith", "activity_id", "agent_id").join(agents.select("agent_id"), "agent_id", "left_semi")
    has_agent = named.select("activity_id").distinct().withColumn("agent", F.lit(True))
    acts = activities.select("activity_id", "started_at", "ended_at").join(has_agent, "activity_id", "left").withColumn("there", F.lit(True))
    return entities.withColumn("activity_id", F.col("was_generated_by")).join(acts, "activity_id", "left")


def signals(found: DataFrame, policy: Column | None = None) -> DataFrame:
    """Signals of each entity: true, false for missing, null for unknown.

    ``found`` is what ``contexts`` gives, or the caller's own rows with
    ``entity_id, entity_type, there, agent, started_at, ended_at``. The agent signal
    is null, not false, where the activity has no agents that exist; the order of
    times is null where one of them is missing. ``policy`` may use any column of ``found``.
    """
    there = F.coalesce("there", F.lit(False))
    return found.select(
        "entity_id",
        F.lit(True).alias("entity_present"),
        F.col("entity_type").isNotNull().alias("entity_type"),
        there.alias("activity_present"),
        F.when(there, F.col("agent")).alias("agent_present"),
        F.when(there, F.col("started_at").isNotNull()).alias("time_start_present"),
        F.when(there, F.col("started_at") <= F.col("ended_at")).alias("time_order_valid"),
        (F.lit(None).cast("boolean") if policy is None else policy).alias("policy_present"),
    )


def evidence(entities: DataFrame, activities: DataFrame, edges: DataFrame, agents: DataFrame, policy: Column | None = None) -> DataFrame:
    """``signals`` of the ``contexts`` of all entities."""
    return signals(contexts(entities, activities, edges, agents), policy)


def score(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``confidence`` (weight of true among known signals, 0 if none), ``missing`` and ``unknown``."""
    w = {**WEIGHTS, **(weights or {})}
    got = sum((F.when(F.col(s), v).otherwise(0.0) for s, v in w.items()), F.lit(0.0))
    of = sum((F.when(F.col(s).isNotNull(), v).otherwise(0.0) for s, v in w.items()), F.lit(0.0))
    listed = [s for s in w if w[s] > 0]
    return signals.select(
        "entity_id",
        *w,
        F.when(of > 0, got / of).otherwise(0.0).alias("confidence"),
        F.array_compact(F.array(*(F.when(~F.col(s), s) for s in listed))).alias("missing"),
        F.array_compact(F.array(*(F.when(F.col(s).isNull(), s) for s in listed))).alias("unknown"),
    )


def derive_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    """``start, path``: paths upward to a node without new parents or to ``max_depth`` nodes.

    Per start the ``max_paths`` smallest are kept. Every open path leads to at
    least one finished one that sorts after it and before its later siblings, so
    keeping that many of the smallest in each round loses none of them.
    """
    # Of a node's parents the smallest suffice: as many as are kept, and as many more as a path may hold already.
    rank = F.row_number().over(W.partitionBy("node").orderBy("parent"))
    parents = edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")).where("parent is not null").distinct()
    parents = parents.withColumn("r", rank).where(F.col("r") <= max_paths + max_depth)
    step = materialize(parents.groupBy("node").agg(F.array_sort(F.collect_list("parent")).alias("parents")))
    rows = starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.array("start").alias("path"), F.lit(False).alias("done"))
    for _ in range(max_depth - 1):
        open_ = rows.where("not done").withColumn("node", F.element_at("path", -1)).join(step, "node", "left")
        free = F.coalesce(F.filter("parents", lambda p: ~F.array_contains("path", p)), F.expr("slice(path, 1, 0)"))
        ended = F.array(F.struct(F.col("path").alias("path"), F.lit(True).alias("done")))
        on = F.transform("free", lambda p: F.struct(F.concat("path", F.array(p)).alias("path"), F.lit(False).alias("done")))
        moved = open_.withColumn("free", free).select("start", F.explode(F.when(F.size("free") == 0, ended).otherwise(on)).alias("x")).select("start", "x.*")
        every = rows.where("done").unionByName(moved)
        order = F.row_number().over(W.partitionBy("start").orderBy("path"))
        rows = materialize(every.withColumn("r", order).where(F.col("r") <= max_paths).drop("r"))
    return rows.select("start", "path")


def best_paths(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """Confidence of each path (mean of its hops) and its rank among the start's paths."""
    hops = paths.withColumn("entity_id", F.explode("path")).join(scores.select("entity_id", "confidence"), "entity_id", "left")
    mean = hops.groupBy("start", "path").agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 9).alias("confidence"))
    return mean.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy(F.desc("confidence"), "path")))
