"""Lineage joins over entities, activities, agents and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relation(edges: DataFrame, rel: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst))


def provenance(entities: DataFrame, activities: DataFrame, agents: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with its generating activity, the activity's start, and its agents."""
    return (
        entities.select("entity_id")
        .join(relation(edges, "wasGeneratedBy", "entity_id", "activity_id"), "entity_id")
        .join(activities.select("activity_id", "started_at"), "activity_id")
        .join(relation(edges, "wasAssociatedWith", "activity_id", "agent_id"), "activity_id")
        .join(agents.select("agent_id"), "agent_id")
        .select("entity_id", "activity_id", "agent_id", "started_at")
        .distinct()
    )


def derivations(edges: DataFrame) -> DataFrame:
    """``entity_id, derived_id``: what derives directly from an entity."""
    return relation(edges, "wasDerivedFrom", "derived_id", "entity_id").select("entity_id", "derived_id").distinct()


def usage_chain(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_id, activity_id, started_at, agent_id`` for every use of an entity."""
    return (
        relation(edges, "used", "activity_id", "entity_id")
        .join(activities.select("activity_id", "started_at"), "activity_id")
        .join(relation(edges, "wasAssociatedWith", "activity_id", "agent_id"), "activity_id")
        .select("entity_id", "activity_id", "started_at", "agent_id")
    )


def agent_activities(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """``agent_id, activity_id, started_at``."""
    return (
        relation(edges, "wasAssociatedWith", "activity_id", "agent_id")
        .join(activities.select("activity_id", "started_at"), "activity_id")
        .select("agent_id", "activity_id", "started_at")
    )


def product_history(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """Uses of each entity in order of time, numbered from 1; place ``unknown`` where none is given."""
    rows = relation(edges, "used", "activity_id", "entity_id").join(
        activities.select("activity_id", "activity_type", "started_at"), "activity_id"
    )
    step = F.row_number().over(W.partitionBy("entity_id").orderBy("started_at", "activity_id"))
    return rows.select(
        "entity_id", step.alias("step"), "activity_id", "activity_type", F.lit("unknown").alias("location"), "started_at"
    )


def recall_counts(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """Activities of each named agent, counted once each."""
    return (
        agents.select("agent_id", "agent_name")
        .join(relation(edges, "wasAssociatedWith", "activity_id", "agent_id"), "agent_id")
        .groupBy("agent_name")
        .agg(F.countDistinct("activity_id").alias("activities"))
    )


def traceability_edges(edges: DataFrame) -> DataFrame:
    """Edges of the traceability graph of every product: entity to activity, activity to agent."""
    # Each once before they meet: what comes of it needs no look at all its rows.
    used = relation(edges, "used", "activity_id", "entity_id").distinct()
    agents = relation(edges, "wasAssociatedWith", "activity_id", "agent_id").distinct()
    first = used.select("entity_id", F.col("entity_id").alias("src"), F.col("activity_id").alias("dst"), F.lit("used").alias("label"))
    second = used.join(agents, "activity_id").select(
        "entity_id", F.col("activity_id").alias("src"), F.col("agent_id").alias("dst"), F.lit("wasAssociatedWith").alias("label")
    )
    return first.unionByName(second)


def entity_activities(edges: DataFrame) -> DataFrame:
    """``entity_id, activity_id``: activities that used an entity."""
    return relation(edges, "used", "activity_id", "entity_id").select("entity_id", "activity_id").distinct()


def supply_chain_path(provenance_rows: DataFrame) -> DataFrame:
    """Provenance of each entity with its steps numbered from 1 by time, activity and agent."""
    order = W.partitionBy("entity_id").orderBy("started_at", "activity_id", "agent_id")
    return provenance_rows.withColumn("step", F.row_number().over(order))


def path_in_window(paths: DataFrame, entities: DataFrame, activities: DataFrame, first, last) -> DataFrame:
    """``start, end, position, node, activity_id, started_at``: steps of paths whose generation lies in a window, both ends included."""
    steps = paths.select("start", "end", F.posexplode("path").alias("position", "node"))
    made = entities.select(F.col("entity_id").alias("node"), F.col("was_generated_by").alias("activity_id"))
    when = activities.select("activity_id", "started_at").where(F.col("started_at").between(first, last))
    return steps.join(made, "node").join(when, "activity_id").select("start", "end", "position", "node", "activity_id", "started_at")


def full_history(log: DataFrame, provenance_rows: DataFrame) -> DataFrame:
    """``entity_id, a, v, tx, op, activity_id, agent_id``: every fact of an entity, with its provenance where it has one."""
    facts = log.select(F.col("e").alias("entity_id"), "a", "v", "tx", "op")
    return facts.join(provenance_rows.select("entity_id", "activity_id", "agent_id"), "entity_id", "left")


def related(edges: DataFrame) -> DataFrame:
    """``entity_id, related, relation``: neighbours of each entity by use, generation and derivation, both ways for the last."""
    used = relation(edges, "used", "related", "entity_id").select("entity_id", "related", F.lit("used").alias("relation"))
    made = relation(edges, "wasGeneratedBy", "entity_id", "related").withColumn("relation", F.lit("wasGeneratedBy"))
    up = relation(edges, "wasDerivedFrom", "entity_id", "related").withColumn("relation", F.lit("wasDerivedFrom"))
    down = relation(edges, "wasDerivedFrom", "related", "entity_id").select("entity_id", "related", F.lit("wasDerivedFrom").alias("relation"))
    return used.unionByName(made).unionByName(up).unionByName(down).distinct()


#: The stages of a product's journey, in order, and whose product each shows.
STAGES = (("farm", "milking", "raw-milk"), ("manufacturing", "uht-processing", None), ("logistics", "transport", None), ("retail", "retail-sale", None))
#: Prefixes of batch numbers and their variants.
VARIANTS = (("UHT-CHOC", "chocolate"), ("UHT-PLAIN", "plain"), ("UHT-STRAW", "strawberry"), ("MILK-THAI", "raw-milk"), ("RAW-MILK", "raw-milk"))


def variant(batch, prefixes=VARIANTS):
    """Variant of a batch by the first prefix that fits; null if none does."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes):
        out = F.when(batch.startswith(prefix), name).otherwise(out)
    return out


def journeys(products: DataFrame, activities: DataFrame, prefixes=VARIANTS) -> DataFrame:
    """``batch, variant, position, stage, activity, location, started_at, shown``: the journey of each product.

    ``products``: batch; ``activities``: activity, location, started_at, one row for
    each activity of the stages. ``shown`` is the product's batch, or, for the farm,
    the first batch of raw milk. Products without a variant have no journey.
    """
    spark = products.sparkSession
    stages = spark.createDataFrame([(i, *s) for i, s in enumerate(STAGES, 1)], "position int, stage string, activity string, variant_shown string")
    known = products.select("batch").distinct().withColumn("variant", variant(F.col("batch"), prefixes)).where("variant is not null")
    raw = known.groupBy(F.col("variant").alias("variant_shown")).agg(F.min("batch").alias("other"))
    plan = F.broadcast(stages.join(activities, "activity", "left").join(raw, "variant_shown", "left"))  # four stages
    steps = known.withColumn("position", F.explode(F.array(*(F.lit(i) for i in range(1, len(STAGES) + 1)))))
    return steps.join(plan, "position").select(
        "batch", "variant", "position", "stage", "activity", "location", "started_at",
        F.when(F.col("variant_shown").isNull(), F.col("batch")).otherwise(F.col("other")).alias("shown"),
    )


def journey_graph(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``batch, id, type`` and edges ``batch, src, dst, rel`` of journeys: stages and the products that they show."""
    stage = steps.select("batch", F.col("stage").alias("id"), F.lit("activity").alias("type"))
    shown = steps.where("shown is not null").select("batch", F.col("shown").alias("id"), F.lit("entity").alias("type"))
    edges = steps.where("shown is not null").select("batch", F.col("stage").alias("src"), F.col("shown").alias("dst"), F.lit("wasGeneratedBy").alias("rel"))
    return stage.unionByName(shown).distinct(), edges


def block_list(blocks: DataFrame) -> DataFrame:
    """Blocks with defaults for what is missing and the bytes of each as JSON."""
    shown = F.struct("chain", "height", "hash", "previous_hash")
    return blocks.select(
        "chain", "height", "hash", F.coalesce("previous_hash", F.lit("N/A")).alias("previous_hash"),
        F.length(F.to_json(shown)).cast("long").alias("bytes"),
    )


def export_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_id, entity_type, generated_by, derived_from``: defaults where there is none, sources sorted."""
    made = relation(edges, "wasGeneratedBy", "entity_id", "g").groupBy("entity_id").agg(F.min("g").alias("g"))
    sources = relation(edges, "wasDerivedFrom", "entity_id", "s").groupBy("entity_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return entities.select("entity_id", "entity_type").join(made, "entity_id", "left").join(sources, "entity_id", "left").select(
        "entity_id", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("g", F.lit("")).alias("generated_by"),
        F.coalesce("s", F.array().cast("array<string>")).alias("derived_from"),
    )


def bundles(entities: DataFrame, provenance_rows: DataFrame) -> DataFrame:
    """``value``: one JSON text an entity, with its provenance records in order."""
    record = F.struct("started_at", "activity_id", "agent_id")
    of = provenance_rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(record)).alias("provenance"))
    text = F.to_json(F.struct("entity_id", "entity_type", "batch", "product_name", F.coalesce("provenance", F.array().cast("array<struct<started_at:timestamp,activity_id:string,agent_id:string>>")).alias("provenance")))
    return entities.join(of, "entity_id", "left").select("entity_id", text.alias("value"))
