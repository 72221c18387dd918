"""Recall records to agents, entities, activities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.ids import place, strict_date, uuid3

#: Fields that a usable record fills.
FIELDS = ("recall_number", "event_id", "recalling_firm", "product_description")


def usable(records: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for f in FIELDS:
        ok = ok & (F.trim(F.coalesce(f, F.lit(""))) != "")
    return records.where(ok)


def normalise(records: DataFrame) -> DataFrame:
    """Stable ids, place and times of usable records.

    One row a recall number: the least by firm, then product, place, start and end.
    """
    name = lambda kind, c: uuid3(F.concat(F.lit(f"openfda-food/{kind}/"), F.col(c))).alias(f"{kind}_id")
    start = F.coalesce(strict_date(F.col("recall_initiation_date")), strict_date(F.col("report_date")), F.to_timestamp(F.lit("1970-01-01")))
    least = F.min(
        F.struct(
            "recalling_firm", "product_description", place(F.col("city"), F.col("state"), F.col("country")).alias("location"),
            start.alias("started_at"), strict_date(F.col("termination_date")).alias("ended_at"),
        )
    )
    rows = usable(records).groupBy("recall_number").agg(least.alias("r")).select("recall_number", "r.*")
    # Identifiers follow from the number and the firm, so they are made for the rows that stay.
    return rows.select(
        "recall_number", "recalling_firm", "product_description", name("entity", "recall_number"), name("activity", "recall_number"),
        name("agent", "recalling_firm"), "location", "started_at", "ended_at",
    )


def tables(normal: DataFrame) -> dict[str, DataFrame]:
    """``entities, activities, agents, edges`` of normalised records, each id once; an end time only where it was given."""
    entities = normal.select("entity_id", F.col("recall_number").alias("batch"), F.col("product_description").alias("product_name"), F.col("activity_id").alias("was_generated_by"))
    entities = entities.dropDuplicates(["entity_id"])
    activities = normal.select("activity_id", F.lit("recall").alias("activity_type"), "started_at", "ended_at", "location").dropDuplicates(["activity_id"])
    agents = normal.groupBy("agent_id").agg(F.min("recalling_firm").alias("agent_name"), F.lit("organization/recalling-firm").alias("agent_type"), F.min("location").alias("location"))
    edge = lambda src, rel, dst: normal.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    edges = edge("activity_id", "used", "entity_id").unionByName(edge("activity_id", "wasAssociatedWith", "agent_id")).distinct()
    return {"entities": entities, "activities": activities, "agents": agents, "edges": edges}


def lookups(parts: dict[str, DataFrame], batches: DataFrame, firms: DataFrame) -> DataFrame:
    """``query, key, value, ok``: the four lookups of many keys: products of a batch, the entity, its activity, recalls of a firm.

    ``ok`` is whether an answer says something: not null, or a count above 0.
    """
    asked = batches.select(F.col(batches.columns[0]).alias("key")).distinct()
    found = asked.join(parts["entities"].withColumnRenamed("batch", "key"), "key", "left")
    acts = found.join(parts["activities"].select("activity_id", "activity_type"), F.col("was_generated_by") == F.col("activity_id"), "left")
    row = lambda df, query, value: df.select(F.lit(query).alias("query"), "key", value.cast("string").alias("value"))
    names = firms.select(F.col(firms.columns[0]).alias("key")).distinct()
    by_firm = parts["edges"].where("rel = 'wasAssociatedWith'").join(parts["agents"], F.col("dst") == F.col("agent_id")).groupBy(F.col("agent_name").alias("key")).agg(F.countDistinct("src").alias("n"))
    counts = names.join(by_firm, "key", "left")
    out = row(found, "batch", F.col("product_name")).unionByName(row(found, "entity", F.col("entity_id"))).unionByName(row(acts, "activity", F.col("activity_type")))
    out = out.unionByName(row(counts, "recalls", F.coalesce("n", F.lit(0))))
    return out.withColumn("ok", F.coalesce(F.col("value").isNotNull() & (F.col("value") != "0"), F.lit(False)))


def recall_counts(normal: DataFrame) -> DataFrame:
    return normal.groupBy("recalling_firm").agg(F.countDistinct("activity_id").alias("recalls"))
