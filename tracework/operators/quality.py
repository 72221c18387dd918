"""Rule validation of the graph: required attributes, links, dangling references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Required attributes by class.
REQUIRED = {
    "entity": ("entity_id", "entity_type"),
    "activity": ("activity_id", "activity_type", "started_at"),
    "agent": ("agent_id", "agent_type"),
}
#: Types of entities that must name their product.
PRODUCT_TYPES = ("product/batch", "product/item")


def validate(rows: DataFrame, kind: str) -> DataFrame:
    """``id, kind, valid, errors, warnings``; an activity that ends before it starts gets a warning."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED[kind])))
    warn = F.array().cast("array<string>")
    if kind == "activity":
        warn = F.when(F.col("started_at") > F.col("ended_at"), F.array(F.lit("starts after its end"))).otherwise(warn)
    return rows.select(
        F.col(f"{kind}_id").alias("id"), F.lit(kind).alias("kind"), (F.size(missing) == 0).alias("valid"),
        F.array_join(missing, "; ").alias("errors"), F.array_join(warn, "; ").alias("warnings"),
    )


def entity_errors():
    """Faults of an entity by itself: required attributes, product and batch, as an array."""
    return F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED["entity"]),
        F.when(F.col("entity_type").isin(*PRODUCT_TYPES) & F.col("product_name").isNull(), "missing product_name"),
        F.when(F.col("batch") == "", "empty batch"),
    ))


def validate_entities(entities: DataFrame) -> DataFrame:
    """``id, kind, valid, errors, warnings`` of entities by all rules but those of links."""
    errors = entity_errors()
    return entities.select(
        F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), F.lit("").alias("warnings")
    )


def validate_all(entities: DataFrame, activities: DataFrame, agents: DataFrame) -> DataFrame:
    """Results of everything: entities by attributes, product and batch, activities and agents by attributes."""
    return validate_entities(entities).unionByName(validate(activities, "activity")).unionByName(validate(agents, "agent"))


def summary(results: DataFrame) -> DataFrame:
    """Valid, invalid and warned rows by class."""
    return results.groupBy("kind").agg(
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("warnings") != "").alias("warned")
    )


def orphans(entities: DataFrame, activities: DataFrame, agents: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target does not exist: ``rel, src, dst``."""
    target = {
        "used": entities.select(F.col("entity_id").alias("dst")),
        "wasDerivedFrom": entities.select(F.col("entity_id").alias("dst")),
        "wasGeneratedBy": activities.select(F.col("activity_id").alias("dst")),
        "wasAssociatedWith": agents.select(F.col("agent_id").alias("dst")),
    }
    out = None
    for rel, ids in target.items():
        bad = edges.where(F.col("rel") == rel).join(ids, "dst", "left_anti").select("rel", "src", "dst")
        out = bad if out is None else out.unionByName(bad)
    return out


def check_derivations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Derivations with their first fault: self-derivation, unknown source, unknown target; null if none."""
    ids = entities.select("entity_id")
    d = edges.where("rel = 'wasDerivedFrom'")
    return (
        d.join(ids.select(F.col("entity_id").alias("src"), F.lit(True).alias("s")), "src", "left")
        .join(ids.select(F.col("entity_id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
        .select(
            "src", "dst",
            F.when(F.col("src") == F.col("dst"), "self-derivation").when(F.col("s").isNull(), "unknown derived entity")
            .when(F.col("d").isNull(), "unknown source entity").alias("fault"),
        )
    )


def gaps(entities: DataFrame, activities: DataFrame, agents: DataFrame, sample: int = 10) -> DataFrame:
    """Missing types, times and names: count and the first ids of each."""
    out = None
    for what, df, key in (
        ("entity type", entities.where("entity_type is null"), "entity_id"),
        ("activity end", activities.where("ended_at is null"), "activity_id"),
        ("agent name", agents.where("agent_name is null"), "agent_id"),
    ):
        total = df.agg(F.count(F.lit(1)).alias("n"))
        first = df.orderBy(key).limit(sample).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("sample"))
        row = total.crossJoin(first).withColumn("gap", F.lit(what))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.select("gap", "n", "sample")


def complete_chains(edges: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """Whether each entity is used by at least ``least`` activities."""
    used = edges.where("rel = 'used'").groupBy(F.col("dst").alias("entity_id")).agg(F.countDistinct("src").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return entities.select("entity_id").join(used, "entity_id", "left").select(
        "entity_id", n.alias("activities"), (n >= least).alias("complete")
    )


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Identities that more than one row carries."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_links(links: DataFrame, sources: DataFrame, targets: DataFrame, source: str = "entity", target: str = "activity") -> DataFrame:
    """``src, dst, fault``: the first fault of each link; null if none.

    ``sources`` and ``targets`` give ids and kinds (``id, kind``) of all nodes that may stand there.
    """
    of = lambda df, key: df.groupBy(F.col("id").alias(key)).agg(F.collect_set("kind").alias(f"{key}_kinds"))
    joined = links.join(of(sources, "src"), "src", "left").join(of(targets, "dst"), "dst", "left")
    return joined.select(
        "src", "dst",
        F.when(F.col("src_kinds").isNull(), f"{source} not found").when(F.col("dst_kinds").isNull(), f"{target} not found")
        .when(~F.array_contains("src_kinds", source), f"not of kind {source}").when(~F.array_contains("dst_kinds", target), f"not of kind {target}").alias("fault"),
    )


def entity_results(entities: DataFrame, activities: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, valid, errors`` of each entity: its attributes, product, batch, generation and derivations together."""
    acts = activities.select(F.col("activity_id").alias("was_generated_by"), F.lit(True).alias("made")).distinct()
    faults = check_derivations(edges, entities).where("fault is not null").groupBy(F.col("src").alias("entity_id"))
    rows = entities.join(acts, "was_generated_by", "left").join(faults.agg(F.array_sort(F.collect_list("fault")).alias("faults")), "entity_id", "left")
    unmade = F.array_compact(F.array(F.when(F.col("was_generated_by").isNotNull() & F.col("made").isNull(), "activity not found")))
    errors = F.concat(entity_errors(), unmade, F.coalesce("faults", F.array().cast("array<string>")))
    return rows.select(F.col("entity_id").alias("id"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"))


def consistency(orphaned: DataFrame, cycles: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: valid unless there are orphans; cycles and gaps are warnings."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    g = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gaps"))
    return n(orphaned, "orphans").crossJoin(n(cycles, "cycles")).crossJoin(g).withColumn("valid", F.col("orphans") == 0)  # one row each


def location_fault(location, kind):
    """Fault of a place given as text or as JSON text (``kind``: null, text, map, other); null if none."""
    return (
        F.when((kind == "text") & (location == ""), "empty location")
        .when((kind == "map") & (F.get_json_object(location, "$.lat").isNull() | F.get_json_object(location, "$.lng").isNull()), "location without lat and lng")
        .when(kind == "other", "location is neither text nor map")
    )


def chain_report(entities: DataFrame, activities: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_id, line, value``: lines of a report of each product: its head, then its stages by time, or that there are none."""
    used = edges.where("rel = 'used'").select(F.col("dst").alias("entity_id"), F.col("src").alias("activity_id")).distinct()
    steps = used.join(activities.select("activity_id", "activity_type", "started_at"), "activity_id")
    at = F.row_number().over(W.partitionBy("entity_id").orderBy("started_at", "activity_id"))
    text = F.concat_ws(" | ", F.coalesce("activity_type", F.lit("unknown")), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))
    stages = steps.select("entity_id", (at + 1).alias("line"), text.alias("value"))
    head = F.concat_ws(" | ", F.coalesce("product_name", F.lit("Unknown")), F.coalesce("batch", F.lit("N/A")))
    none = entities.join(used, "entity_id", "left_anti").select("entity_id", F.lit(2).alias("line"), F.lit("No activities recorded.").alias("value"))
    return entities.select("entity_id", F.lit(1).alias("line"), head.alias("value")).unionByName(stages.join(entities.select("entity_id"), "entity_id", "left_semi")).unionByName(none)


def payload_complete(payload: Column) -> Column:
    """Whether a JSON payload names an entity, an activity and an agent, each by its own key or its stand-in; false if it is no JSON object."""
    # The keys of payloads.
    has = lambda *keys: F.coalesce(*(F.get_json_object(payload, f"$['{k}']") for k in keys)).isNotNull()
    return F.coalesce(
        has("prov/entity", "blockchain/transaction") & has("prov/activity", "prov/activity-type") & has("prov/agent", "prov/agent-type"), F.lit(False)
    )


def run_faults(manifests: DataFrame, summaries: DataFrame, expected: list[str], rules: dict[str, str], reps: int) -> DataFrame:
    """``run_id, faults``: what keeps a run from counting, sorted; empty if nothing does.

    ``manifests``: run_id, manifest (map of texts); ``rules``: keys of the manifest
    and the value each must have. Each expected query must be there once, with
    ``reps`` good runs and no error.
    """
    own = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("manifest")["run_id"] == F.col("run_id"), F.lit(False)), F.lit("run_id")),
        *(F.when(~F.coalesce(F.col("manifest")[k] == v, F.lit(False)), F.lit(k)) for k, v in rules.items()),
    ))
    asked = manifests.select("run_id", F.explode(F.array(*map(F.lit, expected))).alias("query"))
    got = asked.join(summaries.select("run_id", "query", "ok_count", "error_count"), ["run_id", "query"], "left")
    bad = F.when(F.col("ok_count").isNull(), F.concat(F.lit("missing "), "query")).when(F.col("ok_count") != reps, F.concat(F.lit("ok "), "query")).when(F.col("error_count") != 0, F.concat(F.lit("errors "), "query"))
    queries = got.groupBy("run_id").agg(F.collect_list(bad).alias("q"))
    return manifests.select("run_id", own.alias("own")).join(queries, "run_id").select("run_id", F.array_join(F.array_sort(F.concat("own", "q")), "; ").alias("faults"))
