"""Lookups, named queries and filters of the graph. Each answers for many keys in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.functions.ids import is_uuid
from tracework.operators import graph


def by_id(rows: DataFrame, key: str, ids: DataFrame | list) -> DataFrame:
    """Rows whose key is among ``ids``: a list, or the first column of a table."""
    if isinstance(ids, list):
        return rows.where(F.col(key).isin(ids))
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def search(current: DataFrame, attribute: str, value) -> DataFrame:
    """``e``: entities whose current attribute has a value."""
    return current.where((F.col("a") == attribute) & (F.col("v") == str(value))).select("e").distinct()


def transactions(blocks: DataFrame, tx_id=None, creator=None) -> DataFrame:
    """Blocks: all, one by its id, or those of a creator."""
    if tx_id is not None:
        blocks = blocks.where(F.col("tx_id") == tx_id)
    if creator is not None:
        blocks = blocks.where(F.col("creator") == creator)
    return blocks


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by ``order``; rows without a key are left out."""
    rest = [c for c in rows.columns if c != key]
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(key, "r.*")


def activities_of(edges: DataFrame) -> DataFrame:
    """``entity_id, activity_id``: activities that used or generated an entity, each once."""
    used = edges.where("rel = 'used'").select(F.col("dst").alias("entity_id"), F.col("src").alias("activity_id"))
    made = edges.where("rel = 'wasGeneratedBy'").select(F.col("src").alias("entity_id"), F.col("dst").alias("activity_id"))
    return used.unionByName(made).distinct()


# Filters of a graph: nodes (id, ...) and edges (src, rel, dst)


def filter_nodes(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a graph on the ids in the first column of ``keep``; an edge needs both ends."""
    ids = keep.select(F.col(keep.columns[0]).alias("id")).distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside.select(edges.columns)


def filter_types(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The part of a graph on the nodes of some types."""
    return filter_nodes(nodes, edges, nodes.where(F.col("type").isin(*types)).select("id"))


def filter_depth(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The part of a graph within ``depth`` derivations below the roots, roots included."""
    derived = edges.where("rel = 'wasDerivedFrom'").select("src", "dst")
    first = roots.select(F.col(roots.columns[0]).alias("id"))
    below = graph.descendants(derived, first, depth).select(F.col("node").alias("id"))
    return filter_nodes(nodes, edges, first.unionByName(below))


# Named queries

_BY_UUID = "select {0}_id as id from {{{1}}} where {0}_id = :{0}_id"
#: Name to required parameters (and whether they must be UUIDs), the table asked, and the SQL.
NAMED: dict[str, tuple[dict[str, bool], str, str]] = {
    "get-entity-by-id": ({"id": False}, "entities", "select * from {entities} where entity_id = :id"),
    "get-entity-by-uuid": ({"entity_id": True}, "entities", _BY_UUID.format("entity", "entities")),
    "get-prov-entities": ({"entity_id": True}, "entities", _BY_UUID.format("entity", "entities")),
    "get-prov-activities": ({"activity_id": True}, "activities", _BY_UUID.format("activity", "activities")),
    "get-prov-agents": ({"agent_id": True}, "agents", _BY_UUID.format("agent", "agents")),
    "get-traceability-products": ({"batch": False}, "entities", "select entity_id as id from {entities} where batch = :batch"),
    "pull-entity-by-id": ({"id": False}, "entities", "select * from {entities} where entity_id = :id"),
    "count-entities": ({}, "entities", "select count(*) as n from {entities}"),
    "count-activities": ({}, "activities", "select count(*) as n from {activities}"),
}


def named_query(spark: SparkSession, name: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """A query by its name. Unknown names, missing parameters and ids that are no UUID raise ValueError."""
    if name not in NAMED:
        raise ValueError(f"no query named {name}")
    needs, table, text = NAMED[name]
    for param, uuid in needs.items():
        if params.get(param) is None:
            raise ValueError(f"{name} needs {param}")
        if uuid and not spark.range(1).select(is_uuid(F.lit(str(params[param])))).first()[0]:
            raise ValueError(f"{param} is no UUID")
    return spark.sql(text, args={p: params[p] for p in needs}, **{table: tables[table]})


def with_default(column: str, default) -> Column:
    """An attribute, or a default where it is missing."""
    return F.coalesce(F.col(column), F.lit(default)).alias(column)


#: Names of entity and activity columns in transfers.
ENTITY_TRANSFER = {"batch": "traceability_batch", "product_name": "traceability_product", "entity_type": "variant"}
ACTIVITY_TRANSFER = {"started_at": "traceability_start_time", "ended_at": "traceability_end_time"}


def transfer_form(rows: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """The key and the renamed columns that a transfer carries."""
    return rows.select(key, *(F.col(c).alias(n) for c, n in names.items()))
