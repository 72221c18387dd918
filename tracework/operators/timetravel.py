"""As-of, since and history reads of the fact log, and change batches.

A log has ``e, a, v, tx, op`` with op add or retract. Within one transaction
retractions come before additions, so replacing a value may write both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _facts(rows: DataFrame) -> DataFrame:
    """``e, a, v, added, retracted``: the last transactions that did so with each value."""
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("tx")))
    return rows.groupBy("e", "a", "v").agg(last("add").alias("added"), last("retract").alias("retracted")).where("added is not null")


def as_of(log: DataFrame, tx: int | None = None, many: tuple[str, ...] = ()) -> DataFrame:
    """``e, a, v, tx``: values at ``tx`` (null: now). Attributes in ``many`` hold sets of values.

    A value is there if it was added and not retracted in a later transaction. A
    one-valued attribute holds the value added last (of two in one transaction,
    the greater); retracting another value than that changes nothing.
    """
    rows = log if tx is None else log.where(F.col("tx") <= tx)
    key = F.when(F.col("a").isin(*many), F.col("v")) if many else F.lit(None).cast("string")
    last = _facts(rows).withColumn("k", key).groupBy("e", "a", "k").agg(F.max(F.struct("added", "v", "retracted")).alias("m"))
    return last.where("m.retracted is null or m.retracted <= m.added").select(
        "e", "a", F.col("m.v").alias("v"), F.col("m.added").alias("tx")
    )


def since(log: DataFrame, tx: int, many: tuple[str, ...] = ()) -> DataFrame:
    return as_of(log.where(F.col("tx") > tx), None, many)


def history(log: DataFrame, entity: str | None = None) -> DataFrame:
    """The facts of one entity, or of all, numbered from 1 in each: by transaction, attribute, retractions first, value."""
    rows = log if entity is None else log.where(F.col("e") == entity)
    order = W.partitionBy("e").orderBy("tx", "a", F.desc("op"), "v")
    return rows.withColumn("position", F.row_number().over(order))


def wide(current: DataFrame, attributes: list[str], many: tuple[str, ...] = ()) -> DataFrame:
    """One row an entity, one column an attribute (those in ``many`` as sorted arrays); absent is null."""
    at = lambda a: F.when(F.col("a") == a, F.col("v"))
    return current.groupBy("e").agg(
        *(F.array_sort(F.collect_set(at(a))).alias(a) if a in many else F.max(at(a)).alias(a) for a in attributes)
    )


def assertions(rows: DataFrame, key: str, attributes: list[str] | None = None) -> DataFrame:
    """Changes ``e, a, v, op`` that assert the columns of wide rows (all but the key, unless named); a null asserts nothing."""
    names = [c for c in rows.columns if c != key] if attributes is None else attributes
    pairs = F.array(*(F.struct(F.lit(c).alias("a"), F.col(c).cast("string").alias("v")) for c in names))
    each = rows.select(F.col(key).cast("string").alias("e"), F.explode(pairs).alias("x"))
    return each.select("e", "x.a", "x.v", F.lit("add").alias("op")).where("e is not null and v is not null")


def removals(ids: DataFrame) -> DataFrame:
    """Changes that take entities (first column) away whole."""
    null = F.lit(None).cast("string")
    return ids.select(F.col(ids.columns[0]).cast("string").alias("e"), null.alias("a"), null.alias("v"), F.lit("retract-entity").alias("op"))


def resolve(now: DataFrame, changes: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Changes whose entity asserts an identity that another one holds already go to that one (upsert)."""
    held = now.where(F.col("a").isin(*identity)).groupBy("a", "v").agg(F.min("e").alias("held"))
    ids = changes.where((F.col("op") == "add") & F.col("a").isin(*identity)).join(held, ["a", "v"])
    ids = ids.groupBy("e").agg(F.min("held").alias("held"))
    return changes.join(ids, "e", "left").withColumn("e", F.coalesce("held", "e")).drop("held")


def apply_changes(
    log: DataFrame, changes: DataFrame, tx: int, many: tuple[str, ...] = (), identity: tuple[str, ...] = ()
) -> DataFrame:
    """Facts that a batch ``e, a, v, op`` adds at ``tx``.

    ``op`` is add, retract (a null value takes whatever is there) or
    retract-entity (all values of ``e``). Asserting another value of a
    one-valued attribute retracts the old one; the same value is no change. Of
    two values asserted for one such attribute, the one of greater ``seq`` counts
    (if the batch has that column), then the greater; an assertion goes before a
    retraction of the same. ``identity`` names attributes by which an entity is
    found again.
    """
    now = as_of(log, None, many).select("e", "a", "v")
    if identity:
        changes = resolve(now, changes, identity)
    several = F.col("a").isin(*many) if many else F.lit(False)
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    key = F.when(several, F.col("v"))
    new = (
        changes.where("op = 'add' and v is not null")
        .groupBy("e", "a", key.alias("k"))
        .agg(F.max(F.struct(seq.alias("s"), "v")).alias("m"))
        .select(F.col("e").alias("ne"), F.col("a").alias("na"), F.col("m.v").alias("new"), F.col("k").alias("nk"))
    )
    gone = changes.where("op = 'retract'").groupBy("e", "a").agg(F.collect_set("v").alias("drop_v"), F.max(F.col("v").isNull()).alias("drop_any"))
    whole = changes.where("op = 'retract-entity'").select("e").distinct().withColumn("drop_e", F.lit(True))
    both = (
        now.withColumn("k", key)
        .withColumnRenamed("v", "old")
        .join(new, (F.col("e") == F.col("ne")) & (F.col("a") == F.col("na")) & F.col("k").eqNullSafe(F.col("nk")), "full")
        .select(F.coalesce("e", "ne").alias("e"), F.coalesce("a", "na").alias("a"), "old", "new")
        .join(gone, ["e", "a"], "left")
        .join(whole, "e", "left")
    )
    dropped = F.coalesce(F.col("drop_any") | F.array_contains("drop_v", F.col("old")), F.lit(False)) | F.coalesce("drop_e", F.lit(False))
    out = F.when(F.col("old").isNotNull() & F.when(F.col("new").isNull(), dropped).otherwise(F.col("new") != F.col("old")), F.struct(F.col("old").alias("v"), F.lit("retract").alias("op")))
    into = F.when(F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") != F.col("old"))), F.struct(F.col("new").alias("v"), F.lit("add").alias("op")))
    return both.select("e", "a", F.explode(F.array_compact(F.array(out, into))).alias("f")).select(
        "e", "a", "f.v", F.lit(tx).cast("long").alias("tx"), "f.op"
    )
