"""Transfers between ledgers: payloads from provenance, decisions, rows for the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.ids import uuid3
from tracework.operators.ledger import verify

#: Type of an inclusion proof: siblings from below.
PATH = "array<struct<level:int,hash:string,direction:string>>"


#: The fields of entity, activity and agent that a payload takes along.
FIELDS = {
    "activity": ("activity_id", "activity_type", "started_at"),
    "agent": ("agent_id", "agent_name", "agent_type"),
    "entity": ("batch", "entity_id", "entity_type", "product_name"),
}


def payload_hash():
    """Digest of the whole payload as sorted-key JSON: fields of the three and the relations; times as UTC text, nulls left out."""
    def shown(c: str):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "started_at" else F.col(c)

    parts = [F.struct(*map(shown, names)).alias(kind) for kind, names in FIELDS.items()]
    return F.sha2(F.to_json(F.struct(*parts, F.struct("used", "was_associated_with", "was_generated_by").alias("relationships"))), 256)


def payloads(provenance: DataFrame, entities: DataFrame, activities: DataFrame, agents: DataFrame) -> DataFrame:
    """One payload an entity: the fields of its first provenance record, with the proof of a tree of that payload alone."""
    first = provenance.groupBy("entity_id").agg(F.min(F.struct("activity_id", "agent_id")).alias("r"))
    p = first.select("entity_id", F.col("r.activity_id").alias("activity_id"), F.col("r.agent_id").alias("agent_id"))
    for kind, rows in (("entity", entities), ("activity", activities), ("agent", agents)):
        p = p.join(rows.select(*FIELDS[kind]), f"{kind}_id")
    p = p.withColumns({"used": F.col("entity_id"), "was_generated_by": F.col("activity_id"), "was_associated_with": F.col("agent_id")})
    return p.withColumn("tx_hash", payload_hash()).withColumns({"merkle_root": F.col("tx_hash"), "merkle_proof": F.array().cast(PATH)})


def payload_ok():
    """All three ids are there and the relations name them."""
    pairs = (("entity_id", "used"), ("activity_id", "was_generated_by"), ("agent_id", "was_associated_with"))
    ok = F.lit(True)
    for one, other in pairs:
        ok = ok & F.coalesce(F.col(one) == F.col(other), F.lit(False))
    return ok


def decide(transfers: DataFrame, threshold: int) -> DataFrame:
    """``status, reason, needed`` of each transfer: payload first, then proof, then signatures.

    Without root and proof the proof counts as good. ``signatures`` is an array; null is empty.
    """
    supplied = F.col("merkle_root").isNotNull() | F.col("merkle_proof").isNotNull()
    good = F.coalesce((F.col("tx_hash") == payload_hash()) & verify(F.col("tx_hash"), F.col("merkle_proof"), F.col("merkle_root")), F.lit(False))
    signed = F.coalesce(F.size("signatures"), F.lit(0))
    signed = F.greatest(signed, F.lit(0))
    status = F.when(~payload_ok() | (supplied & ~good), "failed").when(signed < threshold, "pending").otherwise("executed")
    return transfers.withColumns({
        "status": status,
        "reason": F.when(~payload_ok(), "invalid payload").when(supplied & ~good, "invalid proof"),
        "needed": F.when(status == "pending", threshold - signed),
    })


def target_rows(decided: DataFrame, applied: DataFrame, source_chain: str) -> DataFrame:
    """New entities on the target for executed transfers that it does not hold yet, each transfer once.

    A row has the transfer, the chain it comes from, an identifier of its own
    (derived from the transfer), and the entity's type and batch.
    """
    new = decided.where("status = 'executed'").join(applied.select("transfer_id"), "transfer_id", "left_anti").dropDuplicates(["transfer_id"])
    return new.select(
        "transfer_id", F.lit(source_chain).alias("source_chain"),
        uuid3(F.concat(F.lit(f"bridge/{source_chain}/"), F.col("transfer_id").cast("string"))).alias("entity_id"), "entity_type", "batch",
    )


def summary(decided: DataFrame, *by: str) -> DataFrame:
    return decided.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("needed"), F.lit(0)).alias("signatures_needed"))
