"""Tamper evidence: Merkle trees, inclusion proofs, chain links, transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.operators.ranges import running
from tracework.plans.materialize import materialize


def merkle_levels(leaves: DataFrame, tree: str, order: str, text: str) -> DataFrame:
    """``tree_id, level, idx, hash``: all levels of a tree per group.

    A leaf is the SHA-256 of its text; two neighbours give that of their hex
    digests joined; an odd last node goes up as it is. Equal order keys are
    ordered by text. Each level is a group-by over all trees at once.
    """
    rows = running(leaves.select(F.col(tree).alias("tree_id"), order, text), ["tree_id"], [order, text])
    level = materialize(rows.select("tree_id", F.lit(0).alias("level"), (F.col("n") - 1).cast("long").alias("idx"), F.sha2(text, 256).alias("hash")))
    out = level
    while (level.agg(F.max("idx")).first()[0] or 0) > 0:
        up = level.join(level.groupBy("tree_id").agg(F.max("idx").alias("top")).where("top > 0"), "tree_id", "left_semi")
        level = materialize(
            up.groupBy("tree_id", (F.col("level") + 1).alias("level"), F.expr("idx div 2").alias("idx")).agg(
                F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r")
            ).select("tree_id", "level", "idx", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
        )
        out = out.unionByName(level)
    return out


def merkle_roots(levels: DataFrame) -> DataFrame:
    """``tree_id, root, height, leaves``."""
    return levels.groupBy("tree_id").agg(
        F.max_by("hash", "level").alias("root"), F.max("level").alias("height"), F.count_if(F.col("level") == 0).alias("leaves")
    )


def merkle_proofs(levels: DataFrame) -> DataFrame:
    """``tree_id, idx, leaf, path``: for each leaf its siblings (hash, direction) from below; none where it has no sibling."""
    leaf = levels.where("level = 0").select("tree_id", "idx", F.col("hash").alias("leaf"))
    top = levels.groupBy("tree_id").agg(F.max("level").alias("height"))
    asked = leaf.join(top, "tree_id").withColumn("level", F.explode(F.expr("if(height > 0, sequence(0, height - 1), array(-1))")))
    asked = asked.withColumn("at", F.expr("shiftright(idx, greatest(level, 0))")).withColumn("sib", F.expr("at ^ 1"))
    step = asked.join(
        levels.select("tree_id", "level", F.col("idx").alias("sib"), F.col("hash").alias("h")), ["tree_id", "level", "sib"], "left"
    )
    side = F.when(F.col("at") % 2 == 0, "right").otherwise("left")
    item = F.when(F.col("h").isNotNull(), F.struct("level", F.col("h").alias("hash"), side.alias("direction")))
    return step.groupBy("tree_id", "idx", "leaf").agg(F.array_sort(F.collect_list(item)).alias("path"))


def verify(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a proof leads from a leaf to a root; malformed input is false."""
    end = F.aggregate(
        path, leaf,
        lambda h, s: F.sha2(F.when(s["direction"] == "left", F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256),
    )
    good = F.forall(path, lambda s: s["hash"].rlike("^[0-9a-f]{64}$") & s["direction"].isin("left", "right"))
    return F.coalesce(good & leaf.rlike("^[0-9a-f]{64}$") & (end == root), F.lit(False))


def chain_links(blocks: DataFrame) -> DataFrame:
    """Each block with ``link_ok``: its previous hash is the hash before it in the chain and heights go up by one."""
    w = W.partitionBy("chain").orderBy("height")
    first = F.row_number().over(w) == 1
    ok = F.when(first, F.col("previous_hash").isNull()).otherwise(
        F.coalesce((F.col("previous_hash") == F.lag("hash").over(w)) & (F.col("height") == F.lag("height").over(w) + 1), F.lit(False))
    )
    return blocks.withColumn("link_ok", ok)


def tally(votes: DataFrame, quorum: int = 2) -> DataFrame:
    """Last vote of each voter, counted by proposal; rejection is tested before approval."""
    last = votes.groupBy("proposal_id", "voter_id").agg(F.max_by("vote", F.struct("ts", "event_id")).alias("vote"))
    n = last.groupBy("proposal_id").agg(
        F.count_if(F.col("vote") == "APPROVE").alias("approve"), F.count_if(F.col("vote") == "REJECT").alias("reject"), F.count(F.lit(1)).alias("total")
    )
    return n.withColumn("decision", F.when(F.col("reject") >= quorum, "rejected").when(F.col("approve") >= quorum, "approved").otherwise("pending"))


#: Fixed value: the factor that spreads heights over stakes.
_SPREAD = 7919


def producers(heights: DataFrame, validators: DataFrame) -> DataFrame:
    """``height, authority, stake, leader``: who should produce each height under the three protocols.

    ``validators``: idx (from 0), name, stake; a short list. Authority: by height in
    turn. Stake: the first whose running stake reaches ``height * 7919`` modulo all
    stakes. Leader: by view, which is the height divided by the number of validators.
    """
    total = W.orderBy("idx")
    v = validators.select("idx", "name", F.sum("stake").over(total).alias("upto"))
    names = v.agg(F.array_sort(F.collect_list(F.struct("idx", "name", "upto"))).alias("v"))  # one row: the validators
    h, n = F.col("height"), F.size("v").cast("long")
    target = (h * _SPREAD) % F.element_at("v", -1)["upto"]
    name = lambda i: F.col("v")[i.cast("int")]["name"]
    return heights.select("height").distinct().crossJoin(F.broadcast(names)).select(
        "height",
        name(h % n).alias("authority"),
        F.filter("v", lambda x: x["upto"] >= target)[0]["name"].alias("stake"),
        name(F.floor(h / n) % n).alias("leader"),
    )


def audit_blocks(blocks: DataFrame, validators: DataFrame, min_stake: float, faults: int) -> DataFrame:
    """``chain, height, authority_ok, stake_ok, pbft_ok``: whether each block's creator may have made it.

    ``blocks``: chain, height, creator. Stake asks for a member with enough of it;
    the last asks for a member, heights that go up by one (from any first one),
    and at least ``3 * faults + 1`` validators.
    """
    known = F.broadcast(validators.select(F.col("name").alias("creator"), F.col("stake").alias("held")))  # a short list
    enough = validators.agg((F.count(F.lit(1)) >= 3 * faults + 1).alias("enough"))
    before = F.lag("height").over(W.partitionBy("chain").orderBy("height"))
    rows = blocks.withColumn("next", F.coalesce(F.col("height") == before + 1, F.lit(True))).join(known, "creator", "left")
    rows = rows.join(producers(blocks, validators), "height").crossJoin(F.broadcast(enough))  # one row
    return rows.select(
        "chain", "height", (F.col("creator") == F.col("authority")).alias("authority_ok"),
        F.coalesce(F.col("held") >= min_stake, F.lit(False)).alias("stake_ok"),
        (F.col("next") & F.col("held").isNotNull() & F.col("enough")).alias("pbft_ok"),
    )


def check_configs(configs: DataFrame) -> DataFrame:
    """``node, valid, reason``: whether a node's validators suit its protocol.

    ``configs``: node, type, validators (array), stakes (map), f.
    """
    staked = F.forall("validators", lambda v: F.array_contains(F.map_keys("stakes"), v))
    reason = (
        F.when(F.col("type").isNull() | ~F.col("type").isin("poa", "pos", "pbft"), "unknown type")
        .when(F.size("validators") < 1, "no validators")
        .when((F.col("type") == "pos") & ~F.coalesce(staked, F.lit(False)), "validators without stakes")
        .when((F.col("type") == "pbft") & ~F.coalesce(F.size("validators") >= 3 * F.col("f") + 1, F.lit(False)), "too few validators")
    )
    return configs.select("node", reason.isNull().alias("valid"), reason.alias("reason"))


def network_agreement(configs: DataFrame, by: str) -> DataFrame:
    """Whether all nodes of a network have one protocol and one set of validators; types are looked at first."""
    n = configs.groupBy(by).agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("type").alias("types"), F.countDistinct(F.array_sort(F.array_distinct("validators"))).alias("sets")
    )
    reason = F.when(F.col("types") > 1, "types differ").when(F.col("sets") > 1, "validators differ")
    return n.select(by, "nodes", "types", "sets", reason.isNull().alias("valid"), reason.alias("reason"))
