"""The prefix trie of conversations, from adaptive radix trees over ranges of keys.

A turn's id has 16 bytes, big-endian: the code points of its text in four, then
the head of a SHA-256 of role and text. A conversation's key is the ids of its
turns. Equal keys are counted first; the distinct ones are dealt by ranges, so a
beginning that very many share is spread like any other. Each range gives one
radix tree, walked in the order of keys; only byte depths that are whole turns
give nodes. A node that lies in several ranges is counted as new in the first of
them only, which each task knows from what its first and last keys share with the
neighbouring ranges. So all figures of a node, those of its subtree too, are sums
over ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import clean
from tracework.llm.radix_tree import RadixTree, common
from tracework.plans.materialize import drop, materialize

#: Bytes of a turn's id; bytes of keys in a range, about; longest head that a rebuilt conversation takes.
WIDTH, RANGE_BYTES, HEAD = 16, 4 << 20, 5
#: Bytes of ids joined to one row before digests are taken; ways that the children of a shared node are dealt.
RUN_BYTES, SALTS = 64 << 10, 16
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids``: conversations with the ids (hex) of their turns, in order, after the exchange of heads.

    Conversation c takes the first h turns of ``c - c % 100`` (remainders have the
    sign of c), then its own after its first h, h being ``crc32(c as text) % 6``.
    Turns are ordered by turn, nulls first, then by role and text; repeated rows are
    turns of their own. Rows with a null conv_id belong to no conversation. Of a
    very long text only its length and digest go on; null role and text are empty.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turn_id = F.concat(F.lpad(F.lower(F.hex(F.length("text"))), 8, "0"), F.substring(digest, 1, 2 * WIDTH - 8))
    # Texts are carried along only for turns that have the number of another one.
    tied = turns.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("tied"), F.col("turn").alias("at"))
    tie = F.lit(None).cast("string")
    if not tied.isEmpty():
        turns = turns.join(tied, (F.col("conv_id") == F.col("tied")) & F.col("turn").eqNullSafe(F.col("at")), "left")
        tie = F.when(F.col("tied").isNotNull(), F.col("text"))
    short = turns.select("conv_id", F.struct("turn", "role", tie.alias("tie"), turn_id.alias("id")).alias("t"))
    own = short.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["id"]).alias("ids"))
    own = materialize(own).withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")})
    heads = own.where("conv_id = base").select("base", F.slice("ids", 1, HEAD).alias("head"))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("ids"))


def prefix_trie(keys: DataFrame, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The nodes of the trie of ``conv_id, key``, keys being turn ids one after another.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and
    ``node`` (an id, null-free). Conv_ids are not null and each comes once. Keys of
    one conversation lie in one row: 16 bytes a turn. No conversations, no nodes.
    """
    spark = keys.sparkSession
    keys = materialize(keys)
    distinct = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    size = int(keys.agg(F.sum(F.length("key"))).first()[0] or 0)
    ranges = max(spark.sparkContext.defaultParallelism, -(-size // range_bytes))
    dealt = materialize(distinct.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()))
    bounds = _bounds(dealt)
    partial = dealt.join(bounds, "part").groupBy("part").applyInArrow(_nodes, _PARTIAL)
    least = lambda c: F.min(c).alias(c)
    merged = partial.groupBy("node", "parent", "depth").agg(
        least("first"), least("parent_first"), F.max("shared").alias("shared"),
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")),
    )
    merged = materialize(merged)
    drop(dealt)
    # Parents in one range are known there; those in several, few to a range, are looked up. One may have very many children.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = merged.where("shared").select(F.col("node").alias("parent"), F.col("first").alias("looked_up"), salts)
    salted = merged.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    nodes = salted.join(shared, ["parent", "salt"], "left").join(_ends(keys, run_bytes), "node", "left")
    return nodes.select(
        F.col("first").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.coalesce("parent_first", "looked_up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        "node",
    )


def conversation_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """``prefix_trie`` of the ``rebuilt`` conversations. Null role or text counts as empty; other columns are ignored, whatever their names."""
    key = F.unhex(F.array_join("ids", ""))
    return prefix_trie(rebuilt(conversations).select("conv_id", key.alias("key")), **sizes)


def _bounds(dealt: DataFrame) -> DataFrame:
    """``part, before, after``: turns that a range's first key shares with the range before, and its last with the range after (-1: there is none)."""
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = None, b"", 0
        for rb in batches:
            for row in rb.to_pylist():
                same = common(last, row["first"]) // WIDTH if part is not None else 0
                if part is not None:
                    yield pa.RecordBatch.from_pylist([{"part": part, "before": before, "after": same}], _BOUNDS)
                part, last, before = row["part"], row["last"], same
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "before": before, "after": -1}], _BOUNDS)

    # A row for each range, in one task; keys are ordered as ranges are.
    return materialize(ends.coalesce(1).sortWithinPartitions("part").mapInArrow(neighbours, "part int, before int, after int"), 0)


_BOUNDS = pa.schema([("part", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])
_PARTIAL = "node binary, parent binary, depth int, first long, parent_first long, shared boolean, n long, children long, leaves long, saved long"


def _nodes(rows: pa.Table) -> pa.Table:
    """The nodes of one range with the figures they have there."""
    with clean():
        tree = RadixTree()
        for key, n, first in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), rows["first"].to_pylist()):
            tree.insert(key, (n, first))
        return _figures(tree, rows["before"][0].as_py(), rows["after"][0].as_py())


def _figures(tree: RadixTree, before: int, after: int) -> pa.Table:
    node, parent, depth, text, new, shared, last = [], [], [], [], [], [], []
    count, first = [], []
    # By the byte depth of a node of the tree: the state of the digest there, bytes since the last whole turn, number of the last node.
    above: dict[int, tuple] = {0: (hashlib.sha256(), b"", -1)}
    for at, own, n, least, greatest in tree.walk():
        digest, tail, up = above[at]
        digest, path = digest.copy(), tail + own
        start = at - len(tail)
        for turn in range(0, len(path) // WIDTH + 1):
            if turn == 0 and up >= 0:
                continue  # that depth was above
            whole = path[(turn - 1) * WIDTH : turn * WIDTH] if turn else b""
            digest.update(whole)
            level = start // WIDTH + turn
            node.append(digest.digest()[:16])
            parent.append(up)
            depth.append(level)
            text.append(int.from_bytes(whole[:4], "big"))
            new.append(not (least and level <= before))
            shared.append(level == 0 or (least and level <= before) or (greatest and level <= after))
            last.append(greatest and level == after)  # the next range may go on from here
            count.append(0)
            first.append(None)
            up = len(node) - 1
        if n.value is not None:
            count[up], first[up] = n.value
        end = at + len(own)
        above[end] = (digest, path[len(path) // WIDTH * WIDTH :], up)
    return _sum_up(node, parent, depth, text, new, shared, last, count, first)


def _sum_up(node, parent, depth, text, new, shared, last, count, first) -> pa.Table:
    size = len(node)
    n, least = count, first
    children, below, leaves, saved = [0] * size, [False] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):  # children come after their parents
        if not below[i] and not last[i]:
            leaves[i] = 1
        saved[i] += n[i] * text[i] - (text[i] if new[i] else 0)
        up = parent[i]
        if up >= 0:
            below[up] = True
            children[up] += new[i]
            n[up] += n[i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            if least[up] is None or least[i] < least[up]:
                least[up] = least[i]
    up = np.array(parent)
    known = [None if p < 0 or shared[p] else least[p] for p in parent]
    return pa.table(
        {
            "node": pa.array(node, pa.binary()),
            "parent": pa.array([None if p < 0 else node[p] for p in up], pa.binary()),
            "depth": pa.array(depth, pa.int32()),
            "first": pa.array(least, pa.int64()),
            "parent_first": pa.array(known, pa.int64()),
            "shared": pa.array(shared, pa.bool_()),
            "n": pa.array(n, pa.int64()),
            "children": pa.array(children, pa.int64()),
            "leaves": pa.array(leaves, pa.int64()),
            "saved": pa.array(saved, pa.int64()),
        }
    )


def _ends(keys: DataFrame, run_bytes: int) -> DataFrame:
    """``node, ends_sha256``: the digest of the ascending ids of the conversations that end at a node.

    Ids are dealt by ranges of (node, id) and joined to runs first, so the one task
    that takes a node's digest, as its definition asks, reads few rows.
    """
    node = F.unhex(F.substring(F.sha2("key", 256), 1, 32))
    rows = keys.select(node.alias("node"), "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, size = None, [], 0

        def run() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"]
            )

        for rb in batches:
            out: dict[str, list] = {"node": [], "first": [], "ids": []}
            for n, c in zip(rb.column("node").to_pylist(), rb.column("conv_id").to_pylist()):
                if n != at or size >= run_bytes:
                    if ids:
                        out["node"].append(at)
                        out["first"].append(ids[0])
                        out["ids"].append(",".join(map(str, ids)))
                    at, ids, size = n, [], 0
                ids.append(c)
                size += 12
            if out["node"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.binary()), pa.array(out["first"], pa.int64()), pa.array(out["ids"], pa.string())], names=["node", "first", "ids"])
        if ids:
            yield run()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for rb in batches:
            nodes, found = [], []
            for n, text in zip(rb.column("node").to_pylist(), rb.column("ids").to_pylist()):
                if n == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    nodes.append(at)
                    found.append(state.hexdigest())
                at, state = n, hashlib.sha256(text.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    joined = rows.mapInArrow(runs, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")
