"""N-gram Jaccard join: near-duplicate documents through signature trees.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a percentage. The join reports each document's component.

1. Documents with equal sets fold into the smallest id among them.
2. Documents that agree in one of two minimum hashes meet in a signature tree;
   its dual traversal leaves few pairs, which are compared with whole sets.
   This joins nearly all members of large groups while sets travel only twice.
3. What is left is made exact: two linked documents share a token in their
   prefixes under any order of tokens. Only tokens under which two components
   still meet are opened, again by signature trees. Counting the tokens under
   which a pair meets bounds its overlap once more (beyond the shorter prefix it
   can share what is left of that set); pairs that pass are compared with whole
   sets.

The order puts tokens that very many documents have last. That choice changes
the work only: any order gives the same links. A hot token is split into
blocks of documents, each pair of blocks being a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import begin, clean, map_rows, small_batches, tidy
from tracework.llm.shingles import WORDS, mix, shingle_set
from tracework.llm.signature_tree import WIDE_BITS, Forest, PairTally, as_words, candidate_pairs, folded, linked, may_link, overlap, signature
from tracework.operators.components import connected_components
from tracework.plans.materialize import drop, materialize

#: Tokens in more documents than this count as hot; at most HOT_TOKENS of them, the hottest.
HOT_COUNT, HOT_TOKENS = 64, 200_000
#: Documents of a minimum-hash group that meet in one tree; entries of a token in one block;
#: documents of a component in a block of pairs.
TREE_ROWS, BLOCK_ROWS, PAIR_BLOCK = 400, 1024, 256
#: Bytes of rows in one Python group, and of a table that may be broadcast.
GROUP_BYTES, BROADCAST_BYTES = 12 << 20, 32 << 20
_TALLY = 1 << 21
#: Different pairs that a task adds up before it sends them on; rows of the tokens of one passage that meet in one group.
_TALLY_PAIRS, PLACE_ROWS = 200_000, 50_000
#: Bytes of a row under a token, with its share of the documents' own rows.
_MEET_BYTES = 100
#: Bytes of a pair of documents that is to be verified, in a task.
_PAIR_BYTES = 120
_PAIR = ["x", "y", "a", "b", "sizes", "rest", "common"]


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = 75
) -> DataFrame:
    """Components of the links between documents.

    Returns ``doc_id, n_shingles, component_id`` for every id in ``docs``.
    Null and blank texts have no shingles and are components of their own, as
    is the null id. Rows that repeat an id count once, by the row with the
    smallest set (size, then hash). Other columns are ignored, whatever their
    names. An empty table gives an empty result. Very long texts are taken whole.
    Sets are compared by 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot_tokens(docs, width, percent))
    light = _one_row_each(materialize(map_rows(docs, _LIGHT, lambda: _describe(hot.value, width, percent))))

    copies = materialize(
        light.where("n > 0 and doc_id is not null")
        .groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    )
    first = _tree_links(docs, copies, None, width, percent)
    found = connected_components(first, "a", "b")
    named = _label(copies, found)
    if not first.isEmpty():  # groups that were dealt over several trees: what they joined meets once more
        second = _tree_links(docs, copies, named, width, percent)
        if not second.isEmpty():
            found = connected_components(first.unionByName(second), "a", "b")
            named = _label(copies, found)

    about = light.select("doc_id", "n", "last", "sig", "prefix")
    rep = materialize(about.join(named.select(F.col("rep").alias("doc_id"), "component"), "doc_id"))
    slim = materialize(light.select("doc_id", "n", "h1", "h2"))
    drop(light)
    last = connected_components(_prefix_links(docs, rep, named, width, percent), "a", "b")
    last = last.select(F.col("node").alias("component"), F.col("component").alias("wider"))
    named = materialize(
        named.join(last, "component", "left").select(
            "n", "h1", "h2", F.coalesce("wider", "component").alias("component_id")
        )
    )
    return slim.join(named, ["n", "h1", "h2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


_LIGHT = "doc_id long, n long, h1 long, h2 long, k1 long, k2 long, last long, sig binary, prefix array<long>"


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    m = mix(tokens)
    return int(_signed(m.sum(dtype=np.uint64, keepdims=True))[0]), int(
        _signed(np.bitwise_xor.reduce(mix(m), keepdims=True))[0]
    )


def _hot_tokens(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Tokens in the hash-order prefixes of very many documents: at most ``HOT_TOKENS``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        begin()

        def flush() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 2
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(token[keep])), pa.array(times[keep].astype(np.int64))], ["token", "times"]
            )

        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), width)
                if len(tokens):
                    held.append(tokens[: _prefix(len(tokens), percent)])
                    count += len(held[-1])
                if count >= _TALLY:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()
        held.clear()
        tidy()

    small_batches(docs.sparkSession)
    rows = (
        docs.select("text")
        .mapInArrow(tally, "token long, times long")
        .groupBy("token")
        .agg(F.sum("times").alias("times"))
        .where(F.col("times") >= HOT_COUNT)
        .orderBy(F.desc("times"), "token")
        .limit(HOT_TOKENS)
        .select("token")
        .toArrow()
    )
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _describe(hot: np.ndarray, width: int, percent: int):
    def run(rows: dict) -> list:
        out = [[] for _ in range(9)]
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            t = shingle_set(text, width)
            if not len(t):
                values = (doc_id, 0, 0, 0, None, None, None, None, None)
            else:
                ordered, cold, length = t, len(t), _prefix(len(t), percent)
                if len(hot):
                    at = np.searchsorted(hot, t)
                    at[at == len(hot)] = 0
                    is_hot = hot[at] == t
                    ordered, cold = np.concatenate([t[~is_hot], t[is_hot]]), int((~is_hot).sum())
                values = (
                    doc_id,
                    len(t),
                    *_set_hash(t),
                    int(_signed(t[:1])[0]),
                    int(_signed(mix(t ^ np.uint64(0x5851F42D4C957F2D)).min(keepdims=True))[0]),
                    # Place of the prefix's last token in the order (but for one bit): hot ones are not negative.
                    int(ordered[length - 1] >> np.uint64(1)) - (0 if length > cold else 1 << 63),
                    signature(t, WIDE_BITS),
                    _signed(ordered[:length]),
                )
            for column, value in zip(out, values):
                column.append(value)
        return out

    return run


def _one_row_each(light: DataFrame) -> DataFrame:
    """One row an id: of rows that repeat an id, the one with the smallest set."""
    twice = (
        light.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", "h1", "h2")).alias("pick"))
        .where("c > 1")
    )
    if twice.isEmpty():
        return light
    pick = light.join(twice.select("doc_id", "pick"), "doc_id", "left").where(
        "pick is null or pick = struct(n, h1, h2)"
    )
    once = pick.where("pick is not null").dropDuplicates(["doc_id"])
    return materialize(pick.where("pick is null").unionByName(once).drop("pick"))


def _label(copies: DataFrame, found: DataFrame) -> DataFrame:
    """``copies`` with the component of each representative."""
    return materialize(
        copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    )


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its rows are few enough; else joins shuffle it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Token sets of the documents in ``wanted`` (doc_id, n, h1, h2, more), from their texts."""
    more = [c for c in wanted.columns if c not in ("doc_id", "n", "h1", "h2")]
    joined = docs.join(_small(wanted, 48 + 24 * len(more)), "doc_id")
    schema = "doc_id long, n long, tokens binary" + "".join(f", {c} {wanted.schema[c].dataType.simpleString()}" for c in more)

    def make():
        def run(rows: dict) -> list:
            out = [[] for _ in range(3 + len(more))]
            for k, (doc_id, text) in enumerate(zip(rows["doc_id"], rows["text"])):
                t = shingle_set(text, width)
                if len(t) == rows["n"][k] and _set_hash(t) == (rows["h1"][k], rows["h2"][k]):
                    for column, value in zip(out, (doc_id, len(t), t.tobytes(), *(rows[c][k] for c in more))):
                        column.append(value)
            return out

        return run

    return map_rows(joined.select("doc_id", "text", "n", "h1", "h2", *more), schema, make)


def _buckets(df: DataFrame, size: str) -> int:
    """How many Python groups of about ``GROUP_BYTES`` the rows make."""
    return max(1, int((df.agg(F.sum(F.expr(size))).first()[0] or 0) // GROUP_BYTES + 1))


def _tree_links(docs: DataFrame, copies: DataFrame, named: DataFrame | None, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` (a forest) among documents that share a minimum hash.

    With ``named``, one document speaks for its component in each group.
    """
    base = copies.withColumn("component", F.col("rep")) if named is None else named
    member = base.select(
        "rep",
        "component",
        F.explode(F.array(F.xxhash64(F.lit(1), "k1"), F.xxhash64(F.lit(2), "k2"))).alias("key"),
    )
    if named is not None:
        member = member.groupBy("key", "component").agg(F.min("rep").alias("rep"))
    counts = materialize(member.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    if named is not None:  # only groups that were split can hold pairs not yet compared
        split = materialize(
            copies.select(F.explode(F.array(F.xxhash64(F.lit(1), "k1"), F.xxhash64(F.lit(2), "k2"))).alias("key"))
            .groupBy("key")
            .count()
            .where(F.col("count") > TREE_ROWS)
            .select("key")
        )
        counts = counts.join(split, "key", "left_semi")
    tree = (
        member.join(counts, "key")
        .withColumn("of", F.ceil(F.col("c") / F.lit(TREE_ROWS)))
        .select("rep", F.xxhash64("key", F.pmod(F.xxhash64("rep"), "of")).alias("tree"))
        .groupBy("rep")
        .agg(F.collect_set("tree").alias("trees"))
    )
    wanted = materialize(
        tree.join(copies.select("rep", "n", "h1", "h2"), "rep").select(
            F.col("rep").alias("doc_id"), "n", "h1", "h2", "trees"
        )
    )
    buckets = _buckets(wanted, "(8 * n + 64) * size(trees)")
    rows = _sets(docs, wanted, width).withColumn("tree", F.explode("trees")).drop("trees")
    rows = rows.withColumn("bucket", F.pmod("tree", F.lit(buckets)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        with clean():
            ids = pdf["doc_id"].to_numpy()
            sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
            forest = Forest(len(ids))
            trees = pdf["tree"].to_numpy()
            for i, j in candidate_pairs(pdf["n"].to_numpy(), as_words([signature(t) for t in sets]), percent, tree=trees):
                for x, y in zip(i.tolist(), j.tolist()):
                    if forest.find(x) != forest.find(y) and linked(
                        overlap(sets[x], sets[y]), len(sets[x]), len(sets[y]), percent
                    ):
                        forest.union(x, y)
            root = np.array([forest.find(x) for x in range(len(ids))], np.int64)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return materialize(rows.groupBy("bucket").applyInPandas(join, "a long, b long"))


def _meetings(met: DataFrame) -> DataFrame:
    """Rows ``bucket, doc_id, tree, side, cross`` of ``token, doc_id, c, place``: documents under the trees they meet in.

    A token of many documents is cut into sides, and each pair of sides makes a
    tree; its rows are dealt to as many trees as there are sides, and the buckets
    are counted by those rows.
    """
    long = met.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / F.lit(PLACE_ROWS)).alias("parts")).where("parts > 1")
    split = F.when(F.col("c") > 2 * BLOCK_ROWS, F.ceil(F.col("c") / F.lit(BLOCK_ROWS))).otherwise(1)
    total = met.agg(F.sum(split)).first()[0] or 0  # rows after they are dealt to the sides of hot tokens
    buckets = max(1, int(total * _MEET_BYTES // GROUP_BYTES + 1))
    return (
        met.join(_small(materialize(long), 24), "place", "left")
        .withColumns(
            {
                "place": F.xxhash64("place", F.pmod("token", F.coalesce("parts", F.lit(1)))),
                "of": split,
                "side": F.pmod(F.xxhash64("doc_id"), "of"),
            }
        )
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        .withColumn("tree", F.xxhash64("token", F.least("side", "other"), F.greatest("side", "other")))
        # Tokens of one passage share their outer components: in one task, their pairs add up before they are shuffled.
        .withColumn("bucket", F.pmod(F.when(F.col("of") > 1, F.col("tree")).otherwise(F.col("place")), F.lit(buckets)))
        .select("bucket", "doc_id", "tree", "side", (F.col("side") != F.col("other")).alias("cross"))
    )


def _prefix_links(docs: DataFrame, rep: DataFrame, named: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components, complete by prefix filtering; ``rep`` goes when it is done with."""
    # One exchange of the tokens serves both their counts and the rows under those that are left.
    entry = rep.select("doc_id", "component", F.explode("prefix").alias("token")).repartition("token")
    meets = (
        entry.groupBy("token")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"))
        .where("lo != hi")
        .select("token", "c", F.xxhash64("lo", "hi").alias("place"))
    )
    met = materialize(entry.join(meets, "token").select("token", "doc_id", "c", "place"))
    rows = _meetings(met)
    # A document goes to a bucket once, however many of its tokens meet there.
    null = F.lit(None)
    about = rows.select("bucket", "doc_id").distinct().join(rep.select("doc_id", "component", "n", "last", "sig"), "doc_id")
    both = rows.select("bucket", "doc_id", "tree", "side", "cross", *(null.cast("long").alias(c) for c in ("component", "n", "last")), null.cast("binary").alias("sig"))
    both = both.unionByName(about.select("bucket", "doc_id", *(null.cast(t).alias(c) for c, t in (("tree", "long"), ("side", "long"), ("cross", "boolean"))), "component", "n", "last", "sig"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        table = pa.Table.from_batches(list(batches))
        known = pc.is_valid(table.column("n"))
        docs, rows = table.filter(known), table.filter(pc.invert(known))
        del table
        ids = docs.column("doc_id").to_numpy()
        order = np.argsort(ids)
        ids, of, size, last = (docs.column(c).to_numpy()[order] for c in ("doc_id", "component", "n", "last"))
        wide = as_words(docs.column("sig").to_pylist())[order] if len(ids) else np.empty((0, WIDE_BITS // 64), np.uint64)
        narrow, after = folded(wide), size - _prefix(size, percent)
        at = np.searchsorted(ids, rows.column("doc_id").to_numpy())
        tree, side, cross = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "side", "cross"))
        del rows, docs

        def made(key: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
            i, j = key // len(ids), key % len(ids)
            rest = np.where(last[i] < last[j], after[i], np.where(last[j] < last[i], after[j], np.maximum(after[i], after[j])))
            columns = ids[i], ids[j], of[i], of[j], size[i] + size[j], rest, common
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_PAIR)

        tally = PairTally(_TALLY_PAIRS)
        for i, j in candidate_pairs(size[at], narrow[at], percent, of[at], tree):
            keep = ~cross[i] | (side[i] != side[j])
            i, j = at[i[keep]], at[j[keep]]
            keep = may_link(wide, size, i, j, percent)
            i, j = i[keep], j[keep]
            for full in tally.add(np.minimum(i, j) * len(ids) + np.maximum(i, j)):
                yield made(*full)
        for full in tally.rest():
            yield made(*full)
        del wide, narrow
        tidy()

    pairs = materialize(
        both.groupBy("bucket")
        .applyInArrow(join, ", ".join(f"{c} long" for c in _PAIR))
        .groupBy("x", "y", "a", "b", "sizes", "rest")
        .agg(F.sum("common").alias("common"))
        .where((100 + percent) * (F.col("common") + F.col("rest")) >= percent * F.col("sizes"))
        .select("x", "y", "a", "b")
    )
    drop(rep, met)
    ids = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
    wanted = materialize(named.select(F.col("rep").alias("doc_id"), "n", "h1", "h2").join(ids, "doc_id", "left_semi"))
    sets = materialize(_sets(docs, wanted, width).dropDuplicates(["doc_id"]))
    # Pairs meet by blocks of components, so that a set travels once for a pair of blocks, not for each pair.
    split = named.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIR_BLOCK)).alias("of")).where("of > 1")
    many = _small(materialize(split), 24)
    keyed = (
        pairs.join(many.select(F.col("component").alias("a"), F.col("of").alias("oa")), "a", "left")
        .join(many.select(F.col("component").alias("b"), F.col("of").alias("ob")), "b", "left")
        .select(
            *(c for c in ("x", "y", "a", "b")),
            F.xxhash64(
                "a", F.pmod(F.xxhash64("x"), F.coalesce("oa", F.lit(1))), "b", F.pmod(F.xxhash64("y"), F.coalesce("ob", F.lit(1)))
            ).alias("key"),
        )
    )
    keyed = materialize(keyed)
    used = (
        keyed.select("key", F.col("x").alias("doc_id")).unionByName(keyed.select("key", F.col("y").alias("doc_id"))).distinct()
    )
    pair_bytes = keyed.count() * _PAIR_BYTES  # short documents make more bytes of pairs than of sets
    buckets = max(_buckets(used.join(wanted.select("doc_id", "n"), "doc_id"), "8 * n + 64"), int(pair_bytes // GROUP_BYTES + 1))
    bucket = F.pmod("key", F.lit(buckets)).alias("bucket")
    left = keyed.select("x", "y", "a", "b", bucket)
    right = used.select("doc_id", bucket).distinct().join(sets.select("doc_id", "tokens"), "doc_id")

    def verify(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        with clean():
            of = {d: np.frombuffer(t, np.uint64) for d, t in zip(s["doc_id"], s["tokens"])}
            done = set()
            for x, y, a, b in zip(p["x"], p["y"], p["a"], p["b"]):
                if (a, b) not in done and linked(overlap(of[x], of[y]), len(of[x]), len(of[y]), percent):
                    done.add((a, b))
            return pd.DataFrame(sorted(done), columns=["a", "b"]).astype("int64")

    return materialize(
        left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(verify, "a long, b long").distinct()
    )
