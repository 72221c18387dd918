"""Connected components: forests inside partitions first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.plans.materialize import drop, materialize


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Undirected components of an edge list.

    Returns ``node, component`` with the smallest id of the component, for every
    node of an edge that joins two different ids (others are alone, and absent).
    Null ends are ignored. Each round is two group-by minima and two ``hub_join``.
    Rounds end once only stars are left. Raises if ``max_rounds`` do not suffice.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    for _ in range(max_rounds):
        settled, n = _settled(e)
        if settled:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        count = F.count(F.lit(1)).alias("rows")
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), count), n)
        large = materialize(
            hub_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), count), n)
        joined = hub_join(large, least, "u")
        new = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct(),
            n,
        )
        drop(e, low, large, least)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Rows that one key of a join may bring into a task; keys with more are broadcast.
HUB_ROWS = 100_000


def hub_join(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` joined with ``keys``, one row a key, where few keys may have most of the rows.

    ``keys`` is a written table whose column ``rows``, not part of the result, is at
    least how many rows a key has. Those of more than ``HUB_ROWS`` are few, as many as
    the sum of ``rows`` has room for: they are broadcast, so their rows stay where they
    are, and no task gets all rows of a great component. The others are shuffled, as files of numbers
    are so small that tables of all nodes would be broadcast through the driver else.
    """
    hubs, others = keys.where(F.col("rows") > HUB_ROWS).drop("rows"), keys.where(F.col("rows") <= HUB_ROWS).drop("rows")
    rest = rows.join(F.broadcast(hubs.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hubs), on).unionByName(rest.join(others.hint("merge"), on))


#: Edges that a task joins to a forest at a time, and as many forest edges as one task may end with.
FOREST_EDGES = 1 << 20


def forest_components(edges: DataFrame, a: str = "src", b: str = "dst", at_once: int = FOREST_EDGES) -> DataFrame:
    """``node, component`` as ``connected_components``, with fewer edges in the shuffles.

    Each partition's edges become a forest of stars, ``at_once`` edges at a time, so
    only one edge a node and partition is shuffled. Those are dealt by their node, as a
    root may be that of all, and joined again; once they are ``at_once`` at most, one
    task ends the work, and where a second round has not got that far, star steps do.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    schema = f"u {both.schema['u'].dataType.simpleString()}, v {both.schema['v'].dataType.simpleString()}"

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= at_once:
                stars = _stars(pd.concat(held))
                # A forest much smaller than its edges is carried on; one of new nodes mostly goes out.
                if 2 * len(stars) > size:
                    yield stars
                    held, size = [], 0
                else:
                    held, size = [stars], len(stars)
        if held:
            yield _stars(pd.concat(held))

    e = materialize(both.mapInPandas(forests, schema))
    for last in (False, True):
        n = e.count()
        if n <= at_once:
            new = materialize(e.coalesce(1).mapInPandas(forests, schema), 0)
            drop(e)
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if not last:
            new = materialize(e.repartition("u").mapInPandas(forests, schema))
            drop(e)
            e = new
    return connected_components(e, "u", "v")


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges as stars: each node but the least of its component with that least node."""
    ids, ends = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    u, v = ends[: len(pdf)], ends[len(pdf) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        u, v = u[open_], v[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(ids))
    return pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})


def _settled(e: DataFrame) -> tuple[bool, int]:
    """Whether the edges are stars (each node has one smaller neighbour or larger ones, not both), and how many edges there are."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select("v", F.lit(0).alias("up"), F.lit(1).alias("down")).toDF("node", "up", "down")
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = seen.agg(F.count_if(F.col("up") + F.col("down") > 1), F.sum("up")).first()
    return found[0] == 0, int(found[1] or 0)
