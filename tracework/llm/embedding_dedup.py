"""Near-duplicate vectors by lattice hashing.

Several tables project unit vectors to eight dimensions and take the nearest
point of the E8 lattice as the home cell. A vector is stored under its homes and
probes, besides them, the neighbouring cells whose centres lie nearest. Vectors
that meet in a cell are compared by cosine in double precision.

Equal vectors fold into one before hashing and count with their number after
it. Cells where nobody meets are dropped while rows are still ids, so a vector
travels once for each cell that can hold a partner. A cell with very many
vectors is dealt out as pairs of blocks. A pair counts in the first cell where
its two vectors meet, which each task can tell from the vectors alone; so pairs
never leave the tasks: only sums of links and spanning forests do.

With 8 tables and 16 probes at scale 1.2, two vectors of 64 dimensions at cosine
0.95 meet with probability 0.999 (0.9992 of 4,000 pairs drawn at that cosine, all
of those at 0.96 and more).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import map_rows, one_row_each, usable_vector
from tracework.llm.lattice import cells
from tracework.operators.components import connected_components
from tracework.plans.materialize import materialize

BLOCK_ROWS, GROUP_BYTES = 1024, 12 << 20
#: Bytes of such a row besides its vector.
ROW_BYTES = 190
_DENSE = 32


def lattice_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    tables: int = 8,
    probes: int = 16,
    scale: float = 1.2,
    seed: int = 7,
) -> DataFrame:
    """Links of vectors with cosine at or above ``threshold``, by component.

    Returns ``vec_id, n_links, component_id, kept`` for every id. Vectors that
    are null, empty, zero, or hold null or non-finite components link with
    nothing, as do vectors of different dimensions. Rows that repeat an id
    count once, with the smallest vector; a null id is a component of its own
    (null, not kept). Other columns are ignored. An empty table gives an empty
    result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    rows = one_row_each(rows, "vec_id", "v")
    good = rows.where(
        F.col("vec_id").isNotNull() & usable_vector("v") & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False))
    )
    reps = materialize(
        good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    met = materialize(_meetings(reps, threshold, tables, probes, scale, seed))
    sums = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("others"))
    found = connected_components(met.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    named = materialize(
        reps.select("rep", "copies", F.xxhash64("v").alias("h"), "v")
        .join(sums, "rep", "left")
        .join(found, "rep", "left")
        .select(
            "h",
            "v",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    linked = good.withColumn("h", F.xxhash64("v")).join(named, ["h", "v"]).select("vec_id", "links", "component")
    return (
        rows.select("vec_id")
        .join(linked, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _meetings(reps: DataFrame, threshold: float, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """Rows ``a, b, w``: b null: w more links of a; else an edge of a spanning forest."""

    def hash_all():
        def run(r: dict) -> list:
            out = [[], [], []]
            dims = np.array([len(v) for v in r["v"]])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                home, near = cells(_unit(np.array([r["v"][k] for k in at], float)), tables, probes, scale, seed)
                ids = np.array([r["rep"][k] for k in at], np.int64)
                out[0].append(np.repeat(ids, tables * (1 + probes)))
                out[1].append(np.concatenate([home[:, :, None], near], axis=2).ravel())
                out[2].append(np.tile(np.arange(1 + probes) == 0, len(at) * tables))
            return [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, bool))]

        return run

    entry = map_rows(reps.select("rep", "v"), "rep long, cell long, home boolean", hash_all)
    full = (
        entry.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("c"), F.count_if("home").alias("stored"))
        .where("stored > 0 and c > 1")
    )
    full = materialize(full.select("cell", "c"))
    where = materialize(
        entry.join(full, "cell")
        .groupBy("rep")
        .agg(F.collect_list(F.struct("cell", "home", "c")).alias("cells"))  # at most tables * (1 + probes)
    )
    rows = _dealt(reps, where, full)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        dims = pdf["v"].map(len).to_numpy()
        for d in np.unique(dims):
            part = pdf[dims == d].sort_values("block", kind="stable")
            out.append(_compare(part, threshold, tables, probes, scale, seed))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy("bucket").applyInPandas(compare, "a long, b long, w long")


def _dealt(reps: DataFrame, where: DataFrame, full: DataFrame) -> DataFrame:
    """Rows ``rep, copies, v, cell, home, side, cross, block, bucket``: vectors under the blocks they are compared in.

    A cell of many vectors is cut into sides, and each pair of sides makes a block;
    its rows are dealt to as many blocks as there are sides, and the buckets are
    counted by those rows, so that none holds much more than ``GROUP_BYTES``.
    """
    sides = lambda c: F.when(c > 2 * BLOCK_ROWS, F.ceil(c / F.lit(BLOCK_ROWS))).otherwise(1)
    dealt = full.agg(F.sum(F.col("c") * sides(F.col("c")))).first()[0] or 0
    width = reps.agg(F.avg(F.size("v"))).first()[0] or 0
    buckets = max(1, int(dealt * (ROW_BYTES + 8 * width) // GROUP_BYTES + 1))
    return (
        reps.join(where, "rep")
        .select("rep", "copies", "v", F.explode("cells").alias("e"))
        .withColumn("of", sides(F.col("e.c")))
        .withColumn("side", F.pmod(F.xxhash64("rep"), "of"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        .select(
            "rep",
            "copies",
            "v",
            F.col("e.cell").alias("cell"),
            F.col("e.home").alias("home"),
            "side",
            (F.col("side") != F.col("other")).alias("cross"),
            F.xxhash64("e.cell", F.least("side", "other"), F.greatest("side", "other")).alias("block"),
        )
        .withColumn("bucket", F.pmod("block", F.lit(buckets)))
    )


def _compare(pdf: pd.DataFrame, threshold: float, tables: int, probes: int, scale: float, seed: int) -> pd.DataFrame:
    rep, index = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
    some = np.zeros(len(rep), np.int64)
    some[index] = np.arange(len(index))
    vectors = np.stack(pdf["v"].to_numpy())[some]
    copies = pdf["copies"].to_numpy()[some]
    unit = _unit(vectors)
    home, side = pdf["home"].to_numpy(), pdf["side"].to_numpy()
    cross, cell, block = pdf["cross"].to_numpy(), pdf["cell"].to_numpy(), pdf["block"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    length = np.diff(np.append(start, len(block)))
    found = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        keep = (home[i] | home[j]) & (~cross[i] | (side[i] != side[j]))
        found.append((i[keep], j[keep]))

    for m in np.unique(length[(length > 1) & (length <= _DENSE)]):  # all small cells of one size at once
        i, j = np.triu_indices(m, 1)
        s = start[length == m]
        for k in range(0, len(s), 1 + 40_000 // len(i)):
            x, y = (s[k : k + 1 + 40_000 // len(i), None] + i).ravel(), (s[k : k + 1 + 40_000 // len(i), None] + j).ravel()
            near = (unit[index[x]] * unit[index[y]]).sum(axis=1) >= threshold - 1e-9
            take(x[near], y[near])
    for s, m in zip(start[length > _DENSE], length[length > _DENSE]):
        u = unit[index[s : s + m]]
        for k in range(0, m, 512):
            i, j = np.nonzero(u[k : k + 512] @ u.T >= threshold - 1e-9)
            i += k
            take(s + i[i < j], s + j[i < j])
    if not found:
        return pd.DataFrame({"a": [], "b": [], "w": []}).astype("Int64")
    i, j = (np.concatenate(x) for x in zip(*found))
    x, y, at = index[i], index[j], cell[i]
    keep = x != y
    x, y, at = x[keep], y[keep], at[keep]
    norm = np.sqrt((vectors**2).sum(axis=1))
    keep = np.concatenate(
        [
            (vectors[x[k : k + 20_000]] * vectors[y[k : k + 20_000]]).sum(axis=1)
            / (norm[x[k : k + 20_000]] * norm[y[k : k + 20_000]])
            >= threshold
            for k in range(0, len(x), 20_000)
        ]
        or [np.zeros(0, bool)]
    )
    x, y, at = x[keep], y[keep], at[keep]
    used, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
    if not len(used):
        return pd.DataFrame({"a": [], "b": [], "w": []}).astype("Int64")
    h, near = cells(unit[used], tables, probes, scale, seed)
    first = _first_meeting(h, near, inverse[: len(x)], inverse[len(x) :]) == at
    x, y = x[first], y[first]
    links = np.bincount(x, copies[y], len(rep)) + np.bincount(y, copies[x], len(rep))
    label = np.arange(len(rep))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    has, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
    return pd.DataFrame(
        {
            "a": pd.array(np.concatenate([rep[has], rep[moved]]), "Int64"),
            "b": pd.array([None] * len(has) + rep[label[moved]].tolist(), "Int64"),
            "w": pd.array(np.concatenate([links[has].astype(np.int64), np.zeros(len(moved), np.int64)]), "Int64"),
        }
    )


def _first_meeting(home: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cell in which each pair meets first: by table, then by the cell's number."""
    out = np.full(len(i), np.iinfo(np.int64).max)
    left = np.arange(len(i))
    for t in range(home.shape[1]):
        a, b = home[i[left], t], home[j[left], t]
        step = 50_000
        at_b = np.concatenate([(near[i[left[k : k + step]], t] == b[k : k + step, None]).any(axis=1) for k in range(0, len(left), step)] or [np.zeros(0, bool)])
        at_a = np.concatenate([(near[j[left[k : k + step]], t] == a[k : k + step, None]).any(axis=1) for k in range(0, len(left), step)] or [np.zeros(0, bool)])
        at_a, at_b = at_a | (a == b), at_b | (a == b)
        most = np.iinfo(np.int64).max
        cell = np.minimum(np.where(at_a, a, most), np.where(at_b, b, most))
        out[left] = cell
        left = left[~(at_a | at_b)]
        if not len(left):
            break
    return out
