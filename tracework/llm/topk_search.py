"""Exact top-k by integer inner product, a block of candidates at a time.

Vectors become integer terms (one for each dimension). Candidates are put in an
order that keeps similar vectors together and cut into shards, and these into
document-range blocks; each shard and block has a forward index (its matrix) and
the least and greatest value of every term. For a query, the bound of a shard or
block is the sum over terms of the greatest product, so blocks are opened in the
order of their bounds until the next bound falls below the query's kth score.

The bounds of shards are looked at before any row moves: queries travel in groups
of similar ones, meet the small table of shard maxima, and go on only to shards
whose bound reaches the query's kth score so far. That is done in rounds, the best
shards of each query first, so later rounds have a kth score to prune by. What is
shuffled is the queries that a shard's bound lets in, and a shard once for each
``PART`` groups of them. Neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracework.llm.common import clean, one_row_each, small_batches, usable_vector
from tracework.plans.materialize import materialize

#: Candidates in a block, blocks in a shard, queries in a group at most, groups that one copy of a shard serves.
BLOCK, SHARD, QUERIES, PART = 256, 64, 2048, 64
#: Bytes of the matrix of a shard or of a group of queries that wide vectors are held to; shards whose maxima lie in one row.
MATRIX_BYTES, CHUNK = 16 << 20, 1024
#: Shards, of those in a row of maxima, that a query has seen after each round; the last round takes the rest.
ROUNDS = (1, 8, None)
#: Bits of the code by which similar vectors come together; a cell of one code is cut into as many shards as it needs.
CODE_BITS = 16
#: Scale of the components.
UNITS = 256
#: Doubles are exact below the first; sums of bounds fit a long below the second. The lowest threshold has a negative that fits.
_EXACT, _LONG, _LOWEST = 1 << 53, 1 << 62, -(1 << 63) + 1


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 6,
) -> DataFrame:
    """The ``k`` best partners of each query row among all rows of ``vectors``.

    The score is the inner product of ``floor(256 * x)`` over the components; a
    shorter vector counts as padded with zeros. A row is no partner of the query
    with its own id. Ties go to the smaller id. Vectors that are null or hold null
    or non-finite components take no part; rows that repeat an id count once,
    with the smallest vector. Returns ``query_id, rank, vec_id, score``; with no
    other candidate a query has no rows, and an empty table gives none. Scores must
    fit a long. Other columns are ignored, whatever their names.
    """
    small_batches(vectors.sparkSession)
    docs = _terms(vectors, id_col, vector_col)
    asked = _terms(queries, id_col, vector_col)
    # Copies of a vector have one score with any query: only the k least ids can be answers, and one more, as a query is not its own.
    copies = W.partitionBy("v").orderBy("vec_id")
    docs = docs.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    dims = max(int(t.agg(F.max(F.size("v"))).first()[0] or 0) for t in (docs, asked)) or 1
    wide = max(1, MATRIX_BYTES // (8 * dims))
    docs, asked = (materialize(t.withColumn("code", _code(dims, seed))) for t in (docs, asked))
    shards = materialize(_shards(_dealt(docs, min(BLOCK * SHARD, wide), "shard"), dims))
    maxima = materialize(_maxima(shards))
    top = int(shards.agg(F.max("shard")).first()[0] or 0)
    asked = materialize(_dealt(asked, min(QUERIES, wide), "grp"))

    best = None
    seen = 0
    for upto in ROUNDS:
        floors = asked.withColumn("floor", F.lit(_LOWEST)) if best is None else asked.join(_kth(best, k), "vec_id", "left").withColumn(
            "floor", F.coalesce("floor", F.lit(_LOWEST))
        )
        visits = materialize(_visits(floors, maxima, top // CHUNK + 1, dims, seen, upto))
        found = _answers(visits, shards, dims, k)
        best = materialize(_top(found if best is None else found.unionByName(best.drop("rank")), k))
        if upto is None or upto > min(top, CHUNK):  # no chunk has more shards
            break
        seen = upto
    return best.select("query_id", "rank", "vec_id", "score")


def _code(dims: int, seed: int):
    """Similar vectors have similar codes: signs of fixed random projections."""
    planes = np.random.default_rng((seed, dims)).choice([-1, 1], (CODE_BITS, dims))
    sign = [
        F.aggregate(
            F.zip_with("v", F.array(*(F.lit(float(x)) for x in p)), lambda a, b: F.coalesce(a * b, F.lit(0.0))),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        > 0
        for p in planes
    ]
    return sum((s.cast("int") * (1 << i) for i, s in enumerate(sign)), F.lit(0))


def _dealt(df: DataFrame, size: int, name: str) -> DataFrame:
    """``df`` with the range, of about ``size`` rows in the order of codes, that each row lies in; rows of one code go by a hash.

    There are at most 2 ** CODE_BITS codes, so the table of their counts is short.
    """
    cells = df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(W.orderBy("code")) - F.col("n"))
    u = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(1 << 53))
    place = F.col("before") + F.floor(u * F.col("n"))
    return df.join(F.broadcast(cells), "code").withColumn(name, F.floor(place / F.lit(size)).cast("int")).drop("n", "before")


def _shards(docs: DataFrame, dims: int) -> DataFrame:
    """One row a shard: its ids, its matrix, and the least and greatest value of each term."""

    def pack(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        with clean():
            d = d.sort_values(["code", "vec_id"], kind="stable")
            m = _matrix(d["v"], dims)
            ids = d["vec_id"].to_numpy(np.int64)
            return pd.DataFrame(
                {
                    "shard": [key[0]],
                    "ids": [ids.tobytes()],
                    "m": [_packed(m)],
                    "high": [m.max(axis=0).tobytes()],
                    "low": [m.min(axis=0).tobytes()],
                }
            )

    schema = "shard int, ids binary, m binary, high binary, low binary"
    return docs.groupBy("shard").applyInPandas(pack, schema)


def _maxima(shards: DataFrame) -> DataFrame:
    """The bounds of ``CHUNK`` shards a row."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers = rows["shard"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"chunk": [key[0]], "shards": [numbers], "high": [b"".join(rows["high"])], "low": [b"".join(rows["low"])]})

    rows = shards.select(F.floor(F.col("shard") / CHUNK).cast("int").alias("chunk"), "shard", "high", "low")
    return rows.groupBy("chunk").applyInPandas(pack, "chunk int, shards binary, high binary, low binary")


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` beside the row of ``right`` with its key; that row has a copy for each ``part`` of ``left``, so no key is hot."""
    copies = right.join(left.select(key, "part").distinct(), key)
    return left.join(copies, [key, "part"])


def _visits(asked: DataFrame, maxima: DataFrame, chunks: int, dims: int, seen: int, upto: int | None) -> DataFrame:
    """The queries of each group that each shard is to see, of the shards in places ``seen`` to ``upto`` of their chunk by bound."""

    def pack(key: tuple, q: pd.DataFrame) -> pd.DataFrame:
        with clean():
            ids, floor = (q[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "floor"))
            return pd.DataFrame({"grp": [key[0]], "qids": [ids], "q": [_packed(_matrix(q["v"], dims))], "floor": [floor]})

    groups = asked.groupBy("grp").applyInPandas(pack, "grp int, qids binary, q binary, floor binary")
    groups = groups.withColumns(
        {"part": F.floor(F.col("grp") / PART).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))}
    )

    def choose(batches):
        with clean():
            for batch in batches:
                for part, q, *long in zip(*(batch[c] for c in ("part", "q", "qids", "floor", "shards", "high", "low"))):
                    qids, floor, numbers, high, low = (np.frombuffer(x, np.int64) for x in long)
                    q = _unpacked(q, dims)
                    bound = _bounds(q, high.reshape(-1, dims), low.reshape(-1, dims))
                    place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                    go = (place >= seen) & (bound >= floor[:, None])
                    if upto is not None:
                        go &= place < upto
                    for at in np.flatnonzero(go.any(axis=0)):
                        some = go[:, at]
                        yield pd.DataFrame(
                            {
                                "shard": [numbers[at]],
                                "part": [part],
                                "n": [int(some.sum())],
                                "qids": [qids[some].tobytes()],
                                "q": [_packed(q[some])],
                                "floor": [floor[some].tobytes()],
                            }
                        )

    return _beside(groups, maxima, "chunk").mapInPandas(choose, "shard int, part int, n int, qids binary, q binary, floor binary")


def _answers(visits: DataFrame, shards: DataFrame, dims: int, k: int) -> DataFrame:
    """The best rows of each visit."""

    def search(batches):
        with clean():
            for batch in batches:
                for qids, q, floor, ids, m in zip(*(batch[c] for c in ("qids", "q", "floor", "ids", "m"))):
                    qids, floor, ids = (np.frombuffer(x, np.int64) for x in (qids, floor, ids))
                    yield _search(qids, _unpacked(q, dims), floor, ids, _unpacked(m, dims), k)

    met = _beside(visits, shards.select("shard", "ids", "m"), "shard")
    return met.mapInPandas(search, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kth(best: DataFrame, k: int) -> DataFrame:
    """The kth score so far: a lower bound of the true one."""
    return best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))


def _terms(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = one_row_each(rows.where("vec_id is not null"), "vec_id", "e").where(usable_vector("e"))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(UNITS))).cast("long")).alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for row, v in zip(out, column):
        row[: len(v)] = v
    return out


def _packed(m: np.ndarray) -> bytes:
    """A matrix in the narrowest whole numbers that hold it, after the number of their bytes."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + m.astype(kind).tobytes()


def _unpacked(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, np.dtype(f"i{b[0]}"), offset=1).reshape(-1, dims).astype(np.int64)


def _most(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> int:
    """No sum of products of these queries with rows between ``low`` and ``high`` is larger."""
    size = lambda up, down: np.maximum(up.max(axis=0, initial=0).astype(object), -down.min(axis=0, initial=0).astype(object))
    return int((size(q, q) * size(high, low)).sum())


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The greatest score that each query can have with a row between each ``low`` and ``high``."""
    most = _most(q, high, low)
    kind = np.int64 if _EXACT <= most < _LONG else np.float64
    q, high, low = q.astype(kind), high.astype(kind), low.astype(kind)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if most >= _LONG:  # bounds may be larger than longs although scores are not: in doubles, rounded up
        bound += (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-12
    return bound


def _search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, did: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    cut = np.arange(0, len(d), BLOCK)
    high, low = np.maximum.reduceat(d, cut, axis=0), np.minimum.reduceat(d, cut, axis=0)
    bound = _bounds(q, high, low)
    kind = np.float64 if _most(q, high, low) < _EXACT else np.int64
    q, d = q.astype(kind), d.astype(kind)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), _LOWEST, np.int64)
    who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    least = floor
    alive = np.arange(len(q))
    for step in range(len(cut)):
        block = turn[alive, step]
        kth = np.maximum(best[alive, -1], least[alive])
        go = bound[alive, block] >= kth  # equal bounds may hide ties with smaller ids
        alive, block = alive[go], block[go]
        if not len(alive):
            break
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            a, s = alive[rows], cut[block[rows[0]]]
            ids = did[s : s + BLOCK]
            score = (q[a] @ d[s : s + BLOCK].T).astype(np.int64)
            own = qid[a][:, None] == ids
            hit = (score >= np.maximum(best[a, -1], least[a])[:, None]) & ~own
            for x in np.flatnonzero(hit.any(axis=1)):
                row = a[x]
                at = np.flatnonzero(hit[x])
                s_all = np.concatenate([best[row], score[x, at]])
                w_all = np.concatenate([who[row], ids[at]])
                pick = np.lexsort((w_all, -s_all))[:k]
                best[row], who[row] = s_all[pick], w_all[pick]
    real = who != np.iinfo(np.int64).max
    return pd.DataFrame({"query_id": np.repeat(qid, real.sum(axis=1)), "vec_id": who[real], "score": best[real]})
