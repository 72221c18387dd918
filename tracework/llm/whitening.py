"""Whitening of embeddings along their leading principal components.

Vectors become whole numbers. Three passes over the rows follow, each giving one
small result a task: counts and sums, the covariance about the mean, and the
covariance of what comes out. Only matrices as wide as a vector reach the driver,
where ``spectrum`` finds the components; rows never leave their partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import clean, usable_vector
from tracework.llm.spectrum import leading

#: Scale and offset of the whole numbers; entries beyond the last have no such number and count as non-finite.
UNITS, OFFSET, FURTHEST = 1024, 100_000, float(1 << 61)
#: Rows worked on together in a task.
ROWS = 4096
#: Partial results that one task adds up.
_FAN = 64


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows projected on the leading components, each scaled to variance one: a row for each vector and component.

    Returns ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. The fit goes over all usable vectors: not null, not empty,
    without null or non-finite entries. Where lengths differ, those of the
    commonest length (of equal ones the greatest) are used, others get no row.
    Components without variance (rank too low, one vector, equal vectors) have no
    rows; an empty table gives none. Repeated rows and null or repeated ids each
    count. ``deviation`` is null where it is beyond a long; ``deviation_exact``, a
    decimal, is null beyond 38 digits only. Other columns are ignored, whatever
    their names.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    fits = F.forall("e", lambda x: F.abs(x) * F.lit(float(UNITS)) < FURTHEST)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = rows.where(usable_vector("e") & (F.size("e") > 0) & fits)
    sums = rows.select("e").mapInArrow(_sums, "dims int, n long, place int, high decimal(38,0)").groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("s"))
    found = sums.collect()  # one row for each place of a vector and length that occurs
    lengths = {r.dims: r.n for r in found}
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = max(lengths, key=lambda d: (lengths[d], d))
    n = lengths[dims]
    total = [int(r.s) for r in sorted((r for r in found if r.dims == dims), key=lambda r: r.place)]
    rows = rows.where(F.size("e") == dims)
    base = np.array([s // n for s in total], np.int64)
    rest = [s % n for s in total]
    part = np.array([float(Fraction(r, n)) for r in rest])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base).astype(np.float64) - part

    covariance = _covariance(rows, lambda x: centred(x)) / n
    trace = float(np.trace(covariance))
    values, axes = leading(covariance, min(components, dims))
    real = values > 64 * np.finfo(float).eps * dims * max(trace, 0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    again = _covariance(rows, lambda x: centred(x) @ scaled) / n
    error = float(np.abs(again - np.eye(len(values))).max())
    explained = values / trace
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with clean():
            for rb in _slices(batches):
                x = _whole(rb.column("e"))
                exact = _deviation(x - base, rest, n)
                fits_long = [None if abs(d) >= 1 << 63 else d for d in exact]
                as_decimal = [None if d >= 10**38 else Decimal(d) for d in exact]
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        rb.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n, np.int64)),
                        pa.array(fits_long, pa.int64()).take(pa.array(each)),
                        pa.array((centred(x) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                        pa.array(as_decimal, pa.decimal128(38, 0)).take(pa.array(each)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return rows.mapInArrow(project, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for start in range(0, rb.num_rows, ROWS):
            yield rb.slice(start, ROWS)


def _whole(column: pa.Array) -> np.ndarray:
    """``floor(1024 * c) + 100000`` of vectors of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * UNITS).astype(np.int64).reshape(len(column), -1) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and exact sums of this task, by length and place."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    with clean():
        for rb in _slices(batches):
            sizes = rb.column("e").value_lengths().to_numpy()
            for d in map(int, np.unique(sizes)):
                x = _whole(rb.column("e").filter(pa.array(sizes == d)))
                # Halves of the bits: their sums over a batch fit a long, and whole numbers of any size take them up.
                s = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
                rows, before = found.get(d, (0, 0))
                found[d] = rows + len(x), before + s
        for d, (rows, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array([rows] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))],
                names=["dims", "n", "place", "high"],
            )


def _covariance(rows: DataFrame, centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the products of centred entries, as a matrix on the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        with clean():
            for rb in _slices(batches):
                z = centre(_whole(rb.column("e")))
                out = z.T @ z if out is None else out + z.T @ z
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(out)), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["place", "line"]
                )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": pdf["place"].iloc[:1], "line": [np.sum(np.stack(pdf["line"].to_list()), axis=0)]})

    lines = rows.select("e").mapInArrow(products, "place int, line array<double>")
    # First some of the partial results together, then those: no task adds up one line of all tasks.
    few = lines.withColumn("deal", F.spark_partition_id() % _FAN).groupBy("place", "deal").applyInPandas(lambda pdf: add(pdf), "place int, line array<double>")
    all_ = few.groupBy("place").applyInPandas(lambda pdf: add(pdf), "place int, line array<double>").collect()
    out = np.array([r.line for r in sorted(all_, key=lambda r: r.place)])
    return (out + out.T) / 2


def _deviation(z: np.ndarray, rest: list[int], n: int) -> list[int]:
    """The sum over places of ``(n * x - S) ** 2`` as whole numbers, from ``z = x - S div n`` and the remainders."""
    most = int(np.abs(z).max(initial=0)) + 1
    if most * most * z.shape[1] >= 1 << 62 or n * most * z.shape[1] >= 1 << 62:
        z = z.astype(object)
        small = np.array(rest, object)
    else:
        small = np.array(rest, np.int64)
    squares, mixed, own = (z * z).sum(axis=1), (z * small).sum(axis=1), sum(r * r for r in rest)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares.tolist(), mixed.tolist())]
