"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of whole texts that one call of a Python function gets.
TEXT_ROWS = 500
#: Bytes of one batch for Python, where the session leaves Spark's defaults.
BATCH_BYTES = 4 << 20

_HELD: dict[str, tuple[int, Any]] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker for the later tasks of the same stage only."""
    stage = begin()
    if name not in _HELD:
        _HELD[name] = stage, make()
    return _HELD[name][1]


def begin() -> int:
    """The stage of this task; what was held for other stages goes."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    for name in [n for n, (s, _) in _HELD.items() if s != stage]:
        del _HELD[name]
    return stage


def tidy() -> None:
    """Give freed memory back: a Python worker serves many tasks, also of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def clean() -> Iterator[None]:
    """Around the work of one group or task: what other stages held goes before, freed memory after."""
    begin()
    try:
        yield
    finally:
        tidy()


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch for Python, where the session leaves Spark's default: whole texts make batches of 10,000 rows large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], list]]) -> DataFrame:
    """``mapInArrow`` over column lists.

    ``make`` is called once in each task and gives a function from a dict of
    column lists (at most ``TEXT_ROWS`` rows) to a list of output columns.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with clean():
            function = None
            for batch in batches:
                function = function or make()
                for start in range(0, batch.num_rows, TEXT_ROWS):
                    part = batch.slice(start, TEXT_ROWS)
                    columns = function({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, arrow)], schema=arrow
                    )
            function = None

    return df.mapInArrow(run, struct)


def bounded_sample(df: DataFrame, key: str | tuple[str, ...], most: int, seed: int = 0) -> DataFrame:
    """A deterministic sample by the hash of ``key`` (one column or several): about ``most`` rows, or all if there are fewer.

    Rows that are equal in all of ``key`` are in or out together, so it should tell different rows apart.
    """
    rows = df.count()
    if rows <= most:
        return df
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *([key] if isinstance(key, str) else key)), 11) / F.lit(float(1 << 53))
    return df.where(share < 0.95 * most / rows)


def one_row_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` with one row a key, the smallest value; rows with a null key stay as they are."""
    df = df.select(key, value)
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if twice.isEmpty():
        return df
    return df.join(twice, key, "left_anti").unionByName(
        df.join(twice, key, "left_semi").groupBy(key).agg(F.min(value).alias(value))
    )


def usable_vector(column: str):
    """Whether a vector column is neither null nor empty nor holds null or non-finite components."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & finite, F.lit(False))
