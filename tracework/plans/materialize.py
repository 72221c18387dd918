"""Cutting lineage through tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task should have at least, where the number of rows is known and the exchanges make more tasks than that.
TASK_ROWS = 100_000
#: Whether the files of an exchange go once the query that made them has ended; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LISTS: list[list[DataFrame]] = []


@contextmanager
def written() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes meanwhile, as a list for ``drop``."""
    tables: list[DataFrame] = []
    _LISTS.append(tables)
    try:
        yield tables
    finally:
        _LISTS.remove(tables)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that
    setting is absent and the master is local (tests, one machine) an own folder is
    taken; elsewhere that would lose data, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tracework-")
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one for tables with a layout of their own; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tracework/{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _file_system(spark, hadoop_path).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage but the files, so it survives lost executors, and
    iterative plans stay short. With ``rows``, about how many ``df`` has, few rows
    are written by few tasks. The files go when the driver ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tracework/{uuid.uuid4().hex}"
    if rows is not None:
        tasks = -(-rows // TASK_ROWS) + spark.sparkContext.defaultParallelism
        if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _file_system(spark, hadoop_path).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracework_path = path
    for tables in _LISTS:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more; others stay."""
    for df in tables:
        path = written_path(df)
        if path is not None:
            drop_paths(df.sparkSession, [path])


def written_path(df: DataFrame) -> str | None:
    """Where ``materialize`` wrote a table; None for others."""
    return getattr(df, "_tracework_path", None)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by their paths, which hold on to no plan as a table does."""
    for path in paths:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _file_system(spark, hadoop_path).delete(hadoop_path, True)


def _file_system(spark: SparkSession, hadoop_path):
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
