"""A stored index from identifiers to keys, for lookups that read a few row groups.

Rows lie in folders by the head of the identifier, sorted by it, with a Bloom
filter a row group. A lookup names folders and identifiers, so Spark prunes
folders by the one and row groups by the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an identifier that name its folder, and distinct identifiers that a Bloom filter expects.
HEAD, EXPECTED = 2, 1_000_000


def write_id_index(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store ``id, kind, key`` rows."""
    headed = rows.select("id", "kind", F.col("key").cast("long").alias("key")).withColumn("head", F.substring("id", 1, HEAD))
    writer = headed.repartition("head").sortWithinPartitions("head", "id").write.mode(mode).partitionBy("head")
    writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(EXPECTED)).parquet(path)


def find_ids(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """``id, kind, key`` of the identifiers given: those folders are read only, with the identifiers pushed to the scan."""
    rows = spark.read.schema("id string, kind string, key long, head string").parquet(path)
    return rows.where(F.col("head").isin(sorted({i[:HEAD] for i in ids})) & F.col("id").isin(ids)).select("id", "kind", "key")


def find_many(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The same for a table of identifiers (first column), by a join on folder and identifier."""
    asked = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("head", F.substring("id", 1, HEAD))
    rows = spark.read.schema("id string, kind string, key long, head string").parquet(path)
    return rows.join(asked, ["head", "id"]).select("id", "kind", "key")
