"""Ingest of change batches into a fact log with a compacted current state beside it.

The state lies in folders by range of the entity's hash. A batch reads and writes
anew only the folders that its entities fall into, so its cost follows the batch
and what these folders hold, never the length of the log. Each folder holds
versions by batch number; a batch reads the last version before its own, so that
a batch that is done again after a failure finds what it found the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.operators.timetravel import apply_changes

LOG = "e string, a string, v string, tx long, op string"
STATE = "e string, a string, v string, tx long"


class Ingest:
    """A log in ``path`` (folders ``batch=N``) and its state in ``path.state`` (folders ``part=K/upto=N``)."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 256, many: tuple[str, ...] = ()):
        self.spark, self.path, self.parts, self.many = spark, path.rstrip("/"), parts, many
        self.state_path = self.path + ".state"
        #: Bytes of state that each batch read, by its number.
        self.bytes_read: dict[int, int] = {}
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _part(self):
        return F.pmod(F.hash("e"), F.lit(self.parts)).alias("part")

    def _folder(self, path: str):
        at = self._hadoop.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, part: int) -> list[int]:
        at, fs = self._folder(f"{self.state_path}/part={part}")
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at)) if fs.exists(at) else []

    def state(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """``e, a, v, tx`` after all batches, or those numbered below ``before``; of all parts or some."""
        return self._read(before, only)[0]

    def _read(self, before: int | None, only: list[int] | None) -> tuple[DataFrame, int]:
        paths, size = [], 0
        for part in range(self.parts) if only is None else only:
            known = [v for v in self._versions(part) if before is None or v < before]
            if known:
                paths.append(f"{self.state_path}/part={part}/upto={known[-1]}")
                at, fs = self._folder(paths[-1])
                size += fs.getContentSummary(at).getLength()
        return (self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)), size

    def step(self, changes: DataFrame, number: int) -> None:
        """Apply one batch of changes ``e, a, v, op`` as the transaction ``number + 1``; doing it again leaves the same."""
        changes = changes.where("e is not null").persist()
        touched = sorted(r.part for r in changes.select(self._part()).distinct().collect())  # at most ``parts`` numbers
        before, self.bytes_read[number] = self._read(number, touched)
        log = before.withColumn("op", F.lit("add"))
        folder = f"{self.path}/batch={number}"
        apply_changes(log, changes, number + 1, self.many).write.mode("overwrite").parquet(folder)
        facts = self.spark.read.schema(LOG).parquet(folder)
        gone = facts.where("op = 'retract'").select("e", "a", "v")
        after = before.join(gone, ["e", "a", "v"], "left_anti").unionByName(facts.where("op = 'add'").drop("op"))
        rows = after.select("*", self._part(), F.lit(number).alias("upto")).repartition("part").sortWithinPartitions("part", "e")
        for part in touched:  # an earlier try may have left files, and a part may hold nothing any more
            at, fs = self._folder(f"{self.state_path}/part={part}/upto={number}")
            fs.delete(at, True)
        rows.write.mode("append").partitionBy("part", "upto").parquet(self.state_path)
        for part in touched:
            at, fs = self._folder(f"{self.state_path}/part={part}/upto={number}")
            fs.mkdirs(at)
            for old in [v for v in self._versions(part) if v < number][:-1]:  # the last one before this batch stays for another try
                at, fs = self._folder(f"{self.state_path}/part={part}/upto={old}")
                fs.delete(at, True)
        changes.unpersist()


def ingest_stream(changes: DataFrame, log_path: str, checkpoint: str, ts: str = "ts", key: str = "id", late: str = "10 minutes", parts: int = 256):
    """Start a query that appends a stream of changes ``id, e, a, v, op, ts`` to the log in a folder.

    Repeated ids within the watermark count once. A micro-batch is one
    transaction, numbered from 1; its facts go to a folder of that number, which a
    repeated batch writes anew, so a restart leaves no fact twice.
    """
    into = Ingest(changes.sparkSession, log_path, parts)
    once = changes.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(lambda batch, number: into.step(batch.select("e", "a", "v", "op"), number)).option("checkpointLocation", checkpoint).start()
