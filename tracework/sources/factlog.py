"""The fact log as stored tables, and reads of many points in time.

A stored log lies in folders by attribute and range of transactions, so a read of
some attributes up to a transaction touches those folders only. Beside it lies a
table of validity: each value with the transaction it holds from and the one it
holds until. A point in time is then a filter on that table, and a whole table of
(entity, transaction) pairs is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.operators.ranges import running

LOG = "e string, a string, v string, tx long, op string"
VALID = "e string, a string, v string, valid_from long, valid_to long"
#: Transactions in a range, and levels of blocks of ranges in the join by intervals: blocks of up to 2 ** 20 ranges.
WIDTH, LEVELS = 100_000, 20
#: Ranges in a stored table where its width is fitted, and parts that each folder of an attribute and a range is written in.
RANGES, PARTS = 32, 4


def fit_width(log: DataFrame, least: int = WIDTH, ranges: int = RANGES) -> int:
    """The width, ``least`` doubled as often as needed, at which a log has ``ranges`` ranges at most.

    A stored table then has a bounded number of folders and files however long
    the log is; with a fixed width they grow with it, and so does what the driver lists.
    """
    last = log.agg(F.max("tx")).first()[0]
    width = least
    while last is not None and int(last) // width >= ranges:
        width *= 2
    return width


def validity(log: DataFrame, many: tuple[str, ...] = ()) -> DataFrame:
    """``e, a, v, valid_from, valid_to``: when each value of a log ``e, a, v, tx, op`` held; ``valid_to`` is null while it does.

    A one-valued attribute holds the value added last (of two in one transaction
    the greater) until the next addition or until that value is retracted;
    retracting another value changes nothing. A value of an attribute in ``many``
    holds until it is retracted. Adding a value that holds begins a new row, with
    the later transaction. In a transaction retractions come first. Rows are
    dealt by ranges, so an entity with very many facts is no one task's work.
    """
    once = log.where("e is not null and a is not null and v is not null").groupBy("e", "a", "v", "tx").agg(
        F.max(F.col("op") == "add").alias("added"), F.max(F.col("op") == "retract").alias("taken")
    )
    # The next fact about the same value: where that is a retraction (or holds one before its addition), the value ends there.
    same = running(once, ["e", "a", "v"], ["tx"], neighbours=("tx", "taken")).where("added")
    same = same.withColumn("ends", F.when(F.col("taken_after"), F.col("tx_after"))).select("e", "a", "v", "tx", "ends", F.col("tx_after").alias("again"))
    several = F.col("a").isin(*many) if many else F.lit(False)
    sets = same.where(several).select("e", "a", "v", F.col("tx").alias("valid_from"), F.col("again").alias("valid_to"))
    greatest = same.where(~several).groupBy("e", "a", "tx").agg(F.max(F.struct("v", "ends")).alias("m"))
    ones = running(greatest.select("e", "a", "tx", "m.v", "m.ends"), ["e", "a"], ["tx"], neighbours=("tx",))
    ones = ones.select("e", "a", "v", F.col("tx").alias("valid_from"), F.least("ends", "tx_after").alias("valid_to"))
    return ones.unionByName(sets) if many else ones


def write_log(log: DataFrame, path: str, width: int = WIDTH, mode: str = "append") -> None:
    """Add facts to a stored log: folders by attribute and range of ``width`` transactions, rows sorted by entity."""
    rows = log.select("e", "a", "v", F.col("tx").cast("long").alias("tx"), "op").withColumn("tx_range", F.expr(f"tx div {width}"))
    rows.repartition("a", "tx_range", F.pmod(F.hash("e"), F.lit(PARTS))).sortWithinPartitions("a", "tx_range", "e", "tx").write.mode(mode).partitionBy("a", "tx_range").parquet(path)


def read_log(spark: SparkSession, path: str, tx: int | None = None, attributes: tuple[str, ...] = (), after: int | None = None, width: int = WIDTH) -> DataFrame:
    """Facts up to ``tx``, later than ``after``, of the attributes named (all, if none): only their folders are read."""
    rows = spark.read.schema(LOG + ", tx_range long").parquet(path)
    if tx is not None:
        rows = rows.where((F.col("tx_range") <= tx // width) & (F.col("tx") <= tx))
    if after is not None:
        rows = rows.where((F.col("tx_range") >= after // width) & (F.col("tx") > after))
    if attributes:
        rows = rows.where(F.col("a").isin(*attributes))
    return rows.select("e", "a", "v", "tx", "op")


def write_validity(rows: DataFrame, path: str, width: int = WIDTH, mode: str = "overwrite") -> None:
    """Store ``validity`` rows in folders by attribute and by the range that they hold from."""
    ranged = rows.withColumn("from_range", F.expr(f"valid_from div {width}"))
    ranged.repartition("a", "from_range", F.pmod(F.hash("e"), F.lit(PARTS))).sortWithinPartitions("a", "from_range", "e").write.mode(mode).partitionBy("a", "from_range").parquet(path)


def read_validity(spark: SparkSession, path: str, tx: int | None = None, attributes: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Stored validity rows that began by ``tx``, of the attributes named: only their folders are read."""
    rows = spark.read.schema(VALID + ", from_range long").parquet(path)
    if tx is not None:
        rows = rows.where((F.col("from_range") <= tx // width) & (F.col("valid_from") <= tx))
    if attributes:
        rows = rows.where(F.col("a").isin(*attributes))
    return rows.select("e", "a", "v", "valid_from", "valid_to")


def at(valid: DataFrame, tx: int | None = None) -> DataFrame:
    """``e, a, v, tx``: what holds at ``tx`` (null: now)."""
    holds = F.col("valid_to").isNull() if tx is None else (F.col("valid_from") <= tx) & (F.col("valid_to").isNull() | (F.col("valid_to") > tx))
    return valid.where(holds).select("e", "a", "v", F.col("valid_from").alias("tx"))


def at_pairs(valid: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every row of ``pairs`` (``e, tx``, other columns kept): what its entity holds at its transaction, as ``a, v, since``.

    A row for each value; pairs of an entity that holds nothing then have none.
    Each interval is cut to blocks of two to the power of k ranges, at most two of
    a size, and each pair looks at its block of every size: a join on equal values
    only, in which a pair never meets intervals of its entity from far away.
    """
    last = pairs.agg(F.max("tx")).first()[0]
    if last is None:
        last = 0
    levels = max(1, min(LEVELS, (int(last) // width).bit_length()))
    # Blocks of ranges from l up to r at one level, as in a segment tree: an odd left end and an odd right end.
    first, end = F.expr(f"valid_from div {width}"), F.least(F.coalesce(F.expr(f"valid_to div {width}"), F.lit(1 << 62)), F.lit(int(last) // width)) + 1
    cut = valid.where(F.col("valid_from") <= last).withColumns({"l": first, "r": end}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cut = cut.withColumns({"lk": F.expr("(l + shiftleft(1L, k) - 1) div shiftleft(1L, k)"), "rk": F.expr("r div shiftleft(1L, k)")})
    # At the top level all blocks between the ends are taken: there are at most two.
    top = F.when(F.col("lk") < F.col("rk"), F.sequence("lk", F.col("rk") - 1)).otherwise(F.array().cast("array<bigint>"))
    left = F.when((F.col("lk") % 2 == 1) & (F.col("lk") < F.col("rk")), F.col("lk"))
    right = F.when((F.col("rk") % 2 == 1) & (F.col("lk") + F.col("lk") % 2 < F.col("rk")), F.col("rk") - 1)
    blocks = F.when(F.col("k") == levels, top).otherwise(F.array_compact(F.array(left, right)))
    pieces = cut.select("e", "a", "v", "valid_from", "valid_to", "k", F.explode(blocks).alias("block"))
    asked = pairs.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))  # pairs may have a column k of their own
    asked = asked.select(*pairs.columns, "_level", F.expr(f"(tx div {width}) div shiftleft(1L, _level)").alias("_slot"))
    # Both sides are many times what their files let expect, so neither may be sent to the driver and broadcast.
    one, other = asked.alias("asked").hint("merge"), pieces.select(F.col("e").alias("_e"), F.col("k").alias("_k"), F.col("block").alias("_block"), F.struct("a", "v", "valid_from", "valid_to").alias("_held"))
    met = one.join(other, (F.col("asked.e") == F.col("_e")) & (F.col("asked._level") == F.col("_k")) & (F.col("asked._slot") == F.col("_block")))
    met = met.where("_held.valid_from <= asked.tx and (_held.valid_to is null or _held.valid_to > asked.tx)")
    return met.select(*(f"asked.{c}" for c in pairs.columns), "_held.a", "_held.v", F.col("_held.valid_from").alias("since"))
