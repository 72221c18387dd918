"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus scan.

A text up to ``chunk`` characters is encoded where it is read. A longer one is
cut into chunks of that length, with a few characters of both neighbours. Each
chunk yields its boundary-state transfer matrix (states are the pieces over the
boundary). The matrices are combined associatively, ``FAN`` at a time, until one
is left for a text; then the states on its path go down again level by level,
and each chunk is traced back by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm.common import clean, held, map_rows, small_batches
from tracework.llm.pieces import Pieces, Vocabulary, compose, normalise, resolve
from tracework.plans.materialize import materialize

FAN = 64
_STATE = "array<struct<a:int,b:int>>"


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary a worker process and stage, so that words it has learnt serve its later tasks."""
    return held("vocabulary", lambda: Vocabulary(model))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file (half a megabyte here), read by Spark from any store."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 15
) -> DataFrame:
    """``doc_id, ids, n_chars, text_sha256`` for every row: the ids that the SentencePiece library gives.

    A null text counts as empty and has no ids. Rows are independent: repeated
    rows and ids, also null ids, give a row each. Other columns are ignored.
    ``text_sha256`` is of the text given, to check a decoding. An empty table gives
    no rows; texts beyond ``chunk`` characters go through the scan in chunks.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.where(F.length("text") <= chunk).withColumn("text_sha256", F.sha2("text", 256))

    def encode_short():
        v = _vocabulary(model.value)

        def run(r: dict) -> list:
            return [
                r["doc_id"],
                v.encode_all(map(normalise, r["text"])),
                [len(t) for t in r["text"]],
                r["text_sha256"],
            ]

        return run

    schema = f"doc_id {kind}, ids array<int>, n_chars long, text_sha256 string"
    return map_rows(short, schema, encode_short).unionByName(
        _encode_giant(docs.where(F.length("text") > chunk), model, schema, chunk)
    )


def _encode_giant(docs: DataFrame, model, schema: str, chunk: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut():
        longest = _vocabulary(model.value).longest

        def run(r: dict) -> list:
            out = [[] for _ in range(8)]
            for row, doc_id, text, sha in zip(r["row"], r["doc_id"], r["text"], r["text_sha256"]):
                normal = normalise(text)
                for k, lo in enumerate(range(0, len(normal), chunk)):
                    hi, start = min(lo + chunk, len(normal)), max(0, lo - longest)
                    values = (row, doc_id, sha, len(text), k, normal[start : hi + longest], lo - start, hi - start)
                    for column, value in zip(out, values):
                        column.append(value)
            return out

        return run

    rows = docs.withColumn("text_sha256", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    pieces = map_rows(
        rows, f"row long, doc_id {kind}, text_sha256 string, n_chars long, k long, part string, lo int, hi int", cut
    )
    pieces = materialize(pieces.repartition("row", "k"))  # the row numbers are fixed from here on

    def transfer():
        v = _vocabulary(model.value)

        def run(r: dict) -> list:
            made = [v.transfer(t, lo, hi) for t, lo, hi in zip(r["part"], r["lo"], r["hi"])]
            return [r["row"], r["k"], [[{"a": a, "b": b} for a, b in m] for m in made]]

        return run

    levels = [materialize(map_rows(pieces.select("row", "k", "part", "lo", "hi"), f"row long, k long, m {_STATE}", transfer))]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(materialize(_up(levels[-1])))
    # A whole text starts at state 0 and has one path to its end.
    ends = levels[-1].select("row", "k", F.expr("filter(m, x -> x.a = 0)[0]").alias("e")).select(
        "row", "k", F.col("e.a").alias("a"), F.col("e.b").alias("b")
    )
    for level in reversed(levels[:-1]):
        ends = materialize(_down(level, ends))

    def trace():
        v = _vocabulary(model.value)

        def run(r: dict) -> list:
            ids = [
                np.array(v.path(t, lo, hi, a, b), np.int32)
                for t, lo, hi, a, b in zip(r["part"], r["lo"], r["hi"], r["a"], r["b"])
            ]
            return [r["row"], r["k"], r["doc_id"], r["text_sha256"], r["n_chars"], ids]

        return run

    traced = map_rows(
        pieces.join(ends, ["row", "k"]),
        f"row long, k long, doc_id {kind}, text_sha256 string, n_chars long, ids array<int>",
        trace,
    )
    whole = traced.groupBy("row").agg(  # the chunks of one text, which is one row again
        F.first("doc_id").alias("doc_id"),
        F.first("text_sha256").alias("text_sha256"),
        F.first("n_chars").alias("n_chars"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"),
    )
    return whole.select([c.split()[0] for c in schema.split(", ")])


def _pairs(states) -> list[tuple[int, int]]:
    return [(x["a"], x["b"]) for x in states]


def _up(level: DataFrame) -> DataFrame:
    """Products of ``FAN`` neighbouring matrices of a text."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        made = compose([_pairs(m) for m in pdf["m"]])
        return pd.DataFrame(
            {"row": [pdf["row"].iloc[0]], "k": [pdf["k"].iloc[0] // FAN], "m": [[{"a": a, "b": b} for a, b in made]]}
        )

    return _by_group(level).groupBy("row", "g").applyInPandas(product, f"row long, k long, m {_STATE}")


def _by_group(level: DataFrame) -> DataFrame:
    """Matrices dealt by text and group: small rows that take long, so not fewer tasks for fewer bytes."""
    tasks = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return level.withColumn("g", F.expr(f"k div {FAN}")).repartition(tasks, "row", "g")


def _down(level: DataFrame, ends: DataFrame) -> DataFrame:
    """States at both ends of each matrix, from those of its product."""

    def resolve_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        path = resolve([_pairs(m) for m in pdf["m"]], int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]))
        return pd.DataFrame(
            {"row": pdf["row"], "k": pdf["k"], "a": [a for a, _ in path], "b": [b for _, b in path]}
        )

    joined = _by_group(level).join(ends.withColumnRenamed("k", "g"), ["row", "g"])
    return joined.groupBy("row", "g").applyInPandas(resolve_group, "row long, k long, a int, b int")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null."""
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))
    columns = [c for c in encoded.columns if c != out_col]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with clean():
            v = held("pieces", lambda: Pieces(model.value))
            for batch in batches:
                start = 0
                for rows, text in v.decode_parts(batch.column(batch.schema.get_field_index(ids_col))):
                    part = batch.slice(start, rows)
                    start += rows
                    yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, out_col])

    small_batches(spark)

    return encoded.select(columns).mapInArrow(run, f"{schema}, `{out_col}` string")
