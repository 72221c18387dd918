"""Token counts by a public tokenizer, lengths only.

Texts go to the tokenizer's own batch call in Arrow functions, some hundred
kilobytes at a time whatever the number of rows; only lengths come back. A long
text is cut at *safe* places, where the tokenizer starts anew whatever lies on
either side, so the counts of its parts add up to that of the whole. Texts beyond
``LONG`` bytes are cut first and their parts dealt over all tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import clean, held, small_batches
from tracework.plans.materialize import materialize

#: Bytes of texts that one call of the tokenizer gets; characters of a part, about.
BATCH, PART = 512 << 10, 32 << 10
#: Bytes beyond which the parts of a text are dealt over the tasks.
LONG = 1 << 20
#: Places where the byte-level pattern always ends a token: before a blank or a mark after a letter or digit, and between letters and digits.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])|(?<=[^\W\d_])(?=[,.;:!?。、，])|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")


def tokenizer(name: str, model: bytes) -> tuple[Callable[[list[str]], list[int]], re.Pattern | None]:
    """A function from texts to their token counts, and the safe places (None: no text may be cut).

    ``.json`` files are read by the tokenizers library, ``.model`` files by
    sentencepiece; no tokens are added, nothing is truncated or padded.
    """
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)], None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_str(model.decode())
    bpe.no_truncation()
    bpe.no_padding()
    return lambda texts: [len(e) for e in bpe.encode_batch_fast(texts, add_special_tokens=False)], safe_places(json.loads(model))


def safe_places(spec: dict) -> re.Pattern | None:
    """``SAFE`` where the file's settings are those it was made for, and no added token has such a place inside."""
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    whole = all(not SAFE.search(t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in added)
    return SAFE if plain and whole and spec.get("normalizer") is None and not spec["model"].get("dropout") else None


def parts_of(text: str, safe: re.Pattern | None, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters; a part goes on until a safe place comes."""
    start = 0
    while safe is not None and len(text) - start > size:
        place = safe.search(text, start + size)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


def lengths(texts: list[str], count: Callable, safe: re.Pattern | None, batch: int, part: int) -> list[int]:
    """Token counts of texts, asked for in batches of about ``batch`` bytes."""
    out, asked, owner, size = [0] * len(texts), [], [], 0

    def ask() -> None:
        for i, n in zip(owner, count(asked)):
            out[i] += n

    for i, text in enumerate(texts):
        for piece in parts_of(text, safe, part):
            asked.append(piece)
            owner.append(i)
            size += len(piece.encode())
            if size >= batch:
                ask()
                asked, owner, size = [], [], 0
    if asked:
        ask()
    return out


def count_tokens(
    docs: DataFrame,
    path: str,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    limit: int = 512,
    long: int = LONG,
    batch: int = BATCH,
    part: int = PART,
) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) for every row.

    A null text counts as an empty one: 0 bytes, 0 tokens. Rows are counted one by
    one, so repeated rows and null or repeated ids come out as often as they are
    there; an empty table gives no rows. Very long texts are cut at safe places and
    give the count of the whole; a text without any such place stays in one part.
    Other columns are ignored, whatever their names; ``keep`` must not name a result column.
    """
    name, model = os.path.basename(path), Path(path).read_bytes()
    inner = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner)), text.alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select(*inner, "row", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    small_batches(docs.sparkSession)

    # Rows with a count, and parts of long texts still to be counted: written once, so row numbers are fixed.
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with clean():
            for rb in batches:
                count, safe = held("tokens:" + name, lambda: tokenizer(name, model))
                texts, sizes = rb.column("text").to_pylist(), rb.column("n_bytes").to_pylist()
                far = [i for i, n in enumerate(sizes) if n > long and safe is not None]
                near = sorted(set(range(len(texts))) - set(far))
                found = pa.array(lengths([texts[i] for i in near], count, safe, batch, part), pa.int64())
                yield _batch(rb, near, found, pa.nulls(len(near), pa.string()), [0] * len(near))
                for i in far:
                    pieces: list[str] = []
                    at = 0
                    for piece in parts_of(texts[i], safe, part):
                        pieces.append(piece)
                        if len(pieces) * part >= batch:
                            yield _batch(rb, [i] * len(pieces), pa.nulls(len(pieces), pa.int64()), pa.array(pieces, pa.string()), range(at, at + len(pieces)))
                            at += len(pieces)
                            pieces = []
                    yield _batch(rb, [i] * len(pieces), pa.nulls(len(pieces), pa.int64()), pa.array(pieces, pa.string()), range(at, at + len(pieces)))

    def _batch(rb: pa.RecordBatch, at: list[int], counts: pa.Array, pieces: pa.Array, places) -> pa.RecordBatch:
        taken = [rb.column(c).take(pa.array(at, pa.int64())) for c in (*inner, "row", "n_bytes")]
        return pa.RecordBatch.from_arrays([*taken, counts, pieces, pa.array(places, pa.int64())], names=[*inner, "row", "n_bytes", "n_tokens", "piece", "place"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with clean():
            for rb in batches:
                count, _ = held("tokens:" + name, lambda: tokenizer(name, model))
                found = lengths(rb.column("piece").to_pylist(), count, None, batch, part)
                yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array(found, pa.int64())], names=["row", "n_tokens"])

    kept = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner)
    done = materialize(rows.mapInArrow(first, f"{kept}{', ' if kept else ''}row long, n_bytes long, n_tokens long, piece string, place long"))
    counted = done.where("piece is null").select(*inner, "n_bytes", "n_tokens")
    far = done.where("piece is not null")
    sums = far.select("row", "place", "piece").repartition("row", "place").select("row", "piece").mapInArrow(second, "row long, n_tokens long").groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    heads = far.where("place = 0").select(*inner, "row", "n_bytes")
    out = counted.unionByName(heads.join(sums, "row").select(*inner, "n_bytes", "n_tokens"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(inner, keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
