"""Language by compression: the dictionary that shortens a text most names its language.

For each language a raw-content Zstandard dictionary is built from a bounded
sample of labelled texts. A text is compressed whole, piece by piece, with each
dictionary; the smallest total wins. A narrow margin over the second makes the
operator reject the text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import map_rows

#: Documents a language's dictionary draws on, characters of a stretch from each, and bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 128, 1_536, 192 << 10
#: Languages that one run may tell apart; more is an error, not a cut.
LANGUAGES = 400
#: Characters of a text that are compressed at a time, and the relative margin below which it is rejected.
PIECE, MARGIN = 4_096, 0.02
_OTHER = re.compile(r"[\W\d_]+")


def _plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


def _has_letter(plain: str) -> bool:
    """Whether a character is a letter; marks like ½ are words' characters to a regex, but no letters."""
    return any(map(str.isalpha, plain))


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionary content by language, from at most ``SAMPLE_DOCS`` documents each.

    A document gives one stretch of ``SAMPLE_CHARS`` characters, from a place that
    the hash of its id picks anywhere in the text. Of rows that repeat an id, the
    least stretch counts. Rows without a language or a text are not learnt from.
    """
    h, spare = F.xxhash64(id_col), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0)) + 1
    rows = train.where(F.col(lang_col).isNotNull() & (F.trim(text_col) != "")).select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).substr((F.pmod(h, spare) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"),
        h.alias("h"),
    )
    picked = (
        rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    )
    if picked.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sample = (
        rows.join(F.broadcast(picked), ["lang", "h"])  # at most LANGUAGES * SAMPLE_DOCS rows
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
        .toPandas()
        .sort_values(["lang", "h"])
    )
    out = {}
    for lang, part in sample.groupby("lang"):
        texts, size = [], 0
        for plain in map(_plain, part["text"]):
            size += len(plain.encode()) + 1
            if _has_letter(plain) and size <= DICTIONARY_BYTES:
                texts.append(plain.encode())
        if texts:
            out[str(lang)] = b" ".join(texts)
    return out


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for every row.

    A null text, one without letters, or no dictionary at all gives ``und`` with
    score 0, rejected. Ties go to the language whose code comes first. The score
    rises from 0 to 1 with the relative margin of sizes. Only the text is used.
    Very long texts are compressed whole. Repeated rows and ids give a row each,
    an empty table none; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        import zstandard

        langs = sorted(shared.value)
        how = zstandard.ZstdCompressionParameters.from_level(
            6, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        coders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

        def one(text: str | None) -> tuple:
            plain = _plain(text) if text else ""
            if not langs or not _has_letter(plain):
                return "und", 0.0, 0.0, True
            raw = plain.encode()
            parts = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
            size = np.array([sum([len(c(p)) for p in parts]) for c in coders], float)
            best = int(size.argmin())
            second = np.delete(size, best).min() if len(size) > 1 else len(raw) + 16.0
            margin = max(0.0, float((second - size[best]) / max(second, 1.0)))
            return langs[best], 1.0 - float(np.exp(-20.0 * margin)), margin, margin < MARGIN

        def run(r: dict) -> list:
            made = [one(t) for t in r[text_col]]
            return [r[id_col], *([m[k] for m in made] for k in range(4))]

        return run

    return map_rows(
        docs.select(id_col, text_col),
        f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean",
        make,
    )
