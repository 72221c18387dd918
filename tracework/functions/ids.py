"""Scalar expressions: identifiers, digests, dates, places, names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _v3(m: Column) -> Column:
    variant = F.translate(F.substring(m, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"),
        variant, F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12),
    )


def uuid3(text: Column) -> Column:
    """Name-based UUID (version 3) of a text's UTF-8 bytes, without a name space."""
    return _v3(F.md5(text.cast("binary")))


def uuid3_among(text: Column, some: list[str]) -> Column:
    """Whether ``uuid3(text)`` is one of ``some``: the first 8 digits are the digest's own, so one digest a row tells most rows apart."""
    head = F.substring(F.md5(text.cast("binary")), 1, 8)
    return head.isin(list({i[:8] for i in some})) & uuid3(text).isin(some)


def uuid3_of(text: str) -> str:
    """``uuid3`` of one text, for constants and Python in tasks."""
    m = hashlib.md5(text.encode()).hexdigest()
    return f"{m[:8]}-{m[8:12]}-3{m[13:16]}-{'89ab'[int(m[16], 16) % 4]}{m[17:20]}-{m[20:]}"


def blank_node_uuid(label: Column, seed: Column) -> Column:
    """Stable UUID of a blank node in a document: version 3 of the MD5 bytes of ``blank-node:<id>:<seed>``."""
    return _v3(F.md5(F.unhex(F.md5(F.concat(F.lit("blank-node:"), label, F.lit(":"), seed).cast("binary")))))


def document_seed(content: Column) -> Column:
    """``doc:`` and the first 16 hex digits of the SHA-256 of a document."""
    return F.concat(F.lit("doc:"), F.substring(F.sha2(content, 256), 1, 16))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def is_hex64(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def strict_date(text: Column) -> Column:
    """Timestamp of ``yyyyMMdd``, null for anything else."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def place(city: Column, state: Column, country: Column) -> Column:
    """The non-blank parts joined by commas, or ``Unknown``."""
    parts = F.filter(F.array(city, state, country), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit("Unknown"))


def expand_curie(term: Column, prefixes: Column) -> Column:
    """A CURIE by its prefix in a map; unknown prefixes and full URIs stay; without a colon null."""
    prefix = F.regexp_extract(term, "^([^:]*):", 1)
    base = F.element_at(prefixes, prefix)
    return (
        F.when(~term.contains(":"), F.lit(None).cast("string"))
        .when(term.rlike("^https?://"), term)
        .when(base.isNotNull(), F.concat(base, F.regexp_replace(term, "^[^:]*:", "")))
        .otherwise(term)
    )


def xsd_type(datatype: Column) -> Column:
    """Column type of an XSD type by its suffix."""
    out = F.lit("string")
    for suffix, kind in (
        ("dateTime", "timestamp"), ("boolean", "boolean"), ("float", "float"), ("double", "double"),
        ("decimal", "double"), ("long", "bigint"), ("integer", "bigint"), ("int", "bigint"),
    ):
        out = F.when(datatype.endswith(suffix), F.lit(kind)).otherwise(out)
    return out


def turtle_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_key(labels: Column) -> Column:
    """Canonical text of a map of labels: ``k=v`` in order of the keys."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def normalise_linear(x: Column, low: Column, high: Column, inverse: bool = False) -> Column:
    """Place of x between low and high, held to 0..1; one half where the range is nothing."""
    share = (high - x if inverse else x - low) / F.when(high != low, high - low)
    return F.when(share.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def sigmoid(x: Column, steepness: float, centre: float) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - centre)))


def combined_score(parts: list[tuple[Column, float]], penalty: Column) -> Column:
    """Mean of scores by their weights, less a penalty, not below 0."""
    total = sum(w for _, w in parts)
    return F.greatest(F.lit(0.0), sum((c * w for c, w in parts), F.lit(0.0)) / total - penalty)


def suspicious(text: Column, longest: int) -> Column:
    """Why a text parameter is turned away: too long, or script-like; null if it is not."""
    # Marks of scripts.
    marks = text.contains("<script") | F.lower(text).contains("javascript:") | text.contains("onerror=") | text.contains("onload=")
    return F.when(F.length(text) > longest, "too long").when(marks, "suspicious")


def instant(text: Column) -> Column:
    """Timestamp of an ISO-8601 text, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text))
