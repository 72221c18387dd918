"""Tool calls: link calls with results, order them, validate arguments, write canonical JSON.

DataFrame operations only. Calls and results join by identifier with a hash
join. The order is topological: a call's level is one more than that of the call
whose result it needs, found by pointer doubling over all conversations at once, so
no conversation is gathered anywhere. Arguments are checked against schemas as
VARIANT values.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.plans.materialize import materialize

#: Schemas: tool name to a JSON schema of its arguments, with the keywords type, properties, required,
#: additionalProperties (false), items and enum; or, in short, ``{argument: (type, required)}``.
Schemas = dict[str, dict]

_TYPES = {
    "string": "^STRING$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$",
    "array": "^ARRAY.*$",
}


def _whole_schema(schema: dict) -> dict:
    """A schema from its short form."""
    if all(isinstance(x, tuple) for x in schema.values()):
        return {
            "properties": {k: {"type": t} for k, (t, _) in schema.items()},
            "required": [k for k, (_, r) in schema.items() if r],
        }
    return schema


def _has_type(v: Column, kind: str) -> Column:
    if kind == "integer":  # a number without a fraction, also 1.0
        return _has_type(v, "number") & F.coalesce(F.try_variant_get(v, "$", "double") % 1 == 0, F.lit(False))
    return F.schema_of_variant(v).rlike(_TYPES[kind])


def _check(schema: dict, v: Column, name: Column | None) -> Column:
    """Errors of a present value ``v`` (VARIANT) as array<string>: its own, then those of its parts by name."""
    none = F.array().cast("array<string>")
    label = lambda k: k if name is None else F.concat(name, F.lit("."), k)
    here = F.lit("arguments") if name is None else name
    parts = []
    if "enum" in schema:
        allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        parts.append(F.when(F.to_json(v).isin(allowed), none).otherwise(F.array(F.concat(here, F.lit(": not one of the values")))))
    for field, inner in sorted(schema.get("properties", {}).items()):
        given = F.try_variant_get(v, f'$["{field}"]' if "'" in field else f"$['{field}']", "variant")
        missing = F.coalesce(F.schema_of_variant(given) == "VOID", F.lit(True))
        absent = F.array(F.concat(label(F.lit(field)), F.lit(": missing"))) if field in schema.get("required", ()) else none
        parts.append(F.when(missing, absent).otherwise(_check(inner, given, label(F.lit(field)))))
    if schema.get("additionalProperties", True) is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        known = F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>")
        unknown = F.array_sort(F.array_except(F.coalesce(keys, none), known))
        parts.append(F.transform(unknown, lambda k: F.concat(label(k), F.lit(": unknown argument"))))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        inner = lambda x, i: _check(schema["items"], x, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")))
        parts.append(F.flatten(F.transform(items, inner)))
    found = F.concat(*parts) if parts else none
    if "type" not in schema:
        return found
    wrong = F.array(F.concat(here, F.lit(f": not {schema['type']}")))
    return F.when(_has_type(v, schema["type"]), found).otherwise(wrong)


def _errors(schemas: Schemas) -> Column:
    """Errors of the arguments ``v`` (VARIANT) of tool ``name``, in the order of argument names."""
    v = F.col("v")
    out = F.when(v.isNull(), F.array(F.lit("arguments: not JSON"))).when(
        ~_has_type(v, "object"), F.array(F.lit("arguments: not an object"))
    )
    for tool, schema in sorted(schemas.items()):
        out = out.when(F.col("name") == tool, _check(_whole_schema(schema), v, None))
    return out.otherwise(F.array(F.lit("name: unknown tool")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), needs (the
    call_id in the conversation whose result it uses, or null). ``results``:
    conv_id, call_id, content. Other columns are ignored.

    Returns ``conv_id, call_id, status, level, turn, valid, errors, json``.
    Within a conversation, ``level, turn, call_id`` is a topological order.
    Status is answered, pending (no result) or orphan (no call; level, turn and
    valid null). A call that needs an unknown call is at level 0 with the error
    ``needs: unknown call``; calls on a cycle, or that need one on it, have
    level null and the error ``needs: cycle``. Rows with a null identifier are
    left out of linking: such calls are pending, such results orphans. Repeated
    identifiers count once: the call least by turn, name, arguments; the result
    least by content. Ties of ``turn`` go by call_id. A null argument counts as
    missing; a number without a fraction is an integer, also 1.0, and is written
    as 1. The JSON has sorted keys and no blanks; a field of the row that is null
    is left out, a null that the arguments hold stays. Texts of any length pass
    through whole; empty tables give an empty result.
    """
    raw = calls.select("conv_id", "call_id", F.col("turn").cast("long"), "name", "arguments", "needs")
    known = raw.where("conv_id is not null and call_id is not null")
    known = known.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"))
    known = materialize(known.select("conv_id", "call_id", "c.*"))
    answers = results.select("conv_id", "call_id", "content")
    given = answers.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min("content").alias("content"), F.lit(True).alias("has")
    )
    level = _levels(known.select("conv_id", "call_id", "needs"))
    linked = (
        known.join(level, ["conv_id", "call_id"], "left")
        .join(given.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
        .withColumn(
            "status",
            F.when(F.col("turn").isNull() & F.col("known").isNull(), "orphan").when(F.col("has"), "answered").otherwise("pending"),
        )
    )
    nameless = raw.where("conv_id is null or call_id is null").withColumns(
        {"level": F.lit(0), "unknown": F.lit(False), "known": F.lit(True), "content": F.lit(None).cast("string"), "status": F.lit("pending")}
    )
    lost = answers.where("conv_id is null or call_id is null").withColumn("status", F.lit("orphan"))
    rows = linked.drop("has").unionByName(nameless).unionByName(lost, allowMissingColumns=True)
    is_call = F.col("status") != "orphan"
    problems = F.concat(
        _errors(schemas),
        F.when(F.col("level").isNull(), F.array(F.lit("needs: cycle")))
        .when(F.col("unknown"), F.array(F.lit("needs: unknown call")))
        .otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("v", F.try_parse_json("arguments")).withColumn("errors", F.when(is_call, problems))
    return rows.select(
        "conv_id",
        "call_id",
        "status",
        "level",
        "turn",
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        "errors",
        F.to_json(
            F.struct(
                F.coalesce(F.col("v"), F.to_variant_object(F.struct(F.col("arguments").alias("text")))).alias("arguments"),
                "call_id",
                "content",
                "level",
                "name",
                "needs",
                "status",
            )
        ).alias("json"),
    )


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, unknown, known`` of all calls; level null on and behind cycles.

    By pointer doubling: each round, a call's pointer goes twice as far, so the
    rounds follow the logarithm of the longest chain. What still points somewhere
    after more steps than a conversation has calls is on a cycle or behind one.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    at = materialize(
        calls.join(ids, ["conv_id", "needs"], "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("there"), F.col("needs")).alias("to"),
            F.when(F.col("there"), 1).otherwise(0).alias("level"),
            (F.col("needs").isNotNull() & F.col("there").isNull()).alias("unknown"),
        )
    )
    size = calls.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(size.bit_length()):
        if at.where("to is not null").isEmpty():
            break
        there = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        at = materialize(
            at.join(there, ["conv_id", "to"], "left").select(
                "conv_id", "call_id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "unknown"
            )
        )
    level = F.when(F.col("to").isNull(), F.col("level"))
    return at.select("conv_id", "call_id", level.alias("level"), F.lit(True).alias("known"), "unknown")


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a table of turns (conv_id, turn, role, text) stands for.

    Each user turn is a call of the tool ``answer`` with its text and turn; the
    next turn is its result if the assistant's. The k-th exchange of a
    conversation builds on exchange ``(k - 1) div 2``. Odd exchanges call
    ``search`` instead, which needs a limit and gets the length of the text.
    """
    k = F.expr("turn div 2")
    name = F.when(k % 2 == 0, "answer").otherwise("search")
    call_id = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    users = turns.where("role = 'user'")
    calls = users.select(
        "conv_id",
        call_id.alias("call_id"),
        "turn",
        name.alias("name"),
        F.when(
            k % 2 == 0, F.to_json(F.struct("text", "turn"))
        ).otherwise(F.to_json(F.struct(F.length("text").alias("limit"), F.col("text").alias("query")))).alias("arguments"),
        F.when(k > 0, F.concat(F.lit("call_"), F.expr("((turn div 2) - 1) div 2 * 2 + turn % 2").cast("string"))).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
