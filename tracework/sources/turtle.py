"""A subset of Turtle: prefixes, ``subject a type ;`` heads and ``predicate object ;`` lines, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.plans.materialize import materialize
from tracework.sources.rdf import literal_text, node_text, unescape

_PREFIX = r"^\s*@prefix\s+([A-Za-z0-9_-]*):\s*<([^>]*)>\s*\.?\s*$"
_NAME = r"<[^>]*+>|[\w-]*+:[\w.-]*[\w-]|_:[\w-]++"
_VALUE = r'"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]++|\^\^(?:' + _NAME + r"))?|'[^']*+'|" + _NAME + r"|[^\s;.]++(?:\.[0-9]++)?"
_HEAD = rf"^\s*({_NAME})\s+a\s+({_NAME})\s*[;.]?\s*$"
_LINE = rf"^\s*(a|{_NAME})\s+({_VALUE})\s*[;.]?\s*$"
_WHOLE = rf"^\s*({_NAME})\s+(a|{_NAME})\s+({_VALUE})\s*[.;]?\s*$"
#: Prefixes known without a declaration.
PREFIXES = {
    "prov": "http://www.w3.org/ns/prov#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "ex": "http://example.org/",
}
TYPE = PREFIXES["rdf"] + "type"


#: What stands between the groups of a match that are put into one text.
_SEP = "\x01"


def strip_comment(text: Column) -> Column:
    """A line without the comment at its end; a ``#`` within quotes or an address stays."""
    kept = F.regexp_extract(text, r"""^((?:[^"'<#]++|"(?:[^"\\]++|\\.)*+"|'[^']*+'|<[^>]*+>|["'<])*+)""", 1)
    return F.when(text.contains("#"), kept).otherwise(text)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose expressions are computed once a row, however often later steps and filters name them."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), made)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern from ``^`` to ``$``, by one match; an array of another size if a text does not match."""
    marked = F.split(F.regexp_replace(text, pattern + "(?s:.*)", _SEP.join(f"${i}" for i in range(1, n + 1))), _SEP)
    each = F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, n + 1)))).otherwise(F.array())
    return F.when(text.contains(_SEP), each).otherwise(marked)


def strip_quotes(text: Column) -> Column:
    """What stands between the quotes of a string, single or tripled; other text trimmed."""
    out = F.trim(text)
    for mark in ("'", "'''", '"', '"""'):
        whole = text.startswith(mark) & text.endswith(mark) & (F.length(text) >= 2 * len(mark))
        out = F.when(whole, text.substr(F.lit(len(mark) + 1), F.length(text) - 2 * len(mark))).otherwise(out)
    return out


def _prefixes(rows: DataFrame, line: str = "value") -> DataFrame:
    """``doc, given``: the prefixes that each document declares."""
    v = F.trim(strip_comment(F.col(line)))
    pairs = F.collect_set(F.struct(F.regexp_extract(v, _PREFIX, 1), F.regexp_extract(v, _PREFIX, 2)))
    return rows.where(F.ltrim(line).startswith("@") & v.rlike(_PREFIX)).groupBy("doc").agg(F.map_from_entries(pairs).alias("given"))


def parse_turtle(lines: DataFrame) -> DataFrame:
    """``doc, pos, s, p, o, o_kind, datatype, lang`` of lines ``doc, pos, value``.

    A head names the subject of the lines after it, up to the next head in its
    document; prefixes hold for the whole document. ``a`` is the type predicate.
    Numbers, true and false become typed literals. What does not parse gives no row.
    Lines may bring their ``head`` along; else a window over each document finds it.
    They may bring ``given`` along too, the prefixes that their document declares.
    Each line is matched once where it stands alone.
    """
    brought = [c for c in ("head", "given") if c in lines.columns]
    rows = _once(lines.select("doc", "pos", "value", *brought), value=F.trim(strip_comment(F.col("value")))).withColumnRenamed("value", "v")
    known = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    if "given" not in brought:
        rows = rows.join(_prefixes(rows, "v"), "doc", "left")
    rows = rows.where(~F.col("v").startswith("@") & (F.col("v") != ""))
    if "head" not in brought:
        head = F.when(F.col("v").rlike(_HEAD), F.regexp_extract("v", _HEAD, 1))
        rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(W.partitionBy("doc").orderBy("pos")))
    rows = _once(rows, whole=_groups(F.col("v"), _WHOLE, 3))
    # Heads are whole lines too, whose predicate is ``a``.
    is_whole, line = F.size("whole") == 3, lambda i: F.regexp_extract("v", _LINE, i)
    part = lambda i: F.get("whole", F.lit(i))
    rows = _once(
        rows.select("doc", "pos", "given", "head", "v", "whole"),
        rs=F.when(is_whole, part(0)).otherwise(F.col("head")),
        rp=F.when(is_whole, part(1)).otherwise(line(1)),
        ro=F.when(is_whole, part(2)).otherwise(line(2)),
    ).where("rs is not null and rp != '' and ro != ''")
    o = F.col("ro")
    quoted = o.startswith('"')
    rest = F.substr(o, F.lit(2))
    plain = rest.contains('"') & ~o.contains("\\")
    text = F.when(plain, F.substring_index(rest, '"', 1)).otherwise(F.regexp_extract("ro", r'^"((?:[^"\\]++|\\.)*+)"', 1))
    name = ~quoted & o.rlike(rf"^(?:{_NAME})$")
    rows = _once(rows.select("doc", "pos", "given", "rs", "rp", "ro"), name=name, text=F.when(quoted, text))
    tail = F.when(F.substr(o, F.length("text") + 2, F.lit(1)) == '"', F.substr(o, F.length("text") + 3))  # what follows the quotes
    given_type = F.when(tail.startswith("^^"), F.regexp_extract(tail, r"^\^\^(.++)$", 1))

    def full_name(c: Column) -> Column:
        colon = F.instr(c, ":")
        prefix, local = F.substr(c, F.lit(1), colon - 1), F.substr(c, colon + 1)
        base = F.coalesce(F.element_at("given", prefix), F.element_at(known, prefix), prefix)
        return F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 1 - c.endswith(">").cast("int"))).when(c.startswith("_:"), c).otherwise(F.concat(base, local))

    xsd = lambda name: F.lit(PREFIXES["xsd"] + name)
    datatype = (
        F.when(quoted, F.when(given_type != "", full_name(given_type)))
        .when(F.col("name") | o.startswith("'"), None)
        .when(o.rlike(r"^[+-]?[0-9]+$"), xsd("integer"))
        .when(o.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), xsd("decimal"))
        .when(o.isin("true", "false"), xsd("boolean"))
    )
    return rows.select(
        "doc",
        "pos",
        full_name(F.col("rs")).alias("s"),
        F.when(F.col("rp") == "a", TYPE).otherwise(full_name(F.col("rp"))).alias("p"),
        F.when(quoted, unescape(F.col("text"))).when(o.startswith("'"), strip_quotes(o)).when(F.col("name"), full_name(o)).otherwise(o).alias("o"),
        F.when(F.col("name") & o.startswith("_:"), "blank").when(F.col("name"), "uri").otherwise("literal").alias("o_kind"),
        datatype.alias("datatype"),
        F.when(tail.rlike("^@[A-Za-z0-9-]++$"), F.substr(tail, F.lit(2))).alias("lang"),
    )


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all Turtle files of a path, read in splits, so one file may be larger than a task; ``pos`` grows with the place in a file.

    A first pass tells prefixes and which splits have lines that do not stand alone.
    Lines that do are parsed where they are read. Only of files with others, the heads and those
    lines are shuffled, by split: a line finds the head before it in
    its split, or else the last one of the splits before, of which one row each is looked at.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())  # grows with the place within a split
    rows = _once(rows, value=F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")))
    rows = _once(rows, v=F.trim(strip_comment(F.col("value"))))
    v = F.col("v")
    on = ~((v == "") | v.startswith("@") | v.rlike(_WHOLE))  # heads are whole lines
    splits = materialize(rows.groupBy("doc", "block").agg(
        F.max(on).alias("goes_on"), F.collect_set(F.when(v.startswith("@") & v.rlike(_PREFIX), F.struct(F.regexp_extract(v, _PREFIX, 1), F.regexp_extract(v, _PREFIX, 2)))).alias("pairs")
    ), 0)
    # A row for each file, whose list the driver holds anyway; it goes to the lines instead of lines to it.
    files = splits.groupBy("doc").agg(F.max("goes_on").alias("goes_on"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("given"))
    files = F.broadcast(materialize(files, 0))
    line = lambda df, head: df.select("doc", F.struct("block", "seq").alias("pos"), "value", head.alias("head"), "given")
    none = F.lit(None).cast("string")
    if files.where("goes_on").isEmpty():
        return parse_turtle(line(rows.join(files, "doc"), none))
    alone = line(rows.join(files, "doc").where(~F.col("goes_on") | ~on), none)
    subject = F.regexp_extract(v, _HEAD, 1)
    some = _once(rows.join(files.where("goes_on"), "doc"), subject=F.when(subject != "", subject), on=on).where("subject is not null or on")
    heads = some.groupBy("doc", "block").agg(F.max_by("subject", F.when(F.col("subject").isNotNull(), F.col("seq"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("doc").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("doc", "block", before.alias("before"))
    inside = F.last("subject", ignorenulls=True).over(W.partitionBy("doc", "block").orderBy("seq"))
    some = some.withColumn("inside", inside).where("on").join(heads, ["doc", "block"])
    return parse_turtle(alone.unionByName(line(some, F.coalesce("inside", "before"))))


def read_dataset(spark: SparkSession, *paths: str) -> DataFrame:
    """``s, kind, attributes`` of all subjects of several files or folders; what they say of one subject is put together."""
    out = None
    for path in paths:
        rows = read_turtle(spark, path)
        out = rows if out is None else out.unionByName(rows)
    return by_class(out)


def by_class(triples: DataFrame) -> DataFrame:
    """``s, kind, attributes``: each subject with its class (entity if it has none) and a map of its other attributes."""
    kinds = {"Entity": "entity", "Activity": "activity", "Agent": "agent"}
    kind = F.lit(None).cast("string")
    for name, value in kinds.items():
        kind = F.when((F.col("p") == TYPE) & (F.col("o") == PREFIXES["prov"] + name), value).otherwise(kind)
    pairs = F.array_sort(F.collect_set(F.when(F.col("p") != TYPE, F.struct("p", "o"))))
    several = F.transform(F.array_distinct(F.transform(pairs, lambda x: x["p"])), lambda p: F.struct(p, F.transform(F.filter(pairs, lambda x: x["p"] == p), lambda x: x["o"])))
    return triples.groupBy("s").agg(F.coalesce(F.max(kind), F.lit("entity")).alias("kind"), F.map_from_entries(several).alias("attributes"))


def to_turtle(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``part, value``: prefix lines (part 0), then one line a triple (part 1) with names shortened by the prefixes."""
    prefixes = {"prov": PREFIXES["prov"], "xsd": PREFIXES["xsd"]} if prefixes is None else prefixes
    head = triples.sparkSession.createDataFrame([(0, f"@prefix {n}: <{b}> .") for n, b in prefixes.items()], "part int, value string")
    return head.unionByName(triples.select(F.lit(1).alias("part"), _triple_line(prefixes).alias("value")))


def _triple_line(prefixes: dict[str, str]) -> Column:
    """A triple (s, p, o, o_kind, datatype, lang) as a line of its own."""

    def short(c: str) -> Column:
        out = node_text(c)
        for name, base in prefixes.items():
            local = F.substring(c, len(base) + 1, 1 << 20)
            out = F.when(F.col(c).startswith(base) & local.rlike(r"^[\w-]++$"), F.concat(F.lit(name + ":"), local)).otherwise(out)
        return out

    o = F.when(F.col("o_kind") == "literal", literal_text()).otherwise(short("o"))
    return F.concat(short("s"), F.lit(" "), short("p"), F.lit(" "), o, F.lit(" ."))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """``to_turtle`` as gzip files, one for each task: each begins with the prefixes, so no row is moved for them."""
    prefixes = {"prov": PREFIXES["prov"], "xsd": PREFIXES["xsd"]} if prefixes is None else prefixes
    head = "".join(f"@prefix {n}: <{b}> .\n" for n, b in prefixes.items())
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the number of a row within its task
    lines = triples.select(F.concat(F.when(first, F.lit(head)).otherwise(F.lit("")), _triple_line(prefixes)).alias("value"))
    # One row after another into one file: a task's file has no limit of rows here.
    lines.write.option("maxRecordsPerFile", 0).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def class_triples(entities: DataFrame, activities: DataFrame, agents: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """Triples of the model: classes, types, times and names, and the four relations, with ids under ``base``."""
    null = F.lit(None).cast("string")
    node = lambda c: F.concat(F.lit(base), c)
    prov = PREFIXES["prov"]

    def rows_of(df: DataFrame, key: str, *of: Column) -> DataFrame:
        # One pass over a class, as its rows are joined and aggregated before.
        at = df.select(node(key).alias("s"), F.explode(F.array(*of)).alias("x")).where("x.o is not null")
        return at.select("s", "x.p", "x.o", "x.o_kind", "x.datatype", null.alias("lang"))

    def about(p: str, o: Column, kind: str = "literal", datatype: Column = null) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype"))

    kinds = lambda name, kind: (about(TYPE, F.lit(prov + name), "uri"), about(TYPE, F.col(kind)))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    when = F.lit(PREFIXES["xsd"] + "dateTime")
    times = [about(prov + p, stamp(c), "literal", when) for p, c in (("startedAtTime", "started_at"), ("endedAtTime", "ended_at"))]
    rows = [
        rows_of(entities, "entity_id", *kinds("Entity", "entity_type")),
        rows_of(activities, "activity_id", *kinds("Activity", "activity_type"), *times),
        rows_of(agents, "agent_id", *kinds("Agent", "agent_type"), about(prov + "agentName", F.col("agent_name"))),
    ]
    rows.append(edges.select(node("src").alias("s"), F.concat(F.lit(prov), "rel").alias("p"), node("dst").alias("o"), F.lit("uri").alias("o_kind"), null.alias("datatype"), null.alias("lang")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
