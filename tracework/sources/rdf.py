"""RDF text: N-Triples in and out, blank nodes replaced by stable identifiers, triples as log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.functions.ids import blank_node_uuid, document_seed, is_uuid, turtle_escape, xsd_type

#: Possessive throughout, so a line is read once however long its literal is.
_LITERAL = r'"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*+)>)?'
_LINE = r"(?s)^\s*+(<[^>]*+>|_:[A-Za-z0-9_-]++)\s++<([^>]*+)>\s++(<[^>]*+>|_:[A-Za-z0-9_-]++|" + _LITERAL + r")\s*+\.\s*+(?:#.*+)?$"
_BLANK = r"^_:[A-Za-z0-9_-]*$"


def unescape(text: Column) -> Column:
    """Text of a literal with its escapes resolved: those of JSON, ``\\'`` and ``\\U`` with eight hex digits."""
    codes = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1)))
    one = lambda s: F.aggregate(
        codes(s), s, lambda acc, c: F.replace(acc, F.concat(F.lit("\\U"), c), F.decode(F.unhex(c), "UTF-32"))
    )
    wide = F.array_join(F.transform(F.split(text, r"\\\\"), one), "\\\\")  # between escaped backslashes
    json = F.concat(F.lit('["'), F.when(text.contains("\\U"), wide).otherwise(text), F.lit('"]'))
    options = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    return F.when(text.contains("\\"), F.from_json(json, "array<string>", options)[0]).otherwise(text)


def _is_triple(v: Column) -> Column:
    return v.rlike(_LINE) & ~v.rlike(r"^\s*[#@]")


def parse_ntriples(lines: DataFrame, value: str = "value") -> DataFrame:
    """``s, p, o, o_kind, datatype, lang`` of each line; comments, directives and bad lines give none."""
    v = F.col(value)
    part = lambda i: F.regexp_extract(v, _LINE, i)
    keep = [c for c in lines.columns if c != value]
    names = ("_s", "_p", "_o", "_text", "_lang", "_type")
    rows = lines.where(_is_triple(v)).select(*keep, *(part(i).alias(n) for i, n in enumerate(names, 1)))
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.col("_o").startswith('"')
    return rows.select(
        *keep,
        bare("_s").alias("s"),
        F.col("_p").alias("p"),
        F.when(literal, unescape(F.col("_text"))).otherwise(bare("_o")).alias("o"),
        F.when(literal, "literal").when(F.col("_o").startswith("_:"), "blank").otherwise("uri").alias("o_kind"),
        F.when(F.col("_type") != "", F.col("_type")).alias("datatype"),
        F.when(F.col("_lang") != "", F.col("_lang")).alias("lang"),
    )


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that are neither triples nor comments, directives or blank."""
    v = F.col(value)
    return lines.where(~_is_triple(v) & ~v.rlike(r"^\s*([#@]|$)"))


def rdf_format(path: Column) -> Column:
    """Format of a file by the end of its name; Turtle if there is no telling."""
    # File extensions and formats.
    out = F.lit("turtle")
    for end, kind in ((".rdf", "rdf/xml"), (".owl", "rdf/xml"), (".ttl", "turtle"), (".nt", "n-triples"), (".n3", "n3"), (".jsonld", "jsonld")):
        out = F.when(path.endswith(end), kind).otherwise(out)
    return out


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc, seed, value``: lines of all files of a path, with the file and its seed.

    Lines are read in splits; only the digest of a file takes the file as a whole.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), "value")
    whole = spark.read.format("binaryFile").load(path)
    seeds = whole.select(F.col("_metadata.file_path").alias("doc"), document_seed(F.col("content")).alias("seed"))
    return lines.join(seeds, "doc")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all files of a path, with blank nodes made stable within each document."""
    return skolemize(parse_ntriples(document_lines(spark, path)), "seed").drop("seed", "doc")


def skolemize(triples: DataFrame, seed: str) -> DataFrame:
    """Blank nodes in subject and object replaced by their UUID in the document."""

    def fixed(c: str):
        label = F.regexp_replace(F.col(c), "^_:", "")
        return F.when(F.col(c).rlike(_BLANK), blank_node_uuid(label, F.col(seed))).otherwise(F.col(c))

    plain = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(fixed("o"))
    return triples.withColumns({"s": fixed("s"), "o": plain})


def blank_nodes_left(triples: DataFrame) -> DataFrame:
    """One row: how many triples still name a blank node, and whether none does."""
    named = F.col("s").rlike(_BLANK) | ((F.col("o_kind") != "literal") & F.col("o").rlike(_BLANK))
    return triples.agg(F.count_if(named).alias("left_over")).withColumn("valid", F.col("left_over") == 0)


def ingest(triples: DataFrame, tx: int) -> DataFrame:
    """Log rows ``e, a, v, tx, op`` and ``type`` of triples: types, references and typed literals.

    A type triple becomes ``prov/entity-type``; a generation, use or association
    whose object is a UUID becomes that relation; any other predicate keeps its
    name with all but letters, digits, ``_`` and ``-`` replaced. A literal that
    does not parse as its type is left out.
    """
    reference = F.regexp_extract("p", "(wasGeneratedBy|used|wasAssociatedWith)$", 1)
    rows = triples.withColumn("known", F.when((reference != "") & is_uuid(F.col("o")), reference))
    typed = xsd_type(F.coalesce("datatype", F.lit("string")))
    rows = rows.withColumn("type", F.when(F.col("o_kind") == "literal", typed).when(F.col("known").isNotNull(), "ref").otherwise("string"))
    attribute = (
        F.when(F.col("p").endswith("type"), "prov/entity-type")
        .when(F.col("known").isNotNull(), F.concat(F.lit("prov/"), "known"))
        .otherwise(F.regexp_replace("p", "[^A-Za-z0-9_-]", "_"))
    )
    cast = {name: F.col("o").try_cast(name).cast("string") for name in ("bigint", "double", "float", "boolean", "timestamp")}
    value = F.col("o")
    for name, text in cast.items():
        value = F.when(F.col("type") == name, text).otherwise(value)
    rows = rows.select(F.col("s").alias("e"), attribute.alias("a"), value.alias("v"), F.lit(tx).cast("long").alias("tx"), F.lit("add").alias("op"), "type")
    return rows.where("v is not null").distinct()


def node_text(c: str) -> Column:
    """A node as N-Triples writes it."""
    return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))


def literal_text(o: str = "o", lang: str = "lang", datatype: str = "datatype") -> Column:
    """A literal as N-Triples writes it, escaped."""
    end = (
        F.when(F.col(lang).isNotNull(), F.concat(F.lit("@"), lang))
        .when(F.col(datatype).isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">")))
        .otherwise("")
    )
    return F.concat(F.lit('"'), turtle_escape(F.col(o)), F.lit('"'), end)


def to_ntriples(triples: DataFrame) -> DataFrame:
    """``value``: one line a triple."""
    o = F.when(F.col("o_kind") == "literal", literal_text()).otherwise(node_text("o"))
    return triples.select(F.concat(node_text("s"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def blank_node_statistics(lines: DataFrame, value: str = "value") -> DataFrame:
    """``node, n``: how often each blank node is named."""
    return lines.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(r"(_:[A-Za-z0-9_-]+)"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
