"""Files of records, payloads, summaries and manifests, in and out, and the registry of loaded ontologies."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.functions.ids import uuid3

#: Fields of a recall record; all are text.
RECALL = (
    "recall_number string, event_id string, recalling_firm string, product_description string, city string, state string, country string, "
    "distribution_pattern string, recall_initiation_date string, report_date string, termination_date string"
)
#: Fixed value: what the hex text of a stored record begins with once decoded.
PAYLOAD_PREFIX = "OPENFDA_PRODUCT_EQUIVALENT_V1\n"


def read_recalls(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Recall records of JSON files that hold a ``records`` or ``results`` array (the first where both are there), or one record a line.

    Files of one record a line are read in splits, however large; a file that is
    one JSON document is one row, and so has to fit in a task.
    """
    one = f"struct<{', '.join(f.replace(' ', ':', 1) for f in RECALL.split(', '))}>"
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RECALL).alias("r")).where("r.recall_number is not null")
    by_line = {unquote(r.file).split(":", 1)[-1].lstrip("/") for r in lines.select("file").distinct().collect()}  # names of files
    rest = [f for f in text.inputFiles() if unquote(f).split(":", 1)[-1].lstrip("/") not in by_line]
    rows = lines.select("r.*")
    if rest:
        whole = spark.read.text(rest, wholetext=True)
        parsed = whole.select(F.from_json("value", f"records array<{one}>, results array<{one}>").alias("j"), F.from_json("value", f"array<{one}>").alias("a"))
        documents = parsed.select(F.explode(F.coalesce("j.records", "j.results", "a")).alias("r")).select("r.*")
        rows = rows.unionByName(documents.where("recall_number is not null"))
    return rows if limit is None else rows.limit(limit)


def decode_payloads(inputs: DataFrame, column: str = "input", prefix: str = PAYLOAD_PREFIX, schema: str = RECALL) -> DataFrame:
    """Records of hex texts (with or without ``0x``): UTF-8 with a prefix, then JSON. What does not decode gives no row."""
    bare = F.when(F.col(column).rlike("^(0x)?([0-9a-fA-F]{2})+$"), F.regexp_replace(column, "^0x", ""))
    text = F.try_validate_utf8(F.unhex(bare).cast("string"))
    body = inputs.select(text.alias("t")).where(F.col("t").startswith(prefix))
    return body.select(F.from_json(F.substring("t", len(prefix) + 1, 1 << 30), schema).alias("r")).where("r is not null").select("r.*")


def encode_payloads(records: DataFrame, prefix: str = PAYLOAD_PREFIX) -> DataFrame:
    """``input``: each record as the hex text of the prefix and its JSON."""
    return records.select(F.concat(F.lit("0x"), F.lower(F.hex(F.encode(F.concat(F.lit(prefix), F.to_json(F.struct(*records.columns))), "UTF-8")))).alias("input"))


def read_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``agents, products, activities`` of nested JSON files: one row a key, attributes as a map of texts."""
    shape = ", ".join(f"{k} map<string,map<string,string>>" for k in ("agents", "products", "activities"))
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j"))
    return {k: rows.select(F.explode(f"j.{k}").alias("key", "attributes")) for k in ("agents", "products", "activities")}


def read_bundles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``entities, activities, agents`` of JSON lines that hold an entity with lists of its activities and agents."""
    shape = (
        "entity struct<entity_id:string,entity_type:string,batch:string,product_name:string,was_generated_by:string>, "
        "activities array<struct<activity_id:string,activity_type:string,started_at:timestamp,ended_at:timestamp>>, "
        "agents array<struct<agent_id:string,agent_name:string,agent_type:string>>"
    )
    return split_bundles(spark.read.schema(shape).json(path))


def split_bundles(rows: DataFrame) -> dict[str, DataFrame]:
    """The three tables of rows ``entity, activities, agents``, each row once."""
    return {
        "entities": rows.where("entity.entity_id is not null").select("entity.*").distinct(),
        "activities": rows.select(F.explode("activities").alias("x")).select("x.*").distinct(),
        "agents": rows.select(F.explode("agents").alias("x")).select("x.*").distinct(),
    }


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder; nulls are left out."""
    rows.write.mode("error").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header in a folder."""
    rows.write.mode("error").option("header", True).csv(path)


def read_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all summary files of a path, with the file each comes from."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name"))


def parse_manifests(lines: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """``file, manifest``: the ``key=value`` lines of each file as a map; of a repeated key the greatest value."""
    v = F.col(value)
    pairs = lines.where(v.contains("=")).select(
        file, F.trim(F.substring_index(v, "=", 1)).alias("k"), F.trim(v.substr(F.instr(v, "=") + 1, F.length(v))).alias("x")
    )
    each = pairs.groupBy(file, "k").agg(F.max("x").alias("x"))
    return each.groupBy(file).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("manifest"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifests(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of all files of a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# Imports that are kept: a folder for each table, in it one for each import


def import_bundles(rows: DataFrame, path: str, import_id: str) -> None:
    """Store the tables of bundles (``entity, activities, agents``) under an import's id.

    An import done again replaces what it stored before, so doing it twice leaves
    the same rows; other imports stay.
    """
    for name, table in split_bundles(rows).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/import_id={import_id}")


def imported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``entities, activities, agents`` over all imports; of one id the row of the greatest import counts."""
    out = {}
    for name, key in (("entities", "entity_id"), ("activities", "activity_id"), ("agents", "agent_id")):
        rows = spark.read.parquet(f"{path}/{name}").withColumn("import_id", F.col("import_id").cast("string"))
        rest = [c for c in rows.columns if c not in (key, "import_id")]
        out[name] = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("import_id", *rest)).alias("r")).select(key, "r.*")
    return out


# Registry of loaded ontologies: id, name, namespace, format, version, loaded_at


def register(registry: DataFrame, loaded: DataFrame) -> DataFrame:
    """The registry with new entries; one of the same name is replaced (reload), of two new ones the later counts."""
    rest = [c for c in loaded.columns if c != "name"]
    new = loaded.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "version")).alias("r")).select("name", "r.*")
    return registry.join(new.select("name"), "name", "left_anti").select(loaded.columns).unionByName(new.select(loaded.columns))


def store_registry(loaded: DataFrame, path: str) -> None:
    """Add entries to a stored registry. Its versions lie in folders by number, the last one counts, the one before stays until the next."""
    spark = loaded.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at)) if files.exists(at) else []
    before = spark.read.parquet(f"{path}/registry_version={known[-1]}") if known else loaded.where("false")
    register(before, loaded).write.mode("error").parquet(f"{path}/registry_version={known[-1] + 1 if known else 1}")
    for old in known[:-1]:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/registry_version={old}"), True)


def stored_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as last stored."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("registry_version")).first()[0]
    return rows.where(F.col("registry_version") == last).drop("registry_version")


def by_name(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name)


def is_loaded(registry: DataFrame, names: DataFrame) -> DataFrame:
    """``name, loaded`` for each name asked."""
    there = registry.select("name").distinct().withColumn("loaded", F.lit(True))
    return names.select("name").join(there, "name", "left").select("name", F.coalesce("loaded", F.lit(False)).alias("loaded"))


def registry_statistics(registry: DataFrame) -> DataFrame:
    return registry.groupBy("format").agg(F.count(F.lit(1)).alias("ontologies"), F.countDistinct("namespace").alias("namespaces"))


# Loading sample data


def located(location: Column, address: str = "address", district: str = "district", province: str = "province") -> Column:
    """A place given as a map of texts: its address, else district and province, else ``Unknown Location``."""
    area = F.concat_ws(", ", location[district], location[province])
    return F.coalesce(location[address], F.when(area != "", area), F.lit("Unknown Location"))


#: Classes of the sample's agents and products by key; others keep the key.
TYPES = {"farmer": "organization/farm", "manufacturer": "organization/manufacturer", "retailer": "organization/retailer", "raw-milk": "product/batch"}


def load_sample(documents: dict[str, DataFrame], links: DataFrame, seed: str = "uht-seed") -> dict[str, DataFrame]:
    """``entities, activities, agents, edges`` of nested documents, with stable ids by key.

    ``documents`` are ``agents, products, activities`` as ``read_documents`` gives
    them; ``links`` has activity, rel (used, wasGeneratedBy or wasAssociatedWith)
    and other, the key of the product or agent. Types and places have defaults.
    """
    of = lambda kind, key: uuid3(F.concat(F.lit(f"{seed}/{kind}/"), F.col(key)))
    at = lambda name: F.col("attributes")[name]
    names = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    kind = F.coalesce(at("type"), names[F.col("key")], F.col("key"))
    place = located(F.col("attributes"))
    entities = documents["products"].select(of("entity", "key").alias("entity_id"), kind.alias("entity_type"), at("batch").alias("batch"), F.coalesce(at("product"), F.col("key")).alias("product_name"))
    activities = documents["activities"].select(
        of("activity", "key").alias("activity_id"), kind.alias("activity_type"), F.try_to_timestamp(at("started_at")).alias("started_at"),
        F.try_to_timestamp(at("ended_at")).alias("ended_at"), place.alias("location"),
    )
    agents = documents["agents"].select(of("agent", "key").alias("agent_id"), F.coalesce(at("name"), F.col("key")).alias("agent_name"), kind.alias("agent_type"), place.alias("location"))
    activity, entity, agent = of("activity", "activity"), of("entity", "other"), of("agent", "other")
    made = F.col("rel") == "wasGeneratedBy"
    other = F.when(F.col("rel") == "wasAssociatedWith", agent).otherwise(entity)
    edges = links.select(F.when(made, entity).otherwise(activity).alias("src"), "rel", F.when(made, activity).otherwise(other).alias("dst")).distinct()
    return {"entities": entities, "activities": activities, "agents": agents, "edges": edges}


#: Classes of the whole dataset by key.
AGENT_TYPES = {k: f"organization/{k}" for k in ("farmer", "manufacturer", "logistics", "retailer", "consumer")}
PRODUCT_TYPES = {"raw-milk": "product/raw-milk", "chocolate": "product/chocolate-uht", "plain": "product/plain-uht", "strawberry": "product/strawberry-uht"}
ACTIVITY_TYPES = {k: f"activity/{k}" for k in ("milking", "uht-processing", "chocolate-processing", "plain-processing", "strawberry-processing", "transport", "retail-sale")}


def load_dataset(documents: dict[str, DataFrame], loaded_at: Column, seed: str = "uht-full") -> dict[str, DataFrame]:
    """``agents, products, activities`` of the whole dataset, with classes by key and defaults for what is missing.

    Agents of other keys are ``organization/other``; products and activities of
    keys that have no class are left out. Certifications are a list in one text,
    split at commas. Activities start when they are loaded.
    """
    at = lambda name: F.col("attributes")[name]
    of = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("key")]
    own = lambda kind: uuid3(F.concat(F.lit(f"{seed}/{kind}/"), F.col("key")))
    agents = documents["agents"].select(
        own("agent").alias("agent_id"), F.coalesce(at("agent-name"), F.lit("Unknown Agent")).alias("agent_name"), F.coalesce(of(AGENT_TYPES), F.lit("organization/other")).alias("agent_type"),
        F.coalesce(at("location"), F.lit("Unknown Location")).alias("location"), F.coalesce(F.split(at("certifications"), ", *"), F.array().cast("array<string>")).alias("certifications"),
    )
    products = documents["products"].select(
        own("entity").alias("entity_id"), of(PRODUCT_TYPES).alias("entity_type"), F.coalesce(at("batch"), F.lit("UNKNOWN")).alias("batch"),
        F.coalesce(at("product"), at("variant-name"), F.lit("Unknown Product")).alias("product_name"),
    ).where("entity_type is not null")
    activities = documents["activities"].select(own("activity").alias("activity_id"), of(ACTIVITY_TYPES).alias("activity_type"), loaded_at.alias("started_at")).where("activity_type is not null")
    return {"agents": agents, "products": products, "activities": activities}
