"""A corpus pipeline over ``documents``: five stages, each reading what the last one wrote.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame. All but the last return the columns of ``documents``.
Other columns are ignored, whatever their names. Empty tables, null texts and
repeated rows are handled as the operators define.

A stage writes tables for itself. They belong to a ``Run``, which deletes those of
earlier stages when a stage begins on rows that no longer read them, as they would
pile up over the stages else; composed without a write in between, they stay.
``Run().stages`` are the stages with tables of their own, ``STAGES`` those of one run
for each input folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracework.llm.jaccard_join import ngram_jaccard_join
from tracework.llm.mixing import BLOCK, mix
from tracework.llm.pii import find_pii, redact
from tracework.llm.quality import score_quality
from tracework.llm.queries import PIECES, WEIGHTS
from tracework.llm.sentencepiece_codec import encode
from tracework.plans.materialize import drop, drop_paths, materialize, written, written_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class Run:
    """The tables that the stages of one run over the documents wrote for themselves, by their paths."""

    def __init__(self) -> None:
        self.left: list[str] = []

    def begin(self, docs: DataFrame) -> None:
        """Delete what earlier stages left, unless ``docs`` still reads of it: one table may be needed for another."""
        bare = lambda path: path.split(":", 1)[-1].lstrip("/")
        if self.left and not {bare(f).rsplit("/", 1)[0] for f in docs.inputFiles()} & set(map(bare, self.left)):
            drop_paths(docs.sparkSession, self.left)
            self.left = []

    def bound(self, function: Callable) -> Callable:
        @wraps(function)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            self.begin(docs)
            with written() as tables:
                out = function(spark, docs, sf_dir)
            self.left += [path for path in map(written_path, tables) if path]
            return out

        return stage

    @property
    def stages(self) -> list[tuple[str, Callable]]:
        return [(name, self.bound(function)) for name, function in FUNCTIONS]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs.select(*COLUMNS), labels, keep=COLUMNS).where("good").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest id, null ones last.

    The join goes by ids. Where ids repeat or are null, each row gets a key of its
    own, written once; of rows of one id in a component, the smallest hash stays.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = ngram_jaccard_join(docs).where("doc_id != component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = materialize(docs.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64(*COLUMNS)}))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")).alias("first")
    kept = (
        ngram_jaccard_join(rows, "_row")
        .select(F.col("doc_id").alias("_row"), "component_id")
        .join(rows.select("_row", "_hash", "doc_id"), "_row")
        .groupBy("component_id")
        .agg(first)
        .select("first._row")
    )
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    found = find_pii(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    changed = redact(found.withColumn("touched", F.size("spans") > 0))
    return changed.withColumn(
        "n_chars", F.when(F.col("touched"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order that mixes the sources to their weights."""
    placed = mix(docs.select(*COLUMNS), WEIGHTS)
    return (
        materialize(placed)
        .repartitionByRange("mix_slot", "mix_place")
        .sortWithinPartitions("mix_slot", "mix_place")
        .select(*COLUMNS)
    )


#: Rows that are numbered together where the order of a table is read.
RUN_ROWS = 4_096


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mix_slot, mix_place, position`` by the order in which ``docs`` lie.

    That is the order of the files by their names and of the rows in them, or of the
    partitions where the rows are not read from files. ``position`` is the row's place
    in it, from 0. Each ``BLOCK`` rows of a source are a block, begun by the first;
    ``mix_place`` is the place in it, and ``mix_slot`` how many blocks have begun
    up to the row, less one: in the order of ``mixture`` those of its schedule.
    """
    at = {"_s": F.coalesce(F.col("source").cast("string"), F.lit("")), "_id": F.monotonically_increasing_id()}
    docs = docs.select("doc_id", "text", "source")
    try:
        rows = docs.withColumns({**at, "_file": F.input_file_name(), "_start": F.input_file_block_start()})
    except AnalysisException:  # a plan with several sources, whose rows have the order of its partitions
        rows = docs.withColumns({**at, "_file": F.lit(""), "_start": F.lit(-1)})
    rows = materialize(rows.drop("source"))  # the numbers are fixed from here on
    run = ["_file", "_start", "_run"]
    slim = rows.select("_id", "_s", "_file", "_start", F.expr(f"_id div {RUN_ROWS}").alias("_run"))
    # What is before each run: one row for each run and source is looked at together, not the rows.
    before = lambda c, over: F.coalesce(F.sum(c).over(over.orderBy(*run).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = F.ceil((F.col("had") + F.col("n")) / BLOCK) - F.ceil(F.col("had") / BLOCK)
    counts = materialize(slim.groupBy(*run, "_s").agg(F.count(F.lit(1)).alias("n")).withColumn("had", before("n", W.partitionBy("_s"))))
    runs = counts.groupBy(*run).agg(F.sum("n").alias("n"), F.sum(begun).alias("begun"))
    starts = runs.select(*run, before("n", W.partitionBy()).alias("rows_before"), before("begun", W.partitionBy()).alias("begun_before"))
    inside = W.partitionBy(*run).orderBy("_id")
    placed = (
        slim.join(starts, run)
        .withColumn("position", F.col("rows_before") + F.row_number().over(inside) - 1)
        .join(counts.select(*run, "_s", "had"), [*run, "_s"])
        .withColumn("_n", F.col("had") + F.row_number().over(W.partitionBy(*run, "_s").orderBy("_id")) - 1)
        .withColumn("mix_place", (F.col("_n") % BLOCK).cast("int"))
        .withColumn("_begun", F.sum((F.col("mix_place") == 0).cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .select("_id", (F.col("begun_before") + F.col("_begun") - 1).alias("mix_slot"), "mix_place", "position")
    )
    return rows.join(placed, "_id").select("doc_id", "text", "mix_slot", "mix_place", "position")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its slot and place in the mixed order and its ``position`` in all of it.

    They are those of the order in which ``mixture`` wrote the rows; of rows in another order they would be others.
    """
    at = F.struct("doc_id", "mix_slot", "mix_place", "position")
    placed = materialize(in_order(docs).select(at.alias("doc_id"), "text"))
    return encode(placed, PIECES).select(
        "doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "doc_id.mix_slot", "doc_id.mix_place", "doc_id.position"
    )


FUNCTIONS = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sentencepiece", pieces),
]
_RUNS: dict[str, Run] = {}


def _by_folder(function: Callable) -> Callable:
    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return _RUNS.setdefault(sf_dir, Run()).bound(function)(spark, docs, sf_dir)

    return stage


STAGES = [(name, _by_folder(function)) for name, function in FUNCTIONS]

#: No SQL expresses the fitted models or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again, in a run of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Run().stages
    for _, stage in stages[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        drop(docs)  # what the stage before wrote; the input itself stays
        docs = kept
    return stages[-1][1](spark, docs, sf_dir)
