"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public BPE vocabulary; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Public byte-level BPE vocabulary whose tokens are counted.
TOKENS = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights of the mixed sources: the large source a third, the others alike.
WEIGHTS = {"src0": 9.5}
#: Rules of the URL filter.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Schemas of the tools that conversations stand for.
SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    },
    "search": {
        "type": "object",
        "properties": {"limit": {"type": "integer"}, "query": {"type": "string"}},
        "required": ["limit", "query"],
        "additionalProperties": False,
    },
}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs, WEIGHTS)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.language_id import identify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    dictionaries = learn(docs.where(~held_out))
    return identify(docs, dictionaries).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score", "margin", "rejected"
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.embedding_dedup import lattice_near_duplicates

    return lattice_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.tool_calls import calls_of_conversations, link_tool_calls

    calls, results = calls_of_conversations(_table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.topk_search import exact_top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.pii import BASE, find_pii

    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = {f"n_{k}": count(k) for k in BASE}
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") > 0).alias("has_personal_data"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.url_filter import judge, with_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = with_rules(pages, RULES).where("rule is not null")
    return judge(pages, RULES, labelled.select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("label")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm import sentencepiece_codec as codec

    encoded = codec.encode(_table(spark, sf_dir, "documents"), PIECES)
    return codec.decode(encoded, PIECES).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.jaccard_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracework.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENS))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.conversation_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations")).drop("node")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracework.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_source_mixing,
            op2_quality_classifier,
            op3_language_id,
            op4_embedding_near_dedup,
            op5_tool_calls,
            op6_exact_top_k,
            op7_pii,
            op8_url_filter,
            op9_sentencepiece,
            op10_ngram_jaccard_join,
            op11_token_counts,
            op12_conversation_trie,
            op13_embedding_whitening,
            pipeline,
        )
    }


def oracle_sql() -> dict:
    from tracework.llm.sql import SQL

    return SQL
