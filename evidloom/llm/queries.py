"""Registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm import secrets as sec
from evidloom.llm import toxicity
from evidloom.llm.decontamination import with_benchmark_hits
from evidloom.llm.ngram_join import ngram_components
from evidloom.llm.packing import pack
from evidloom.llm.personal_data import with_personal_data
from evidloom.llm.prefix_trie import conversation_trie
from evidloom.llm.quality import held_out, train, with_quality
from evidloom.llm.resampling import importance_resample
from evidloom.llm.token_counts import stored_counts
from evidloom.llm.training_order import materialise
from evidloom.llm.vector_dedup import vector_components
from evidloom.llm.warc import archive_round_trip

TOKEN_LIMIT = 512
TOXIC_FROM = 0.3


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _of_kind(spans: str, kind) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == F.lit(kind))).cast("long")


def ngram_jaccard(spark, folder):
    return ngram_components(_read(spark, folder, "documents"))


def secret_scan(spark, folder):
    found = sec.with_secrets(_read(spark, folder, "documents").select("doc_id", "text"), "text")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    counts = [_of_kind("secrets", k).alias(f"n_{n}") for k, n in enumerate(sec.KINDS)]
    return found.select("doc_id", *counts, F.sha2(sec.span_text(base), 256).alias("base_sha256"),
                        sec.span_text(F.col("secrets")).alias("spans"))


def decontaminate(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return with_benchmark_hits(docs, "text", _read(spark, folder, "benchmark")).drop("text")


def personal_data(spark, folder):
    found = with_personal_data(_read(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")
    kinds = ["email", "ip", "card", "phone"]
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    counts = [_of_kind("personal_data", k).alias(f"n_{k}") for k in kinds]
    base = F.filter("personal_data", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("personal_data")).alias("spans"),
                        _of_kind("personal_data", "iban").alias("n_iban"),
                        F.coalesce(F.array_max("personal_data.score"), F.lit(0.0)).alias("top_score"))


def quality_scores(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    scored = with_quality(docs, "text", train(docs, _read(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def warc_round_trip(spark, folder):
    return archive_round_trip(_read(spark, folder, "pages")).drop("payload")


def embedding_dedup(spark, folder):
    return vector_components(_read(spark, folder, "embeddings"))


def token_counts(spark, folder):
    """Counts at every prefix, stored; the answers are read from them."""
    counted = stored_counts(_read(spark, folder, "documents"), "doc_id", "text").drop("prefix")
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def training_shards(spark, folder):
    return materialise(_read(spark, folder, "documents"), "doc_id", "text")


def best_fit_packing(spark, folder):
    return pack(_read(spark, folder, "documents"), "doc_id", "text")


def toxicity_scores(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, "text", toxicity.train(docs, _read(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def prefix_trie(spark, folder):
    return conversation_trie(_read(spark, folder, "conversations"))


def importance_resampling(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return importance_resample(docs, _read(spark, folder, "benchmark")).drop("n_words")


QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard, "op2_secret_scan": secret_scan, "op3_decontaminate": decontaminate,
    "op4_personal_data": personal_data, "op5_quality": quality_scores, "op6_warc": warc_round_trip,
    "op7_embedding_dedup": embedding_dedup, "op8_token_counts": token_counts, "op9_training_shards": training_shards,
    "op10_best_fit_packing": best_fit_packing, "op11_toxicity": toxicity_scores,
    "op12_prefix_trie": prefix_trie, "op13_importance_resampling": importance_resampling,
}
ORACLE: dict[str, str] = {}
