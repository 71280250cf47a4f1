"""The operators applied to the given tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescout.llm import (
    chat, licenses, minhash, mixing, neighbours, packing, quality, runs, secrets, sharding, substring, toxicity, whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.digest(packing.pack(_table(spark, folder, "documents")))


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document after its repeated windows of 20 words are cut."""
    return substring.drop_repeats(_table(spark, folder, "documents")).drop("kept_text")


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector by cosine."""
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150% takes of every document."""
    return mixing.digest(mixing.plan(_table(spark, folder, "documents")))


def byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard(_table(spark, folder, "documents"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality features and verdict of every document."""
    return quality.digest(quality.judge(_table(spark, folder, "documents")))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, in two runs as a growing corpus has them.

    The first run addresses the documents in the older half of the range of ids. The second one goes over
    all documents and scans what the ledger of the first lacks: texts that were not there before.
    """
    documents = _table(spark, folder, "documents")
    ids = documents.agg(F.min("doc_id").cast("double").alias("low"), F.max("doc_id").cast("double").alias("high")).first()
    older = documents.where(F.col("doc_id") * 2.0 <= F.lit(ids["low"]).cast("double") + F.lit(ids["high"]).cast("double"))
    return secrets.digest(secrets.find_secrets(documents, secrets.extend(older)))


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as canonical JSON, with its place and links."""
    return chat.link(_table(spark, folder, "conversations"))


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named in every document."""
    return licenses.scan_licenses(_table(spark, folder, "documents")).drop("matches")


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from confirmed toxic and from unlabelled ones."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, and what remains of it without their repetitions."""
    return runs.collapse_runs(_table(spark, folder, "documents"), outputs=False)


def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the four leading components of all, at unit variance."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lexical_packing": lexical_packing,
    "op2_minhash_near_dedup": minhash_near_dedup,
    "op3_substring_dedup": substring_dedup,
    "op4_nearest_vectors": nearest_vectors,
    "op5_source_mix": source_mix,
    "op6_byte_shards": byte_shards,
    "op7_quality_rules": quality_rules,
    "op8_secret_scan": secret_scan,
    "op9_chat_messages": chat_messages,
    "op10_license_scan": license_scan,
    "op11_toxicity_scores": toxicity_scores,
    "op12_periodic_runs": periodic_runs,
    "op13_whitened_vectors": whitened_vectors,
}
