"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, centroids, embeddings, language, licenses, line_templates, media, near_duplicates, packing, suffixes, token_counts, toxicity, whitening
from .common import documents, held_out

#: Parameters: the public vocabularies' files.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels, ~held_out("doc_id", 5, 0))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECES)


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op6_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(documents(spark, sf_dir), BYTE_BPE)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE)


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.label(docs, language.learn(docs, ~held_out("doc_id", 4, 2)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switched")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hash_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeated_strings(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_toxicity_nnpu, op2_unigram_token_counts, op3_license_templates, op4_line_templates, op5_parity_sketch_join, op6_epsilon_grid_join, op7_bpe_forced_boundaries, op8_media_columns, op9_best_fit_packing, op10_crf_language_id, op11_embedding_whitening, op12_hash_suffix_dedup, op13_dual_tree_lloyd)}

ORACLE_SQL = {"op4_line_templates": line_templates.ORACLE_SQL, "op5_parity_sketch_join": near_duplicates.ORACLE_SQL, "op6_epsilon_grid_join": embeddings.ORACLE_SQL, "op12_hash_suffix_dedup": suffixes.ORACLE_SQL, "op13_dual_tree_lloyd": centroids.oracle_sql()}
