"""The registered query of each operator, and its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, bpe_codec, html_extraction, length_buckets, line_dedup, merkle_manifest, ngram_join, quality_classifier, quality_rules, subvector_kmeans, token_files, toxicity, vector_topk
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"), bpe)


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text that stays (as its md5), its lines before, and the lines removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "n_lines", "n_removed")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_codec.digests(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_files(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_files(manifest)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = length_buckets.pack_documents(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")


def op12_subvector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvector_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, where texts of every other id (by CRC-32) are shown without their line feeds."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = [*map(F.col, fields[:-1]), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
    return merkle_manifest.prove(table(spark, sf_dir, "documents"), fields=fields, presented=shown).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_vector_topk, op3_line_dedup, op4_quality_classifier, op5_html_extraction, op6_bpe_codec, op7_token_files, op8_best_fit_packing, op9_ngram_join, op10_toxicity, op11_length_buckets, op12_subvector_kmeans, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_vector_topk": vector_topk.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op12_subvector_kmeans": subvector_kmeans.oracle(), "op13_merkle_manifest": merkle_manifest.oracle()}
