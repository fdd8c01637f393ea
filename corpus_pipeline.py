"""From raw documents to packed sequences: quality rules, quality classifier, line dedup, near duplicates, packing.

Each stage takes all documents that its predecessor kept, as a table with the columns of `documents`, and its
decisions take effect; the last stage returns the packed pieces. Every stage is written to the shared folder
and read again, so a lost executor costs part of one stage.

Defined results: null, empty and blank texts fail the base rules and go. Rows that share an id are judged one by one,
and in the near-duplicate stage stay or go together; rows without an id are judged like others and are never taken
for a duplicate. An empty table gives an empty result. Columns beside those of `documents` are not read, so their
names cannot clash.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.llm import best_fit_packing, line_dedup, ngram_join, quality_classifier, quality_rules
from vidweave.llm.common import prepare, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's fertility band go."""
    prepare(spark)
    bpe = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN
    return quality_rules.kept_rows(docs.select(COLUMNS), vocabularies.path("piece_bpe_32k.model"), bpe)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    prepare(spark)
    return quality_classifier.kept_rows(docs.select(COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; n_chars follows the text."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the smallest id stays."""
    prepare(spark)
    return ngram_join.one_of_each(docs.select(COLUMNS), width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    prepare(spark)
    return best_fit_packing.pack_documents(docs, vocabularies.path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("ngram_join", near_duplicates), ("best_fit_packing", packing)]

#: Tokenisers, EM and the genetic packing have no SQL form; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
