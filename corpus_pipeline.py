"""The corpus pipeline: rejects low quality, keeps one of near copies, cuts repeated passages, masks secrets, packs sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import ngram_join, packing, quality_rules, secret_scan, substring_dedup
from foliospark.llm.shared import discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.assess(docs, table(spark, sf_dir, "labels")).where("quality_.kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_first(docs, 5, 80, 100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has; documents of which nothing is left go."""
    cut = substring_dedup.deduplicate(docs).where("removal.n_words = 0 or removal.n_removed < removal.n_words")
    return _counted(cut.drop("removal"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("substring_dedup", passages), ("secret_scan", secrets), ("best_fit_packing", pack)]

#: The likelihood ratio, the Jaccard components and the plan of a linear program aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
