"""Corpus pipeline: the given documents through the corpus operators, stage by stage.

Each stage takes what the one before kept, as Parquet, and all but the last
return the columns of ``documents``: outliers of quality go; of near duplicates
the one with the smallest id stays; strings of 50 bytes that an earlier document has are
cut; secrets are masked; what is left is packed into sequences.  Rows with
null ids stay to the end; null texts are empty from the third stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocksmith.llm import harmonic_pack, induced_suffix, odd_sketch, quality_mcd, secret_novelty
from stocksmith.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, set to what the text has now."""
    if "n_chars" not in docs.columns:
        return docs
    now = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", now)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor are outliers of their language and source (a null text fails)."""
    return quality_mcd.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles agree by 0.8 or more, the one with the smallest id."""
    return odd_sketch.one_of_each(docs, percent=80, words=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters of 50-byte strings that a document with a smaller id has."""
    return _counted(induced_suffix.cut_repeats(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret masked."""
    return _counted(secret_novelty.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 2048 ids."""
    # workers still hold what the stages before it took: a smaller memory of words
    pieces = harmonic_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=250_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL states neither the tokenizer nor the packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
