"""The registered queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_anchors, fagin_topk, harmonic_pack, induced_suffix, line_blocks, odd_sketch, oracles, piece_codec, quality_mcd, rank_merge, secret_novelty, token_align, url_digest, whitening
from .common import table


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of each document: counts, base rules and robust outliers per language and source."""
    return quality_mcd.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality_mcd.RESULT, "kept")


def op2_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: fixed patterns, and strings that a primed zstandard frame cannot shorten."""
    found = secret_novelty.scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = secret_novelty.as_text(F.filter("spans", lambda s: s.kind != "novel"))
    return found.select("doc_id", *map(number, secret_novelty.KINDS), F.sha2(base, 256).alias("base_sha256"), secret_novelty.as_text(F.col("spans")).alias("spans"))


def op3_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity of 0.8 or more."""
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), percent=80, words=2)


#: The query's rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL judged by the longest fitting rule in a sorted digest array; allowed without one."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_digest.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_fagin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of each vector whose id is divisible by 20, against all others."""
    rows = fagin_topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return fagin_topk.top_k(rows, rows.where("id % 20 = 0"), 20)


def op6_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the words of 50-word windows that a smaller document has, by difference-cover anchors."""
    left = cover_anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_induced_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of 50-byte strings that a smaller document has, by induced suffix arrays."""
    left = induced_suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document through the SentencePiece model and back: its ids, parity with the library, and the round trip."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "parity", (F.col("decoded") == F.col("text")).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic packing of all documents into sequences of 2048 ids, one row per piece."""
    pieces = harmonic_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the byte-level BPE file, counted by rank-synchronous merging."""
    return rank_merge.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened components of each embedding, fitted on all of them with their multiplicities."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE and SentencePiece tokens of each document, aligned by interval coalescing."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.align(table(spark, sf_dir, "documents"), a, b, digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text by line-block distribution."""
    pages = line_blocks.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mcd": op1_quality_mcd,
    "op2_secret_novelty": op2_secret_novelty,
    "op3_odd_sketch": op3_odd_sketch,
    "op4_url_digest": op4_url_digest,
    "op5_fagin_topk": op5_fagin_topk,
    "op6_cover_anchors": op6_cover_anchors,
    "op7_induced_suffix": op7_induced_suffix,
    "op8_piece_codec": op8_piece_codec,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_token_align": op12_token_align,
    "op13_line_blocks": op13_line_blocks,
}

#: Operators 2, 8 to 10 and 12 need zstandard and the tokenizers' libraries, 11 eigenvectors, 13 markup: the tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_quality_mcd": oracles.quality_sql(),
    "op3_odd_sketch": oracles.NEAR_DUPLICATES,
    "op4_url_digest": oracles.URL_RULES_SQL.format(rules=", ".join(map(str, URL_RULES))),
    "op5_fagin_topk": oracles.TOP_K,
    "op6_cover_anchors": oracles.WORD_REPEATS,
    "op7_induced_suffix": oracles.BYTE_REPEATS,
}
