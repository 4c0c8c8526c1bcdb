"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, imatch, licenses, lines, minhash, outliers, packing, source_audit, suffix_dedup, token_counts, toxicity, vector_codes
from .common import table
from .registry import query

BYTE_LEVEL = {
    "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
    "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
}
WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 512


@query("op1_near_dedup", minhash.NEAR_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents, on word pairs."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


@query("op2_license_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """License notices of every document, without their spans."""
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("spans")


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return bpe.encode_digests(table(spark, folder, "documents"), WORDS)


@query("op4_line_dedup", lines.LINES_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Line counts and digests of what line dedup keeps of every document."""
    return lines.line_digests(table(spark, folder, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all packed sequences."""
    return packing.pack(table(spark, folder, "documents"), **BYTE_LEVEL, keep_ids=False).drop("ids")


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document."""
    counts = token_counts.count_tokens(table(spark, folder, "documents"), **BYTE_LEVEL)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    rows = outliers.verdicts(table(spark, folder, "documents"))
    return rows.select("doc_id", *outliers.BASE, "kept", "distance")


@query("op8_html_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_imatch_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.compared(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_vector_codes", vector_codes.CODES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of all vectors."""
    return vector_codes.code_digests(table(spark, folder, "embeddings"))


@query("op12_source_audit", source_audit.AUDIT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of each source from the others of its language, and the terms that set it apart."""
    return source_audit.audit(table(spark, folder, "documents"))


@query("op13_suffix_dedup", suffix_dedup.REPEATS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one, removed."""
    return suffix_dedup.repeat_digests(table(spark, folder, "documents"))
