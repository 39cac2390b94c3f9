"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, exact, fingerprint, lines, minhash, mixing, substring, suffix, toxicity, warc
from veldspar.runtime import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, the lexicon learned from ``labels``."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, weight, sampling probability and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.with_probability(docs).select("doc_id", "topic", "tokens", F.round("p", 6).alias("p"), "sampled")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by which each document differs from the version before it."""
    return fingerprint.version_differences(table(spark, sf_dir, "documents"))


def op5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by which the documents of each pair of near copies differ."""
    return fingerprint.version_pairs(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return lines.drop_boilerplate(table(spark, sf_dir, "documents"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, found by its URL in the capture index and read from its range."""
    return warc.captures(table(spark, sf_dir, "pages"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of all documents that repeated passages cover, by the transform of their suffixes."""
    return suffix.suffix_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    """Queries by name."""
    named = (
        op1_bpe, op2_toxicity, op3_mixing, op4_substring, op5_fingerprint, op5_versions, op6_lines, op7_exact, op8_minhash,
        op9_warc, op10_suffix,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "op3_mixing": mixing.MIXING_SQL,
        "op5_fingerprint": fingerprint.FINGERPRINT_SQL,
        "op6_lines": lines.LINES_SQL,
        "op7_exact": exact.EXACT_SQL,
        "op9_warc": warc.WARC_SQL,
    }
