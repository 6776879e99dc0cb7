"""One query per operator, over whole tables with production parameters, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemark.llm import audit, decontaminate, fingerprints, fmindex, language, lines, pieces, quality, repair, repeats, repetition, secrets, simhash
from tidemark.llm.frames import fold_of, read_table
from tidemark.llm.oracles import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.fingerprints(read_table(spark, root, "documents"))


def op2_line_templates(spark: SparkSession, root: str) -> DataFrame:
    """Lines dropped from every document because their template recurs."""
    return lines.line_report(read_table(spark, root, "documents"))


def op3_spaced_seed_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps of documents with the benchmark that allow for substitutions."""
    return decontaminate.overlaps(read_table(spark, root, "documents"), read_table(spark, root, "benchmark")).drop("row")


def op4_language_id(spark: SparkSession, root: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read_table(spark, root, "documents")
    got = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return got.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_simhash_gray_index(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(read_table(spark, root, "documents"))


def op6_fm_index_substrings(spark: SparkSession, root: str) -> DataFrame:
    """Words removed from every document as parts of earlier 50-word windows."""
    return fmindex.dedup_substrings(read_table(spark, root, "documents"))


def op7_sentencepiece_lattice(spark: SparkSession, root: str) -> DataFrame:
    """Piece ids of every document and the digest of their decoding."""
    docs = read_table(spark, root, "documents").select("doc_id", "text")
    coder = pieces.shared_coder(docs.select("text"), pieces.load(corpus_pipeline.MODEL))
    got = pieces.encode(docs, coder, check="decoded_sha256")
    return got.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


def op8_quality_subwords(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, root, "documents")
    got = quality.score(docs.select("doc_id", "text"), quality.fit(docs, read_table(spark, root, "labels")))
    return got.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_maximal_repeats(spark: SparkSession, root: str) -> DataFrame:
    """Bytes removed from every document as parts of repeated strings."""
    return repeats.dedup_bytes(read_table(spark, root, "documents"))


def op10_multipart_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Secret spans of every document, linked parts included."""
    return secrets.scan(read_table(spark, root, "documents"))


def op11_repetition_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Counts of repeated words, characters and lines of every document, and whether it is kept."""
    return repetition.repetition(read_table(spark, root, "documents"))


def op12_filter_interactions(spark: SparkSession, root: str) -> DataFrame:
    """Every order of the five filters, step by step, for each source."""
    return audit.interactions(read_table(spark, root, "documents"), read_table(spark, root, "labels"))


def op13_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    """The cheapest edits that mend every conversation after the planted damage."""
    return repair.audit(read_table(spark, root, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_line_templates, op3_spaced_seed_decontamination, op4_language_id, op5_simhash_gray_index,
        op6_fm_index_substrings, op7_sentencepiece_lattice, op8_quality_subwords, op9_maximal_repeats, op10_multipart_secrets,
        op11_repetition_coverage, op12_filter_interactions, op13_conversation_repair,
    )
} | {"pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
