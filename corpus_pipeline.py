"""From raw documents to token ids: five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, lines, near, pieces
from tidemark.llm.frames import read_table, stored
from tidemark.session import bound_batches

#: A public tokenizer's model file, read on the driver; never copied into the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: A document is rejected below this probability of its language; junk in a known alphabet stays for the later stages.
LEAST = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the network is learned from the labelled documents of this input."""
    bound_batches(spark)
    return language.accept(docs, language.fit(docs), LEAST)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose template recurs; the first document with a template keeps its lines, so nothing is lost
    altogether, and near copies count as one document, so that the next stage finds them whole. Null texts stay null."""
    return lines.dedup_lines(docs, keep_first=True, near_copies_once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more."""
    bound_batches(spark)
    return near.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their texts."""
    bound_batches(spark)
    return pieces.encode(docs, pieces.shared_coder(docs.select("text"), pieces.load(MODEL)))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokenisation", tokenisation)]

#: Learned weights, fingerprints and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
