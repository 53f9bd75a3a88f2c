"""Corpus pipeline: language ID, exact de-duplication, near de-duplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from matchloom.llm._common import materialise
from matchloom.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones, too) and texts whose language is unclear go.

    Each row is decided by its own text, so repeats stay or go together.
    """
    return language_id.in_known_language(docs, vocabulary("piece_bpe_32k.model"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays, then the one with the smallest id; repeated rows stay once."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the smallest id stays; blank texts and rows without an id stay."""
    return near_dedup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it; documents not drawn go.

    A null source is a source of its own; texts without words are dealt like any others.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; a blank text is the end id alone, repeats are packed as often."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", known_language), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("packing", packed)]

#: A tokenizer and a trained model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what lies between them is written to the shared folder and goes with the application."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
