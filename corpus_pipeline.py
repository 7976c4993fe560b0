"""The training-data pipeline: language ID, line dedup, near dedup, mixing and packing over documents.

Every stage is written as Parquet in the shared folder and read again by the next one.

All stages but the last return the columns that they get, whatever their names: columns that an operator adds for itself give way or are kept apart. Repeated rows (but in near_dedup) and ids
that stand twice are rows of their own, null ids stay null, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language, line_dedup, mixing, near_dedup, packing
from lodestone.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a tellable language go: those whose text is null, empty or without letters. Labels are learned from where they aren't null."""
    return language.keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and with them documents that have nothing else. The first copy is that of the smallest id, null before all; a null or empty text stays as it is."""
    return line_dedup.drop_copied_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, equal rows included, that of the smallest id (null before all); texts too short for a shingle of five words are copies of equal words only."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most; a null source is a source of its own, a text without words keeps one copy."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language filters, weighted draws and packing have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
