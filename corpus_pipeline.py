"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing; each stage works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagmill.written import cut
from tagmill.llm.minhash import drop_near_duplicates
from tagmill.llm.packing import pack
from tagmill.llm.quality_rules import keep_quality
from tagmill.llm.toxicity import drop_toxic
from tagmill.sources import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return keep_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from the labelled ones among ``docs``."""
    return drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return drop_near_duplicates(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Compression, learning and minhash signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; all but the last are written and read back.

    Rows with null or empty texts go in the first stage; rows without an id are judged, kept and packed under null; texts of
    any length pass whole; equal rows of one id stay or go together; columns besides doc_id and text are carried along up
    to the packing, whatever their names; empty tables give an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
