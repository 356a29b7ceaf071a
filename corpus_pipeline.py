"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it and reads it back before the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochwright.llm import exact_dedup, mixing, near_copies, packing, toxicity
from epochwright.llm.common import crc_of, table
from epochwright.session import materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not score as toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_of() % 5 != 0)
    return toxicity.drop_toxic(docs, model)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 0.8 or more of their five-word shingles in common."""
    return near_copies.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule interleaves their sources."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences, numbered in the order of the mix."""
    return packing.pack_documents(docs, mixing.order_of(docs))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("simhash_neardup", near_dedup_filter),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: Trained scores, SimHash and patterns from a linear program have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
