"""Reading the files the steps exchange (SRC5-SRC11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.operators.checks import read_or_explain


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: declared schema, so ``night`` is an integer and ids stay text."""
    return read_or_explain(
        spark.read.schema(S.MANIFEST_SCHEMA).option("header", True).csv,
        path,
        "manifest",
        "discover",
    )


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """SRC6-SRC8: the epoch store. The declared schema keeps ids such as "00" text."""
    stored = read_or_explain(
        spark.read.schema(S.EPOCH_SCHEMA).parquet, path, "epoch store", "build_epochs"
    )
    return stored.select(*S.EPOCH_SCHEMA.names)


def read_split_document(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: the split document, a row per shard of ids."""
    return read_or_explain(
        spark.read.schema(S.SPLIT_DOC_SCHEMA).json,
        path,
        "splits",
        "make_split",
    )


def splits_of_document(document: DataFrame) -> DataFrame:
    """SRC9: the document as ``(subject_id, split)`` rows."""
    return document.select(F.explode("ids").alias("subject_id"), "split")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``(subject_id, split)`` from the table form of the splits."""
    return read_or_explain(
        spark.read.schema("subject_id string, split string").parquet,
        path,
        "splits",
        "make_split",
    )


def read_sample(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC10: a packaged night, ``(epochs, metadata)``; ``stage`` may be NULL."""
    epochs = read_or_explain(spark.read.parquet, f"{path}/epochs", "sample", "write_sample")
    meta = read_or_explain(spark.read.json, f"{path}/meta", "sample metadata", "write_sample")
    return epochs, meta


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC11: ``path, name, length`` of files on storage; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("name"), "length"
    )
