"""What several text operators share: reading tables, bounded Arrow batches, dropping rows by decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright.session import materialize

BATCH_ROWS = 256
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of(name: str = "doc_id") -> Column:
    """CRC-32 of the decimal text of an id, which splits rows into folds."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


@contextmanager
def _batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def map_once(df: DataFrame, batches: Callable, schema: str, label: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` in batches of few rows, written once to the shared folder.

    Texts may be long, so a batch holds ``rows`` rows instead of the session's
    default of ten thousand. The result is read several times by most callers,
    and reading it back costs no second pass over the texts.
    """
    spark = df.sparkSession
    with _batch_rows(spark, rows):
        return materialize(df.mapInArrow(batches, schema), label)


def row_key() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(text_or_empty())


def drop_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decisions`` (doc_id, row_key, kept) reject; all columns stay.

    Every row has one decision; equal rows (same doc_id and text) share their
    key, and one of them stays if any of their decisions is positive. The
    rejected keys are joined as an anti join, so the planner may broadcast them
    if their size, known from the written table, allows.
    """
    names = docs.columns
    keys = decisions.groupBy("doc_id", "row_key").agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")
    )
    keys = materialize(keys.filter(~F.col("_kept") | (F.col("_rows") > 1)), "row-decisions").select(
        F.coalesce("doc_id", F.lit(0)).alias("_d"),
        F.col("doc_id").isNull().alias("_n"),
        F.col("row_key").alias("_k"),
        "_kept",
    )
    keyed = docs.select(
        F.struct(*names).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_d"),
        F.col("doc_id").isNull().alias("_n"),
        row_key().alias("_k"),
    )
    on = ["_d", "_n", "_k"]
    rest = keyed.join(keys, on, "left_anti").select("_row.*")
    if keys.filter("_kept").isEmpty():
        return rest
    again = keyed.join(keys.filter("_kept"), on, "left_semi").dropDuplicates(on)
    return rest.unionByName(again.select("_row.*"))
