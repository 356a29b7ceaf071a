"""Writing the files the steps exchange (SNK1-SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import quotient
from epochwright.operators.agreement import metrics_document
from epochwright.operators.checks import require_rows
from epochwright.operators.cohort import warn_if_not_test
from epochwright.operators.indexing import number_rows
from epochwright.settings import DatasetSettings


def manifest_rows(recordings: DataFrame, raw_dir: str) -> DataFrame:
    """SNK1 rows: recordings with full paths."""
    base = raw_dir.rstrip("/") + "/"
    return recordings.select(
        "subject_id",
        "night",
        F.concat(F.lit(base), "psg_name").alias("psg_path"),
        F.concat(F.lit(base), "hypnogram_name").alias("hypnogram_path"),
    )


def write_manifest(recordings: DataFrame, raw_dir: str, path: str) -> None:
    """SNK1 + SRT1: CSV with header, sorted by subject and night."""
    rows = manifest_rows(recordings, raw_dir).orderBy("subject_id", "night")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_epochs(epochs: DataFrame, path: str, only_these: bool = False) -> None:
    """SNK2: the epoch store, one folder per subject, replaced as a whole.

    With ``only_these``, the folders of other subjects than those in ``epochs`` stay.

    REBALANCE gathers a subject's rows to avoid small files, and lets Spark
    split a subject that is too big for one task, which a plain repartition by
    subject would not. Sorting by night and epoch makes row groups skippable.
    """
    (
        epochs.select(*S.EPOCH_SCHEMA.names)
        .hint("rebalance", "subject_id")
        .sortWithinPartitions("subject_id", "night", "epoch_idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_these else "static")
        .partitionBy("subject_id")
        .parquet(path)
    )


def write_splits(splits: DataFrame, path: str) -> None:
    """The splits as a table; scales with the number of subjects."""
    splits.select("subject_id", "split").write.mode("overwrite").parquet(path)


def split_document(splits: DataFrame, seed: int, val_frac: float, test_frac: float) -> DataFrame:
    """SNK3 + SRT5: rows with the seed, the fractions and a sorted shard of a split's ids.

    A split's shards, in their order, are its sorted list of ids. The steps
    themselves read the table form (:func:`write_splits`).
    """
    return id_shards(splits, ["split"]).select(
        F.lit(seed).cast("long").alias("seed"),
        F.lit(float(val_frac)).alias("val_frac"),
        F.lit(float(test_frac)).alias("test_frac"),
        "split",
        "shard",
        "n_ids",
        "ids",
    )


def id_shards(subjects: DataFrame, keys: list[str], per_shard: int = S.IDS_PER_SHARD) -> DataFrame:
    """Sorted lists of at most ``per_shard`` distinct ids: ``keys``, ``shard``, ``n_ids``, ``ids``."""
    ids = subjects.select(*keys, "subject_id").distinct()
    placed = number_rows(ids, keys, ["subject_id"], out="_at")
    return (
        placed.groupBy(*keys, quotient(F.col("_at"), per_shard).cast("long").alias("shard"))
        .agg(F.array_sort(F.collect_list("subject_id")).alias("ids"))
        .withColumn("n_ids", F.size("ids").cast("long"))
    )


def write_document(document: DataFrame, path: str) -> None:
    """SNK3 / SNK4: rows as JSON text."""
    document.write.mode("overwrite").json(path)


def metrics_report(counted: DataFrame, subjects: DataFrame, model: str) -> DataFrame:
    """SNK4: the metrics document with model name and number of test subjects; :func:`test_subjects` lists them."""
    tag = F.lit(model).alias("model")
    number = subjects.agg(F.count_distinct("subject_id").alias("n_test_subjects")).select(tag, "n_test_subjects")
    return metrics_document(counted).select("*", tag).join(number, "model")


def test_subjects(subjects: DataFrame, model: str) -> DataFrame:
    """SNK4: the sorted test subjects of a metrics document, in shards."""
    return id_shards(subjects.withColumn("model", F.lit(model)), ["model"])


def write_export(rows: DataFrame, path: str) -> None:
    """SNK5: per-epoch CSV, one folder per recording."""
    (
        rows.hint("rebalance", *S.REC)
        .sortWithinPartitions(*S.REC, "epoch_idx")
        .write.mode("overwrite")
        .partitionBy(*S.REC)
        .option("header", True)
        .csv(path)
    )


def write_sample(
    epochs: DataFrame,
    splits: DataFrame,
    subject_id: str,
    night: int,
    dataset: DatasetSettings,
    path: str,
) -> bool:
    """SNK6 + FLT9 + SRT3: one night and its metadata; True when the subject is held out for test.

    The caller warns on False: a demo night the model was trained on says little.
    """
    chosen = epochs.filter((F.col("subject_id") == subject_id) & (F.col("night") == night))
    require_rows(chosen, f"no epochs for subject {subject_id} night {night}")
    (
        chosen.select(*S.REC, "epoch_idx", "stage", "signal")
        .orderBy("epoch_idx")
        .write.mode("overwrite")
        .parquet(f"{path}/epochs")
    )
    counted = chosen.groupBy(*S.REC).agg(F.count(F.lit(1)).alias("n_epochs"))
    meta = (
        counted.join(warn_if_not_test(chosen, splits), S.REC)
        .withColumn("epoch_samples", F.lit(dataset.epoch_samples))
        .withColumn("sample_rate", F.lit(dataset.sample_rate))
        .withColumn("epoch_sec", F.lit(dataset.epoch_sec))
        .withColumn("channel", F.lit(dataset.channel))
    )
    meta.write.mode("overwrite").json(f"{path}/meta")
    return meta.filter("not_test").isEmpty()
