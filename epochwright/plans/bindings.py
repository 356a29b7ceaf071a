"""The driver's tables seen as recordings, annotations, epochs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import quotient
from epochwright.functions.spectral import feature_struct
from epochwright.operators.indexing import row_index
from epochwright.plans import derived
from epochwright.session import scratch_path, sized
from epochwright.settings import DatasetSettings, Settings

USER = ["user_id"]

# 30 s epochs at 100 Hz, two epochs of wake kept on each side
EVENT_DATASET = DatasetSettings(wake_pad_min=1)
# 64-sample epochs at 100 Hz
VECTOR_SETTINGS = Settings()
# files of 64-sample records cut into 1 s epochs of 100 samples, which cross records
FILE_SETTINGS = Settings(dataset=DatasetSettings(epoch_sec=1, wake_pad_min=2 / 60))

EVENT_TEXT = {
    "click": "Sleep stage W",
    "view": "Sleep stage 1",
    "purchase": "Sleep stage 2",
    "signup": "Sleep stage R",
    "error": "Sleep stage ?",
}
RECORDS_PER_FILE = 50
ANNOTATIONS_PER_FILE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type == k, v) for k, v in EVENT_TEXT.items()])


def described_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the annotation text of their type."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", _text(F.col("event_type")).alias("description"), "value"
    )


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered from 0 within their user, in time order."""
    events = table(spark, sf_dir, "events")
    chosen = events.select("user_id", "ts", "event_id", "event_type", "value")
    return row_index(chosen, USER, ["ts", "event_id"], "pos")


def annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One recording per user: ``(annotations, recordings)``.

    The n-th event starts at 30 n seconds and lasts ``value`` seconds; the
    recording is as long as its number of events in epochs, its label grid
    eight epochs longer.
    """
    events = indexed_events(spark, sf_dir)
    rows = events.select(
        "user_id",
        (F.col("pos") + 1).alias("ann_idx"),
        (30.0 * (F.col("pos") + 1)).alias("onset"),
        F.col("value").alias("duration"),
        _text(F.col("event_type")).alias("description"),
    )
    length = F.count(F.lit(1))
    recordings = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (length * 3000).alias("n_samples"), (length + 8).alias("n_epochs")
    )
    return rows, sized(recordings, "recordings")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled epochs of 20 subjects with two nights each."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("SC"), F.lpad((vec % 20).cast("string"), 2, "0")).alias("subject_id"),
        (1 + quotient(vec, 20) % 2).cast("int").alias("night"),
        quotient(vec, 40).cast("int").alias("epoch_idx"),
        (F.col("label") % 5).alias("stage"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


def long_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embeddings in a row as one epoch, so a spectrum has segments; the last may be shorter."""
    rows = table(spark, sf_dir, "embeddings").select(
        quotient(F.col("vec_id"), 8).alias("epoch"),
        (F.col("vec_id") % 8).alias("part"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )
    parts = F.array_sort(F.collect_list(F.struct("part", "signal")))
    whole = rows.groupBy("epoch").agg(parts.alias("_p"))
    return whole.select("epoch", F.flatten("_p.signal").alias("signal"))


def vector_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same epochs in the layout of the epoch store, with their features."""
    rows = vectors(spark, sf_dir).withColumn("_f", feature_struct(F.col("signal"), VECTOR_SETTINGS))
    return rows.select(
        *S.REC,
        "epoch_idx",
        "stage",
        F.col("signal").cast("array<float>").alias("signal"),
        *[F.col(f"_f.{name}").cast("float").alias(name) for name in S.FEATURES],
    )


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (true, predicted) stages; a third of the predictions is arbitrary."""
    key = F.col("o_orderkey")
    true = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.lit(1).alias("night"),
        "o_orderdate",
        "o_orderkey",
        true.alias("stage"),
        F.when(key % 3 == 0, (key % 5).cast("int")).otherwise(true).alias("pred"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled orders with ``epoch_idx``, their place in the customer's history."""
    numbered = row_index(
        labelled_orders(spark, sf_dir), ["subject_id", "night"], ["o_orderdate", "o_orderkey"]
    )
    return numbered.select(
        *S.REC, F.col("idx").cast("int").alias("epoch_idx"), "stage", "pred"
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing ``name, pos``: signal names with replacements, annotation names for some keys."""
    cust = F.col("c_custkey")
    key = F.concat(
        F.lit("SC4"),
        F.lpad((cust % 100).cast("string"), 2, "0"),
        (1 + quotient(cust, 100) % 2).cast("string"),
    )
    rows = table(spark, sf_dir, "customer").select(cust.alias("pos"), key.alias("key"))
    signal = rows.select(
        F.concat("key", F.lit("E"), (F.col("pos") % 7).cast("string"), F.lit(S.SIGNAL_SUFFIX)).alias(
            "name"
        ),
        "pos",
    )
    annotated = rows.filter(F.col("pos") % 100 < 80).select(
        F.concat("key", F.lit("EC" + S.ANNOTATION_SUFFIX)).alias("name"), "pos"
    )
    return signal.unionByName(annotated)


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as data records of files: ``file_no, file, record, stage, signal``."""
    file_no = quotient(F.col("vec_id"), RECORDS_PER_FILE)
    return table(spark, sf_dir, "embeddings").select(
        file_no.alias("file_no"),
        F.concat(F.lit("rec"), file_no.cast("string"), F.lit(S.SIGNAL_SUFFIX)).alias("file"),
        (F.col("vec_id") % RECORDS_PER_FILE).cast("int").alias("record"),
        (F.col("label") % 5).alias("stage"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


def signal_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the embeddings as signal files; returns their folder."""
    folder = scratch_path(spark, "signals")
    written = derived.write_signal_files(
        vector_records(spark, sf_dir), folder, FILE_SETTINGS.dataset.channel, 100.0
    )
    written.write.format("noop").mode("overwrite").save()
    return folder


def stage_text(stage: Column) -> Column:
    """The annotation text of a stage id."""
    texts = ["Sleep stage W", "Sleep stage 1", "Sleep stage 2", "Sleep stage 3", "Sleep stage R"]
    return F.element_at(F.array(*[F.lit(t) for t in texts]), stage + 1)


def recording_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Signal files plus an annotation file each, one 1 s annotation per record; with a manifest."""
    folder = signal_files(spark, sf_dir)
    notes = vector_records(spark, sf_dir).select(
        F.concat(F.lit("rec"), F.col("file_no").cast("string"), F.lit(S.ANNOTATION_SUFFIX)).alias(
            "file"
        ),
        "record",
        F.col("record").cast("double").alias("onset"),
        F.lit(1.0).alias("duration"),
        stage_text(F.col("stage")).alias("description"),
    )
    written = derived.write_annotation_files(notes, folder)
    written.write.format("noop").mode("overwrite").save()
    number = F.col("file_no").cast("string")
    manifest = (
        vector_records(spark, sf_dir)
        .select("file_no")
        .distinct()
        .select(
            F.concat(F.lit("SC"), number).alias("subject_id"),
            F.lit(1).alias("night"),
            F.concat(F.lit(f"{folder}/rec"), number, F.lit(S.SIGNAL_SUFFIX)).alias("psg_path"),
            F.concat(F.lit(f"{folder}/rec"), number, F.lit(S.ANNOTATION_SUFFIX)).alias(
                "hypnogram_path"
            ),
        )
    )
    return folder, manifest


def event_annotation_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as annotation files of 100 annotations each; returns their folder."""
    folder = scratch_path(spark, "annotations")
    within = F.col("event_id") % ANNOTATIONS_PER_FILE
    number = quotient(F.col("event_id"), ANNOTATIONS_PER_FILE).cast("string")
    rows = described_events(spark, sf_dir).select(
        F.concat(F.lit("rec"), number, F.lit(S.ANNOTATION_SUFFIX)).alias("file"),
        within.cast("int").alias("record"),
        (30.0 * within).alias("onset"),
        F.col("value").alias("duration"),
        "description",
    )
    derived.write_annotation_files(rows, folder).write.format("noop").mode("overwrite").save()
    return folder


def file_number(path: Column) -> Column:
    """The number in a derived file's name."""
    return F.regexp_extract(path, r"rec(\d+)-", 1).cast("long")
