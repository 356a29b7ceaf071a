"""Queries over the driver's tables, one or more per operator. Floats are rounded to 6 places."""

from __future__ import annotations

from dataclasses import replace
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions import arrays, labels
from epochwright.functions.spectral import feature_struct
from epochwright.models.raw_signal import RawModel, train_raw
from epochwright.models.scoring import score_with
from epochwright.models.trees import TreeModel, portable_score, train_trees
from epochwright.operators import agreement as agree
from epochwright.operators import blocks, checks, cohort, discovery, nights, planning
from epochwright.plans import bindings as B
from epochwright.plans import derived, flows
from epochwright.session import materialize, scratch_path, sized
from epochwright.settings import RawModelSettings, TreeSettings
from epochwright.sinks import tables as sinks
from epochwright.sources import tables as sources
from epochwright.sources.edf import file_rejects, read_edf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EPOCH = [*S.REC, "epoch_idx"]
HREF = r'href="([^"]*)"'
SEED, VAL, TEST = 42, 0.15, 0.15


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    rounded = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return rounded.alias(name or column)


# --- discovery ---------------------------------------------------------------


@query("q_listing_names")
def listing_names(spark, sf):
    """SRC1, SET1: link targets of all pages, with first occurrence."""
    return discovery.listed_names(B.table(spark, sf, "pages"), "page_id", "html", HREF, 1)


@query("q_parse_stem")
def parse_stem(spark, sf):
    """FLT1, FN11."""
    stem = F.substring("name", 1, 8)
    subject, night = labels.parse_stem(stem)
    names = B.file_names(spark, sf)
    return names.select(
        "name",
        "pos",
        labels.recording_key(F.col("name")).alias("key"),
        subject.alias("subject_id"),
        night.alias("night"),
    )


@query("q_pair")
def pair(spark, sf):
    """J1, SRT1."""
    return discovery.pair_recordings(B.file_names(spark, sf)).orderBy("subject_id", "night")


@query("q_unpaired")
def unpaired(spark, sf):
    """J11."""
    return discovery.unpaired_names(B.file_names(spark, sf))


@query("q_limit")
def limit(spark, sf):
    """WIN6: recordings of the first ten subjects."""
    return cohort.first_subjects(discovery.pair_recordings(B.file_names(spark, sf)), 10)


@query("q_manifest")
def manifest(spark, sf):
    """SNK1, SRC5: written as CSV and read back."""
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(discovery.pair_recordings(B.file_names(spark, sf)), "/raw", path)
    return sources.read_manifest(spark, path)


@query("q_missing_files")
def missing_files(spark, sf):
    """SRC11, J11: one file wanted per 100 events, one there per 50 embeddings."""
    number = arrays.quotient(F.col("event_id"), 100).cast("string")
    wanted = (
        B.table(spark, sf, "events")
        .select(F.concat(F.lit("rec"), number, F.lit(S.SIGNAL_SUFFIX)).alias("name"))
        .distinct()
    )
    present = sources.list_files(spark, B.signal_files(spark, sf), "*.edf")
    return discovery.missing_files(wanted, present)


@query("q_oversized_files")
def oversized_files(spark, sf):
    """FLT12 on derived files of at most 10,368 bytes."""
    present = sources.list_files(spark, B.signal_files(spark, sf), "*.edf")
    big = discovery.oversized_files(present, 10_000)
    return big.select("name", "length")


# --- annotations and plans ----------------------------------------------------


@query("q_map_annotation")
def map_annotation(spark, sf):
    """FLT2, FLT3."""
    return planning.map_stages(B.described_events(spark, sf)).select(
        "event_id", "description", "stage"
    )


@query("q_plan")
def plan(spark, sf):
    """WIN1, WIN2, FLT4."""
    notes, recordings = B.annotations(spark, sf)
    runs = planning.plan_runs(notes, recordings, B.EVENT_DATASET, B.USER)
    return planning.expand_runs(runs, B.EVENT_DATASET, B.USER)


@query("q_trim")
def trim(spark, sf):
    """WIN3, WIN4, FLT5."""
    notes, recordings = B.annotations(spark, sf)
    return planning.plan_epochs(notes, recordings, B.EVENT_DATASET, B.USER)


@query("q_stage_counts")
def stage_counts(spark, sf):
    """AGG2 over the trimmed plan of every recording."""
    notes, recordings = B.annotations(spark, sf)
    plan = planning.plan_epochs(notes, recordings, B.EVENT_DATASET, B.USER)
    return nights.stage_counts(plan, B.USER).select("user_id", "stage", "name", "n", r6("pct"))


@query("q_expert_grid")
def expert_grid(spark, sf):
    """J5."""
    notes, recordings = B.annotations(spark, sf)
    return planning.expert_grid(notes, recordings, B.EVENT_DATASET, B.USER)


@query("q_expert_predictions")
def expert_predictions(spark, sf):
    """J6: a rule's predictions on the grid joined with the expert labels."""
    notes, recordings = B.annotations(spark, sf)
    grid = planning.expert_grid(notes, recordings, B.EVENT_DATASET, B.USER)
    pred = ((F.col("epoch_idx") * 7 + F.col("user_id")) % 5).cast("int")
    length = recordings.withColumn("n_samples", F.col("n_epochs") * 3000)
    predicted = blocks.grid_plan(length, 3000, B.USER).select(
        "user_id", "epoch_idx", pred.alias("pred")
    )
    return planning.with_expert(predicted, grid, [*B.USER, "epoch_idx"])


@query("q_too_short")
def too_short(spark, sf):
    """FLT15: users with fewer than 64 events, taken as samples."""
    stats = blocks.sample_stats(B.table(spark, sf, "events"), "value", B.USER)
    return checks.too_short(stats, 64, B.USER)


@query("q_scored_metrics")
def scored_metrics(spark, sf):
    """FLT10, AGG15: a rule's predictions against the expert grid, per recording."""
    notes, recordings = B.annotations(spark, sf)
    grid = planning.expert_grid(notes, recordings, B.EVENT_DATASET, B.USER)
    pred = ((F.col("epoch_idx") * 7 + F.col("user_id")) % 5).cast("int")
    scored = agree.scored_only(grid.withColumn("pred", pred), "expert")
    counted = agree.agreement(scored, "expert", "pred", B.USER)
    return agree.headline(counted, B.USER).select(
        "user_id",
        F.col("n_epochs").alias("n_scored_epochs"),
        r6("accuracy"),
        r6("macro_f1"),
        r6("cohen_kappa"),
    )


# --- normalization and slicing ---------------------------------------------------


@query("q_zscore_stats")
def zscore_stats(spark, sf):
    """AGG1."""
    stats = blocks.sample_stats(B.table(spark, sf, "events"), "value", B.USER)
    return stats.select("user_id", "n_samples", r6("mean"), r6("std"))


@query("q_zscore")
def zscore(spark, sf):
    """J2, FN1 per sample."""
    events = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    return blocks.normalize_samples(events, "value", B.USER).select("event_id", r6("z"))


@query("q_zscore_blocks")
def zscore_blocks(spark, sf):
    """AGG1 and FN1 on blocks: each epoch against its night's statistics."""
    epochs = B.vectors(spark, sf).withColumnRenamed("signal", "samples")
    stats = sized(blocks.block_stats(epochs), "stats")
    z = arrays.zscore_array(F.col("samples"), F.col("mean"), F.col("std"))
    return epochs.join(stats, S.REC).select(
        *EPOCH, F.transform(z, lambda x: F.round(x, 6)).alias("z")
    )


@query("q_cut_epochs")
def cut_epochs(spark, sf):
    """WIN5: 8-sample epochs of each user's values."""
    cut = blocks.cut_epochs(B.indexed_events(spark, sf), "pos", "value", 8, B.USER)
    return cut.select("user_id", "epoch_idx", "signal")


@query("q_slice_blocks")
def slice_blocks(spark, sf):
    """J3, FN2, FLT6: 8-sample epochs out of 5-sample blocks."""
    cut = blocks.to_blocks(B.indexed_events(spark, sf), "pos", "value", 5, B.USER)
    recordings = blocks.sample_stats(B.table(spark, sf, "events"), "value", B.USER)
    plan = blocks.grid_plan(recordings, 8, B.USER).select(
        "user_id",
        F.col("epoch_idx").alias("plan_idx"),
        "start_sample",
        F.lit(5).cast("long").alias("block_len"),
    )
    return blocks.slice_blocks(cut, plan, 8, B.USER).select("user_id", "plan_idx", "samples")


# --- features ------------------------------------------------------------------


def _features(spark, sf) -> DataFrame:
    rows = B.vectors(spark, sf).drop("stage")
    features = feature_struct(F.col("signal"), B.VECTOR_SETTINGS)
    return rows.select(*EPOCH, features.alias("_f")).select(*EPOCH, "_f.*")


@query("q_band_powers")
def band_powers(spark, sf):
    """FN4, FN5."""
    return _features(spark, sf).select(*EPOCH, *[r6(f"feat_bp_{b}") for b in S.BAND_NAMES])


@query("q_entropy")
def entropy(spark, sf):
    """FN6."""
    return _features(spark, sf).select(*EPOCH, r6("feat_spec_entropy"))


@query("q_hjorth")
def hjorth(spark, sf):
    """FN7, WIN9."""
    names = [f for f in S.FEATURES if "hjorth" in f]
    return _features(spark, sf).select(*EPOCH, *[r6(n) for n in names])


@query("q_rms")
def rms(spark, sf):
    """FN8."""
    return _features(spark, sf).select(*EPOCH, r6("feat_rms"))


@query("q_welch_segments")
def welch_segments(spark, sf):
    """FN4-FN6, WIN10: epochs of 512 samples, three overlapping segments each."""
    features = feature_struct(F.col("signal"), B.VECTOR_SETTINGS)
    rows = B.long_epochs(spark, sf).select("epoch", features.alias("_f")).select("epoch", "_f.*")
    bands = [r6(f"feat_bp_{b}") for b in S.BAND_NAMES]
    return rows.select("epoch", *bands, r6("feat_spec_entropy"))


# --- cohort ----------------------------------------------------------------------


def _stages(spark, sf) -> DataFrame:
    return cohort.subject_stages(B.vectors(spark, sf))


def _splits(spark, sf) -> DataFrame:
    return cohort.assign_splits(_stages(spark, sf), SEED, VAL, TEST)


@query("q_subject_stages")
def subject_stages(spark, sf):
    """AGG4, SRC7."""
    return _stages(spark, sf)


@query("q_subject_overview")
def subject_overview(spark, sf):
    """AGG3, AGG5."""
    return cohort.subject_overview(B.vectors(spark, sf))


@query("q_split")
def split(spark, sf):
    """WIN7, WIN8."""
    return _splits(spark, sf)


@query("q_split_sizes")
def split_sizes(spark, sf):
    """WIN8."""
    return cohort.split_counts(_splits(spark, sf))


@query("q_coverage")
def coverage(spark, sf):
    """SET2, SET3."""
    return cohort.stage_coverage(_splits(spark, sf), _stages(spark, sf))


@query("q_disjoint")
def disjoint(spark, sf):
    """SET4, SET5: violations of either rule, none expected."""
    splits, stages = materialize(_splits(spark, sf), "splits"), _stages(spark, sf)
    return (
        cohort.overlapping_subjects(splits)
        .select("subject_id", F.lit("overlap").alias("problem"))
        .unionByName(
            cohort.incomplete_subjects(splits, stages).select(
                "subject_id", F.lit("incomplete").alias("problem")
            )
        )
        .agg(
            F.count_if(F.col("problem") == "overlap").alias("n_overlapping"),
            F.count_if(F.col("problem") == "incomplete").alias("n_incomplete"),
        )
    )


@query("q_split_document")
def split_document(spark, sf):
    """SNK3, SRC9, SRT5: written as a document and read back."""
    path = scratch_path(spark, "splits-document")
    sinks.write_document(sinks.split_document(_splits(spark, sf), SEED, VAL, TEST), path)
    document = sources.read_split_document(spark, path)
    return document.select(*S.SPLIT_DOC_SCHEMA.names)


@query("q_split_table")
def split_table(spark, sf):
    """SRC9: the document as rows."""
    document = sinks.split_document(_splits(spark, sf), SEED, VAL, TEST)
    return sources.splits_of_document(document)


@query("q_split_epochs")
def split_epochs(spark, sf):
    """J4, FLT8."""
    return cohort.split_epochs(B.vectors(spark, sf), _splits(spark, sf), "test").select(
        *EPOCH, "stage"
    )


@query("q_class_weights")
def class_weights(spark, sf):
    """AGG6."""
    weights = cohort.class_weights(B.vectors(spark, sf))
    return weights.select("stage", "n", r6("weight"), r6("relative"))


@query("q_row_weights")
def row_weights(spark, sf):
    """J7."""
    rows = B.vectors(spark, sf).select(*EPOCH, "stage")
    return cohort.weigh_rows(rows, cohort.class_weights(rows)).select(*EPOCH, "stage", r6("weight"))


@query("q_resample")
def resample(spark, sf):
    """ML2: class balance by hashed choice."""
    rows = B.vectors(spark, sf).select(*EPOCH, "stage")
    key = F.concat_ws(":", *EPOCH)
    return cohort.resample_by_weight(rows, cohort.class_weights(rows), key, SEED)


@query("q_training_order")
def training_order(spark, sf):
    """ML8."""
    rows = B.vectors(spark, sf).select(*EPOCH)
    return cohort.seeded_order(rows, SEED, F.concat_ws(":", *EPOCH))


@query("q_split_warning")
def split_warning(spark, sf):
    """J10."""
    return cohort.warn_if_not_test(B.vectors(spark, sf), _splits(spark, sf))


# --- agreement --------------------------------------------------------------------


def _counted(spark, sf, by: list[str] = []) -> DataFrame:
    return agree.agreement(B.labelled_orders(spark, sf), "stage", "pred", by)


@query("q_confusion")
def confusion(spark, sf):
    """AGG7, J9."""
    return agree.confusion(_counted(spark, sf)).select("true", "pred", "n")


@query("q_confusion_norm")
def confusion_norm(spark, sf):
    """AGG12."""
    return agree.confusion(_counted(spark, sf)).select("true", "pred", r6("row_share"))


@query("q_confusion_wide")
def confusion_wide(spark, sf):
    """SNK8."""
    return agree.confusion_wide(_counted(spark, sf))


@query("q_per_class")
def per_class(spark, sf):
    """AGG8."""
    scores = agree.per_class(_counted(spark, sf))
    return scores.select("stage", "name", r6("precision"), r6("recall"), r6("f1"), "support")


@query("q_headline")
def headline(spark, sf):
    """AGG9, AGG10, AGG11, FN16."""
    scores = agree.headline(_counted(spark, sf))
    return scores.select(
        "n_epochs",
        r6("accuracy"),
        r6("macro_f1"),
        r6("cohen_kappa"),
        labels.agreement_band(F.col("cohen_kappa")).alias("band"),
    )


@query("q_subject_metrics")
def subject_metrics(spark, sf):
    """AGG9-AGG11 per customer: many small groups at once."""
    counted = _counted(spark, sf, ["subject_id"])
    return agree.headline(counted, ["subject_id"]).select(
        "subject_id", "n_epochs", r6("accuracy"), r6("macro_f1"), r6("cohen_kappa")
    )


@query("q_metrics_document")
def metrics_doc(spark, sf):
    """AGG17, SNK4: written as a document and read back."""
    orders = B.labelled_orders(spark, sf)
    path = scratch_path(spark, "metrics")
    report = sinks.metrics_report(_counted(spark, sf), orders, "rule")
    sinks.write_document(report, path)
    listed = sinks.test_subjects(orders, "rule")
    sinks.write_document(listed, f"{path}-subjects")
    ids = spark.read.schema(listed.schema).json(f"{path}-subjects").withColumnRenamed("ids", "test_subjects")
    read = spark.read.schema(report.schema).json(path).join(ids, "model")
    return read.select(
        "model",
        "n_epochs",
        r6("accuracy"),
        r6("macro_f1"),
        r6("cohen_kappa"),
        r6(F.col("per_stage.N2.f1"), "n2_f1"),
        F.col("per_stage.REM.support").alias("rem_support"),
        F.flatten("confusion_matrix").alias("cells"),
        F.array_join("class_names", ",").alias("class_names"),
        "n_test_subjects",
        "shard",
        "test_subjects",
    )


def _two_models(spark, sf) -> DataFrame:
    """The orders' predictions and those of a rule that always says N2."""
    orders = B.labelled_orders(spark, sf).select("stage", "pred")
    constant = orders.select("stage", F.lit(S.N2).alias("pred"), F.lit("constant").alias("model"))
    return orders.withColumn("model", F.lit("mixed")).unionByName(constant)


@query("q_compare_models")
def compare_models(spark, sf):
    """AGG19."""
    counted = agree.agreement(_two_models(spark, sf), "stage", "pred", ["model"])
    table = agree.compare_models(counted, ["constant", "mixed"])
    return table.select("metric", r6("constant"), r6("mixed"))


def _chances(spark, sf) -> DataFrame:
    """Embeddings with probabilities: absolute sums of five stretches of up to 13 samples, normalized."""
    parts = F.array(
        *[
            F.aggregate(
                F.slice("signal", 13 * c + 1, 13), F.lit(0.0), lambda acc, x: acc + F.abs(x)
            )
            for c in S.STAGES
        ]
    )
    total = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p)
    return (
        B.vectors(spark, sf)
        .withColumn("_p", parts)
        .withColumn("_t", total)
        .select(*EPOCH, "stage", F.transform("_p", lambda p: p / F.col("_t")).alias("proba"))
        .withColumn("pred", arrays.argmax(F.col("proba")))
    )


def _stretch_predictor():
    """The same rule on a matrix of epochs."""

    def predict(epochs: np.ndarray) -> np.ndarray:
        parts = np.add.reduceat(np.abs(epochs.astype(float)), np.arange(5) * 13, axis=1)
        return parts / parts.sum(axis=1, keepdims=True)

    return predict


def _other_predictor():
    """The rule on epochs that begin below zero; its probabilities turned round on all others."""
    rule = _stretch_predictor()
    return lambda epochs: np.where(epochs[:, :1] > 0, rule(epochs)[:, ::-1], rule(epochs))


@query("q_predictor_score")
def predictor_score(spark, sf):
    """ML4, UDF4, SRT4: a pluggable predictor on Arrow batches."""
    scored = score_with(B.vectors(spark, sf), _stretch_predictor, EPOCH)
    rounded = F.transform("proba", lambda p: F.round(p, 6))
    return scored.select(*EPOCH, "pred", rounded.alias("proba"))


@query("q_scorer_parity")
def scorer_parity(spark, sf):
    """AGG18: the rule in expressions against a predictor that departs from it on some epochs."""
    scored = score_with(B.vectors(spark, sf), _other_predictor, EPOCH)
    gap = agree.scorer_parity(_chances(spark, sf), scored, EPOCH)
    return gap.select("n_epochs", "label_diffs", r6("max_gap"))


@query("q_prob_strip")
def prob_strip(spark, sf):
    """FN14, SRT4."""
    strip = nights.probability_strip(_chances(spark, sf), "proba", EPOCH)
    return strip.select(*EPOCH, "row", "name", r6("p"))


@query("q_expand_probabilities")
def expand_probabilities(spark, sf):
    """FN13: a model that knows stages 0, 2 and 4 only."""
    known = F.map_from_arrays(
        F.array(F.lit(0), F.lit(2), F.lit(4)), F.slice(F.col("proba"), 1, 3)
    )
    full = arrays.expand_probabilities(known)
    return _chances(spark, sf).select(
        *EPOCH, F.transform(full, lambda p: F.round(p, 6)).alias("proba")
    )


@query("q_bad_probabilities")
def bad_probabilities(spark, sf):
    """FLT19: doubling the first probability breaks the sum."""
    proba = F.col("proba")
    spoiled = F.when(
        F.col("pred") == 0, F.concat(F.array(proba[0] * 2), F.slice(proba, 2, 4))
    ).otherwise(proba)
    rows = _chances(spark, sf).withColumn("proba", spoiled)
    return checks.bad_probabilities(rows, EPOCH).select(*EPOCH)


@query("q_unmatched_epochs")
def unmatched_epochs(spark, sf):
    """FLT14: N3 epochs have no prediction, wake epochs no expert."""
    rows = B.vectors(spark, sf).select(*EPOCH, "stage")
    return checks.unmatched_epochs(
        rows.filter(F.col("stage") != S.N3), rows.filter(F.col("stage") != S.WAKE), EPOCH
    )


@query("q_wrong_shape")
def wrong_shape(spark, sf):
    """FLT13: wake epochs are cut short."""
    short = F.when(F.col("stage") == S.WAKE, F.slice("signal", 1, 63)).otherwise(F.col("signal"))
    return checks.wrong_shape(B.vectors(spark, sf).withColumn("signal", short), 64, EPOCH)


# --- nights -------------------------------------------------------------------------


def _nights(spark, sf) -> DataFrame:
    return nights.night_counts(B.predictions(spark, sf), "pred")


@query("q_night_summary")
def night_summary(spark, sf):
    """AGG13, J8."""
    return nights.stage_summary(_nights(spark, sf), 30).select(
        *S.REC, "stage", "name", "epochs", r6("pct"), r6("minutes")
    )


@query("q_sleep_stats")
def sleep_stats(spark, sf):
    """AGG14."""
    names = ["total_sleep_min", "time_in_bed_min", "sleep_efficiency_pct", "sleep_onset_min"]
    return nights.sleep_stats(_nights(spark, sf), 30).select(
        *S.REC, "n_epochs", *[r6(n) for n in names]
    )


@query("q_summary_report")
def summary_report(spark, sf):
    """SNK7."""
    return nights.summary_report(_nights(spark, sf), 30)


@query("q_summary_text")
def summary_text(spark, sf):
    """FN15."""
    stats = nights.sleep_stats(_nights(spark, sf), 30)
    lines = nights.summary_text(stats)
    return lines.withColumn("source", labels.source_text(F.col("subject_id").cast("string"), F.col("night")))


@query("q_metrics_text")
def metrics_text(spark, sf):
    """FN15: customers with an odd number count as not scored by an expert."""
    rows = B.labelled_orders(spark, sf)
    scored = agree.agreement(rows.filter(F.col("subject_id") % 2 == 0), "stage", "pred", ["subject_id"])
    everyone = rows.select("subject_id").distinct()
    return agree.metrics_text(everyone, agree.metrics_document(scored, ["subject_id"]), ["subject_id"])


@query("q_listing_manifest")
def listing_manifest(spark, sf):
    """SRC1, J1, SNK1: pages that list files, each name on two pages, straight to manifest rows."""
    users = B.table(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("n"), "c_custkey")
    stem = F.concat(F.lit("SC4"), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("1"))
    mark = F.chr(65 + F.col("c_custkey") % 7)  # differs by page: the last page's name wins
    html = F.concat(
        F.lit("<a>"), stem, mark, F.lit("0-PSG.edf</a> <a>"), stem, F.lit("EC-Hypnogram.edf</a> <a>notes.txt</a>")
    )
    pages = users.select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    names = discovery.listed_names(pages, "page_id", "html")
    return sinks.manifest_rows(discovery.pair_recordings(names), "/raw")


@query("q_hypnogram")
def hypnogram(spark, sf):
    """WIN11: every seventh order's truth counts as unscored."""
    rows = B.predictions(spark, sf)
    expert = F.when(F.col("epoch_idx") % 7 != 6, F.col("stage")).otherwise(S.UNSCORED)
    series = nights.hypnogram(rows.withColumn("expert", expert), "expert", "pred", 30)
    return series.select(*EPOCH, r6("hours"), "true_y", "pred_y")


@query("q_first_night")
def first_night(spark, sf):
    """SRT2."""
    return nights.first_night(B.predictions(spark, sf)).select(*EPOCH, "stage", "pred")


@query("q_export")
def export(spark, sf):
    """SNK5: written as CSV and read back."""
    rows = B.predictions(spark, sf)
    expert = F.when(F.col("epoch_idx") % 7 != 6, F.col("stage")).otherwise(S.UNSCORED)
    return nights.epoch_export(rows.withColumn("expert", expert), "pred", 30, "expert")


@query("q_export_files")
def export_files(spark, sf):
    """SNK5: the export of the embeddings' nights as CSV per night, read back."""
    path = scratch_path(spark, "export")
    rows = _chances(spark, sf)
    sinks.write_export(nights.epoch_export(rows, "pred", 30, "stage"), path)
    schema = (
        "epoch_idx int, start_sec int, pred_stage string, expert_stage string, "
        "subject_id string, night int"
    )
    return spark.read.schema(schema).option("header", True).csv(path)


# --- epoch store ------------------------------------------------------------------------


@query("q_epoch_store")
def epoch_store(spark, sf):
    """SNK2, SRC6-SRC8, AGG2: written, read back and counted."""
    path = scratch_path(spark, "epochs")
    sinks.write_epochs(B.vector_epochs(spark, sf), path)
    counts = nights.stage_counts(sources.read_epochs(spark, path), ["subject_id"])
    return counts.select("subject_id", "stage", "name", "n", r6("pct"))


@query("q_sample")
def sample(spark, sf):
    """SNK6, SRC10, FLT9, SRT3: one night packaged and loaded."""
    path = scratch_path(spark, "sample")
    splits = _splits(spark, sf)
    sinks.write_sample(B.vector_epochs(spark, sf), splits, "SC08", 1, B.VECTOR_SETTINGS.dataset, path)
    epochs, _ = sources.read_sample(spark, path)
    signal = F.transform("signal", lambda x: F.round(x.cast("double"), 6))
    return epochs.select(*EPOCH, "stage", signal.alias("signal"))


@query("q_sample_meta")
def sample_meta(spark, sf):
    """SNK6, J10: the packaged night's metadata."""
    path = scratch_path(spark, "sample")
    splits = _splits(spark, sf)
    sinks.write_sample(B.vector_epochs(spark, sf), splits, "SC08", 1, B.VECTOR_SETTINGS.dataset, path)
    _, meta = sources.read_sample(spark, path)
    return meta.select(
        "subject_id", F.col("night").cast("int").alias("night"), "n_epochs", "split", "not_test"
    )


# --- files ---------------------------------------------------------------------------------


@query("q_file_headers")
def file_headers(spark, sf):
    """SRC4."""
    headers = read_edf(spark, B.signal_files(spark, sf), "header")
    return headers.select(
        B.file_number(F.col("path")).alias("file_no"), "channel", r6("sfreq"), "n_samples"
    )


@query("q_file_checks")
def file_checks(spark, sf):
    """FLT7, FLT11, SRC4: both checks fail for the second channel at twice its rate."""
    headers = read_edf(spark, B.signal_files(spark, sf), "header")
    rate = checks.wrong_rate(headers, "EOG horizontal", 100)
    absent = checks.missing_channel(headers, "EEG Pz-Oz")
    number = B.file_number(F.col("path")).alias("file_no")
    return (
        rate.select(number, "sample_rate", "expected")
        .join(absent.select(number, F.array_join("available", ",").alias("available")), "file_no")
    )


@query("q_file_rejects")
def rejected_files(spark, sf):
    """SRC4, FLT15, FLT16: by file number, one left out, one overwritten, one cut short, one as it should be."""
    folder = B.signal_files(spark, sf)
    number = F.col("file_no").cast("string")
    files = B.vector_records(spark, sf).select("file_no").distinct().select(
        "file_no", F.concat(F.lit(f"{folder}/rec"), number, F.lit(S.SIGNAL_SUFFIX)).alias("path")
    )
    how = F.when(F.col("file_no") % 4 == 1, "junk").when(F.col("file_no") % 4 == 2, "cut")
    spoiled = files.select("path", how.alias("how")).filter("how is not null")
    derived.spoil_files(spoiled).write.format("noop").mode("overwrite").save()
    lost = F.concat(F.lit(f"{folder}/lost/rec"), number, F.lit(S.SIGNAL_SUFFIX))
    named = files.select("file_no", F.when(F.col("file_no") % 4 == 0, lost).otherwise(F.col("path")).alias("path"))
    named = materialize(named, "named-files")
    rejects = file_rejects(named, B.FILE_SETTINGS.dataset.channel, 100)
    return named.join(rejects, "path", "left").select("file_no", "reason")


@query("q_build_again")
def build_again(spark, sf):
    """SRC11, SNK1, SNK2, AGG2: a store built, one annotation file changed, and the store built again."""
    folder, recordings = B.recording_files(spark, sf)
    home = scratch_path(spark, "study")
    settings = replace(B.FILE_SETTINGS, paths=replace(B.FILE_SETTINGS.paths, processed_dir=home))
    recordings.orderBy(*S.REC).write.option("header", True).csv(settings.paths.manifest)
    flows.build_epochs(spark, settings)
    first = B.vector_records(spark, sf).filter("file_no = 0").select(
        F.concat(F.lit("rec0"), F.lit(S.ANNOTATION_SUFFIX)).alias("file"),
        "record",
        F.col("record").cast("double").alias("onset"),
        F.lit(1.0).alias("duration"),
        F.lit("Sleep stage R").alias("description"),
    )
    derived.write_annotation_files(first, folder).write.format("noop").mode("overwrite").save()
    flows.build_epochs(spark, settings)
    epochs = sources.read_epochs(spark, settings.paths.epochs)
    return epochs.groupBy("subject_id", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("q_file_signal")
def file_signal(spark, sf):
    """SRC2, FN3: every record of every file, three records to a block."""
    folder = B.signal_files(spark, sf)
    rows = read_edf(
        spark, folder, "signal", channel=B.FILE_SETTINGS.dataset.channel, recordsPerBlock=3
    )
    values = rows.select(
        B.file_number(F.col("path")).alias("file_no"),
        "start_sample",
        F.posexplode("samples").alias("_at", "_value"),
    )
    return values.select(
        "file_no", (F.col("start_sample") + F.col("_at")).alias("sample"), r6("_value", "value")
    )


@query("q_file_stretch")
def file_stretch(spark, sf):
    """SRC2, FLT11: a stretch of samples of every file; the bounds are the scan's."""
    folder = B.signal_files(spark, sf)
    rows = read_edf(spark, folder, "signal", channel=B.FILE_SETTINGS.dataset.channel, pushFilters=True)
    wanted = rows.filter((F.col("start_sample") >= 500) & (F.col("start_sample") < 2000))
    values = wanted.select(B.file_number(F.col("path")).alias("file_no"), F.explode("samples").alias("_value"))
    return values.groupBy("file_no").agg(
        F.count("_value").alias("n_samples"), r6(F.min("_value"), "low"), r6(F.max("_value"), "high")
    )


@query("q_file_stats")
def file_stats(spark, sf):
    """AGG1 over files: partial statistics at the scan, merged."""
    folder = B.signal_files(spark, sf)
    parts = read_edf(spark, folder, "moments", channel=B.FILE_SETTINGS.dataset.channel)
    stats = blocks.merge_moments(parts, ["path"])
    return stats.select(
        B.file_number(F.col("path")).alias("file_no"), "n_samples", r6("mean"), r6("std")
    )


@query("q_file_annotations")
def file_annotations(spark, sf):
    """SRC3."""
    rows = read_edf(spark, B.event_annotation_files(spark, sf), "annotations")
    return rows.select(
        B.file_number(F.col("path")).alias("file_no"), "onset", r6("duration"), "description"
    )


@query("q_file_epochs")
def file_epochs(spark, sf):
    """UDF2: files to labelled, normalized epochs with features; epochs cross file records."""
    _, recordings = B.recording_files(spark, sf)
    epochs = flows.epochs_from_files(spark, recordings, B.FILE_SETTINGS)
    names = ["feat_hjorth_activity", "feat_hjorth_mobility", "feat_hjorth_complexity", "feat_rms"]
    return epochs.select(
        *EPOCH, "stage", *[r6(F.col(n).cast("double"), n) for n in names]
    )


# --- models ----------------------------------------------------------------------------------


def _facts(scored: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """What holds for any fitted model, per scored epoch: a right label and whole probabilities."""
    total = F.aggregate("proba", F.lit(0.0), lambda acc, p: acc + p)
    facts = scored.select(
        *EPOCH,
        "stage",
        F.size("proba").alias("n_proba"),
        (F.abs(total - 1.0) <= 1e-9).alias("whole"),
        (F.array_position("proba", F.array_max("proba")) - 1 == F.col("pred")).alias("pred_is_argmax"),
    )
    if again is None:
        return facts
    other = again.select(*EPOCH, F.col("pred").alias("_pred"), F.col("proba").alias("_proba"))
    gap = F.array_max(F.zip_with("proba", "_proba", lambda a, b: F.abs(a - b)))
    same = scored.join(other, EPOCH).select(*EPOCH, ((F.col("pred") == F.col("_pred")) & (gap <= 1e-4)).alias("same"))
    return facts.join(same, EPOCH)


def _fitted_trees(spark, sf) -> tuple[DataFrame, TreeModel, TreeModel]:
    """The test split, and trees fitted on the train split with default settings, as fitted and as loaded."""
    epochs = materialize(B.vector_epochs(spark, sf), "epochs")
    splits = materialize(_splits(spark, sf), "splits")
    fitted = train_trees(cohort.split_epochs(epochs, splits, "train"), TreeSettings())
    path = scratch_path(spark, "trees")
    fitted.save(path)
    return cohort.split_epochs(epochs, splits, "test"), fitted, TreeModel.load(spark, path)


@query("q_train_score")
def train_score(spark, sf):
    """ML1, ML4, ML5, ML6, ML7, SNK9: fit on train with default settings, score the test split as fitted and as loaded."""
    test, fitted, loaded = _fitted_trees(spark, sf)
    return _facts(materialize(fitted.score(test), "scored"), materialize(loaded.score(test), "scored-again"))


@query("q_tree_parity")
def tree_parity(spark, sf):
    """AGG18, UDF4: fitted trees walked over bins in Arrow against the same trees as column expressions."""
    test, fitted, _ = _fitted_trees(spark, sf)
    scored, portable = materialize(fitted.score(test), "scored"), materialize(portable_score(fitted, test), "portable")
    compared = agree.scorer_parity(scored, portable, EPOCH)
    return compared.select("n_epochs", "label_diffs", (F.col("max_gap") <= 1e-4).alias("close"))


@query("q_raw_signal_score")
def raw_signal_score(spark, sf):
    """ML2, ML3, ML4, ML5, AGG16, SNK9: train on the signal with default settings, score the test split."""
    epochs = materialize(B.vector_epochs(spark, sf), "epochs")
    splits = materialize(_splits(spark, sf), "splits")
    fitted = train_raw(
        cohort.split_epochs(epochs, splits, "train"),
        cohort.split_epochs(epochs, splits, "val"),
        RawModelSettings(),
        epoch_samples=64,
        factor=2,
    )
    path = scratch_path(spark, "raw")
    fitted.save(path)
    test = cohort.split_epochs(epochs, splits, "test")
    loaded = RawModel.load(spark, path)
    return _facts(materialize(fitted.score(test), "scored"), materialize(loaded.score(test), "scored-again"))


@query("q_stage_recordings")
def stage_recordings(spark, sf):
    """ML4, UDF4, J5, J6, AGG13-AGG15: every file staged on its grid by a rule, against its annotations."""
    folder, pairs = B.recording_files(spark, sf)
    staged = flows.stage_recordings(spark, B.FILE_SETTINGS, folder, folder, _sign_predictor, pairs)
    return staged.stats.join(staged.metrics.drop("n_epochs"), "path").select(
        B.file_number(F.col("path")).alias("file_no"),
        "n_epochs",
        "n_scored_epochs",
        *[r6(c) for c in ("total_sleep_min", "time_in_bed_min", "sleep_efficiency_pct", "sleep_onset_min")],
        *[r6(c) for c in ("accuracy", "macro_f1", "cohen_kappa")],
    )


def _sign_predictor():
    """How many of the first four samples lie above the recording's mean, as a stage."""

    def predict(epochs: np.ndarray) -> np.ndarray:
        proba = np.zeros((len(epochs), S.N_STAGES))
        proba[np.arange(len(epochs)), (epochs[:, :4] > 0).sum(axis=1)] = 1.0
        return proba

    return predict
