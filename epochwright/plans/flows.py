"""The user-facing steps: discover, build_epochs, make_split, train, evaluate, stage_recordings.

Each step reads the tables of the one before, declares one lazy plan and writes
its result. Nothing but counts and at most a few metric rows reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import quotient
from epochwright.functions.labels import recording_key
from epochwright.functions.spectral import epoch_record, feature_struct
from epochwright.models.raw_signal import RawModel, train_raw
from epochwright.models.scoring import PredictorModel, require_model_name
from epochwright.models.trees import TreeModel, train_trees
from epochwright.operators import checks, cohort, discovery, nights
from epochwright.operators.agreement import (
    agreement,
    confusion,
    confusion_wide,
    metrics_document,
    per_class,
    scored_only,
)
from epochwright.operators.blocks import grid_plan, merge_moments
from epochwright.operators.indexing import row_index
from epochwright.operators.planning import expert_grid, plan_epochs, with_expert
from epochwright.session import materialize, sized
from epochwright.settings import Settings
from epochwright.sinks import tables as sinks
from epochwright.sources import tables as sources
from epochwright.sources.edf import file_facts, file_rejects, read_edf, read_listed, read_slices

MODELS = ["trees", "raw"]
_FILE = ["path"]  # recordings are keyed by file until an epoch is complete


def discover(
    spark: SparkSession, names: DataFrame, settings: Settings, limit: int | None = None
) -> DataFrame:
    """Listed ``name, pos`` rows to a manifest on storage; returns the manifest."""
    recordings = cohort.first_subjects(discovery.pair_recordings(names), limit)
    checks.require_rows(recordings, "no paired signal and annotation files in the listing")
    sinks.write_manifest(recordings, settings.paths.raw_dir, settings.paths.manifest)
    return sources.read_manifest(spark, settings.paths.manifest)


def _checked_headers(read: Callable, settings: Settings) -> DataFrame:
    """SRC4 + FLT7: channel headers of the signal files, after the channel and rate checks.

    ``read`` takes a mode and options and returns the files' rows.
    """
    dataset = settings.dataset
    headers = materialize(read("header"), "headers")
    checks.raise_on(
        checks.missing_channel(headers, dataset.channel),
        f"channel {dataset.channel!r} not found",
    )
    checks.raise_on(
        checks.wrong_rate(headers, dataset.channel, dataset.sample_rate),
        "unexpected sample rate",
    )
    return headers.filter(F.col("channel") == dataset.channel)


def _epoch_rows(plan: DataFrame, settings: Settings) -> DataFrame:
    """Planned epochs read from their files, with normalized signal and features.

    The plan is written first: it holds the statistics, which took a scan.
    """
    dataset = settings.dataset
    slices = read_slices(materialize(plan, "plan"), dataset.channel, dataset.epoch_samples)
    record = epoch_record(F.col("samples"), F.col("mean"), F.col("std"), settings)
    return slices.withColumn("_r", record).select("*", "_r.*").drop("_r", "samples")


def _signal_stats(read: Callable, settings: Settings) -> DataFrame:
    """Mean and deviation of every signal file: the first scan of the signal."""
    parts = read("moments", channel=settings.dataset.channel)
    return merge_moments(parts, _FILE).select("path", "mean", "std")


def _reader_of(paths: DataFrame, options: dict) -> Callable:
    """Reads the files that ``paths`` names in a given mode."""
    return lambda mode, **more: read_listed(paths, mode, **{**options, **more})


def planned_epochs(manifest: DataFrame, settings: Settings, **edf_options) -> DataFrame:
    """Trimmed, labelled epochs of every recording in ``manifest``, with where they lie and the recording's statistics."""
    dataset = settings.dataset
    manifest = materialize(manifest, "manifest")
    signals = _reader_of(manifest.select(F.col("psg_path").alias("path")), edf_options)
    texts = _reader_of(manifest.select(F.col("hypnogram_path").alias("path")), edf_options)
    headers = _checked_headers(signals, settings)
    # the headers of the annotation files too: a file without a text must still be there
    materialize(texts("header"), "annotation-headers")
    stats = _signal_stats(signals, settings)
    recordings = sized(
        manifest.withColumnRenamed("psg_path", "path")
        .join(headers.select("path", "n_samples"), "path")
        .join(stats, "path"),
        "recordings",
    )
    owned = texts("annotations").withColumnRenamed("path", "hypnogram_path").join(
        manifest.select("hypnogram_path", F.col("psg_path").alias("path")), "hypnogram_path"
    )
    # annotations take effect in time order, not in file order
    in_time = ["onset", "duration", "ann_no"]
    return plan_epochs(owned, recordings, dataset, _FILE, [*S.REC, "mean", "std"], in_time)


def epochs_from_files(
    spark: SparkSession, manifest: DataFrame, settings: Settings, **edf_options
) -> DataFrame:
    """The epoch table of every recording in ``manifest`` (UDF2).

    Exactly the files that the manifest names are read, and one that is missing
    or unreadable is an error. The signal is scanned twice, for statistics and
    for the planned epochs, and never shuffled or joined: recording facts ride
    on the small plan rows.
    """
    plan = planned_epochs(manifest, settings, **edf_options)
    return _epoch_rows(plan, settings).select(*S.EPOCH_SCHEMA.names)


def usable_recordings(manifest: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The recordings whose files can be read, and the faulty files of the others.

    Rejects: ``subject_id, night, path, reason, detail``; a recording may have two.
    """
    dataset = settings.dataset
    owned = lambda side: manifest.select(*S.REC, F.col(side).alias("path"))
    signals = file_rejects(owned("psg_path"), dataset.channel, dataset.sample_rate)
    texts = file_rejects(owned("hypnogram_path"))
    found = owned("psg_path").join(signals, "path").unionByName(owned("hypnogram_path").join(texts, "path"))
    rejects = materialize(found.select(*S.REC, "path", "reason", "detail"), "file-rejects")
    return manifest.join(rejects.select(*S.REC).distinct(), S.REC, "left_anti"), rejects


_BUILT = (
    "subject_id string, night int, psg_path string, psg_size bigint, psg_modified bigint, "
    "hypnogram_path string, hypnogram_size bigint, hypnogram_modified bigint, settings string"
)


def _files_wanted(manifest: DataFrame, settings: Settings) -> DataFrame:
    """What the store would be built from: each recording's files with size and time, and a digest of the settings."""
    both = F.explode(F.array("psg_path", "hypnogram_path")).alias("path")
    facts = materialize(file_facts(manifest.select(both)), "file-facts")
    side = lambda s: facts.select(
        F.col("path").alias(f"{s}_path"), F.col("size").alias(f"{s}_size"), F.col("modified").alias(f"{s}_modified")
    )
    chosen = json.dumps([asdict(settings.dataset), asdict(settings.bands)], sort_keys=True)
    rows = manifest.join(side("psg"), "psg_path").join(side("hypnogram"), "hypnogram_path")
    names = [field.split()[0] for field in _BUILT.split(", ")[:-1]]
    return rows.select(*names, F.lit(hashlib.md5(chosen.encode()).hexdigest()).alias("settings"))


def stale_subjects(spark: SparkSession, wanted: DataFrame, settings: Settings) -> DataFrame | None:
    """SRC11: subjects whose files or settings differ from what the store was built from; None if all must be built.

    All must be built if there is no store, or if it holds subjects that are not wanted any more.
    """
    try:
        built = spark.read.schema(_BUILT).parquet(settings.paths.built)
        sources.read_epochs(spark, settings.paths.epochs)
    except (AnalysisException, FileNotFoundError):
        return None
    if not built.join(wanted, "subject_id", "left_anti").isEmpty():
        return None
    fresh, known = F.struct(*wanted.columns).alias("_w"), F.struct(*wanted.columns).alias("_b")
    pairs = wanted.select(fresh, *S.REC).join(built.select(known, *S.REC), S.REC, "full_outer")
    differing = pairs.filter(~F.col("_w").eqNullSafe(F.col("_b"))).select("subject_id").distinct()
    return materialize(differing, "stale-subjects")


def build_epochs(
    spark: SparkSession, settings: Settings, on_bad: str = "error", rebuild: bool = False, **edf_options
) -> DataFrame:
    """Manifest and files to the epoch store; returns epochs and percent per stage (AGG2, SRC8).

    Only subjects whose files have changed since the last build are read and
    written again, unless ``rebuild`` asks for all. A bad file is an error, or with ``on_bad="skip"`` a
    row of the rejects beside the store, and its recording is left out.
    """
    if on_bad not in ("error", "skip"):
        raise ValueError(f"on_bad must be 'error' or 'skip', got {on_bad!r}")
    paths = settings.paths
    manifest = materialize(sources.read_manifest(spark, paths.manifest), "manifest")
    if on_bad == "skip":
        manifest, rejects = usable_recordings(manifest, settings)
        rejects.write.mode("overwrite").json(paths.rejects)
    wanted = materialize(_files_wanted(manifest, settings), "files-wanted")
    stale = None if rebuild else stale_subjects(spark, wanted, settings)
    plan = None
    if stale is not None and not stale.isEmpty():
        changed = manifest.join(stale, "subject_id", "left_semi")
        plan = materialize(planned_epochs(changed, settings, **edf_options), "plan")
        stored = sources.read_epochs(spark, paths.epochs).select("subject_id").distinct()
        left = stale.join(plan.select("subject_id").distinct(), "subject_id", "left_anti")
        if not left.join(stored, "subject_id", "left_semi").isEmpty():
            stale = plan = None  # a subject has no epoch any more: its folder has to go
    if stale is None:
        # the record of the last build goes first: a build that breaks off is then not taken for whole
        wanted.limit(0).write.mode("overwrite").parquet(paths.built)
        sinks.write_epochs(epochs_from_files(spark, manifest, settings, **edf_options), paths.epochs)
    elif plan is not None:
        sinks.write_epochs(_epoch_rows(plan, settings), paths.epochs, only_these=True)
    wanted.write.mode("overwrite").parquet(paths.built)
    return nights.stage_counts(sources.read_epochs(spark, paths.epochs))


def make_split(
    spark: SparkSession,
    settings: Settings,
    seed: int | None = None,
    val_frac: float | None = None,
    test_frac: float | None = None,
) -> DataFrame:
    """Seeded, checked subject split, written as a table and a document."""
    chosen = settings.split
    given = {"seed": seed, "val_frac": val_frac, "test_frac": test_frac}
    chosen = replace(chosen, **{k: v for k, v in given.items() if v is not None})
    epochs = sources.read_epochs(spark, settings.paths.epochs)
    stages = materialize(cohort.subject_stages(epochs), "subject-stages")
    splits = materialize(
        cohort.assign_splits(stages, chosen.seed, chosen.val_frac, chosen.test_frac), "splits"
    )
    cohort.check_splits(splits, stages)
    sinks.write_splits(splits, settings.paths.split_table)
    document = sinks.split_document(splits, chosen.seed, chosen.val_frac, chosen.test_frac)
    sinks.write_document(document, settings.paths.splits)
    return splits


def load_split(spark: SparkSession, settings: Settings, split: str) -> DataFrame:
    """Epochs of one split (ML7 views select from it)."""
    splits = sources.read_splits(spark, settings.paths.split_table)
    return cohort.split_epochs(sources.read_epochs(spark, settings.paths.epochs), splits, split)


def train(
    spark: SparkSession,
    settings: Settings,
    model: str,
    rounds: int | None = None,
    batch_size: int | None = None,
    learning_rate: float | None = None,
    class_weights: str | None = None,
    factor: int = 10,
):
    """Fit and save ``trees`` or ``raw``; keyword arguments override the settings (ML9)."""
    require_model_name(model, MODELS)
    given = {
        "rounds": rounds,
        "batch_size": batch_size,
        "learning_rate": learning_rate,
        "class_weights": class_weights,
    }
    raw = replace(settings.raw_model, **{k: v for k, v in given.items() if v is not None})
    path = f"{settings.paths.models_dir}/{model}"
    train_rows = load_split(spark, settings, "train")
    checks.require_rows(train_rows.select("stage"), "the train split has no epochs")
    if model == "trees":
        fitted = train_trees(train_rows, settings.trees, balanced=raw.class_weights == "auto")
    else:
        val_rows = load_split(spark, settings, "val")
        samples = settings.dataset.epoch_samples
        fitted = train_raw(train_rows, val_rows, raw, samples, factor, settings.trees.seed)
    fitted.save(path)
    return fitted


def load_model(spark: SparkSession, settings: Settings, model: str | Callable):
    """SNK9: a saved model by name; a predictor factory (UDF4) is taken as it is."""
    if callable(model):
        return PredictorModel(model)
    require_model_name(model, MODELS)
    path = f"{settings.paths.models_dir}/{model}"
    if model == "trees":
        return TreeModel.load(spark, path)
    return RawModel.load(spark, path)


def model_name(model: str | Callable) -> str:
    """What reports call a model: its name, or that of the predictor factory."""
    return model if isinstance(model, str) else getattr(model, "__name__", "predictor")


def evaluate(
    spark: SparkSession, settings: Settings, model: str | Callable, split: str = "test"
) -> DataFrame:
    """Score one split (ML5), write the metrics document and first-night hypnogram."""
    fitted = load_model(spark, settings, model)
    model = model_name(model)
    rows = checks.require_rows(
        load_split(spark, settings, split), f"the {split} split has no epochs"
    )
    scored = materialize(
        fitted.score(rows).select(*S.REC, "epoch_idx", "stage", "pred"), "predictions"
    )
    counted = agreement(scored, "stage", "pred")
    report = sinks.metrics_report(counted, scored, model)
    sinks.write_document(report, f"{settings.paths.reports_dir}/metrics_{model}.json")
    sinks.write_document(
        sinks.test_subjects(scored, model), f"{settings.paths.reports_dir}/metrics_{model}_subjects.json"
    )
    night = nights.hypnogram(
        nights.first_night(scored), "stage", "pred", settings.dataset.epoch_sec
    )
    night.write.mode("overwrite").parquet(f"{settings.paths.reports_dir}/hypnogram_{model}")
    return report


def confusion_report(
    spark: SparkSession, settings: Settings, model: str, split: str = "test"
) -> dict[str, DataFrame]:
    """SNK8: counts, row shares and per-class scores of any split and model, as tables."""
    scored = load_model(spark, settings, model).score(load_split(spark, settings, split))
    counted = materialize(agreement(scored, "stage", "pred"), "agreement")
    return {
        "counts": confusion_wide(counted),
        "shares": confusion(counted),
        "per_class": per_class(counted),
    }


@dataclass
class StagedRecordings:
    """Everything shown about staged recordings, keyed by ``path`` (or ``REC`` for samples)."""

    predictions: DataFrame
    stages: DataFrame
    stats: DataFrame
    metrics: DataFrame | None
    keys: list[str]
    epoch_sec: int
    model: str

    @property
    def has_expert(self) -> bool:
        return self.metrics is not None


def stage_epochs(
    epochs: DataFrame, fitted, keys: list[str], settings: Settings, model: str,
    expert: DataFrame | None = None,
) -> StagedRecordings:
    """Score epochs of any number of recordings and summarize each.

    ``expert`` (``keys``, ``epoch_idx``, ``expert``) must cover the same epochs
    (FLT14). Metrics use scored epochs only; a recording without any has no
    metrics row (FLT10, AGG15).
    """
    at = [*keys, "epoch_idx"]
    scored = fitted.score(epochs).select(*at, "pred", "proba")
    scored = materialize(scored, "predictions")
    checks.raise_on(checks.bad_probabilities(scored, at), "bad probabilities")
    metrics = None
    if expert is not None:
        checks.raise_on(
            checks.unmatched_epochs(scored, expert, at), "expert and predicted epochs differ"
        )
        scored = with_expert(scored, expert, at)
        counted = agreement(scored_only(scored, "expert"), "expert", "pred", keys)
        metrics = metrics_document(counted, keys).withColumn("model", F.lit(model))
        metrics = metrics.withColumn("n_scored_epochs", F.col("n_epochs"))
    counts = nights.night_counts(scored, "pred", keys)
    sec = settings.dataset.epoch_sec
    return StagedRecordings(
        scored,
        nights.stage_summary(counts, sec, keys),
        nights.sleep_stats(counts, sec, keys),
        metrics,
        keys,
        sec,
        model,
    )


def _name_key(path: str) -> Column:
    return recording_key(F.substring_index(path, "/", -1))


def _spelled(path: str) -> Column:
    """One spelling of a path: local ones without ``file:``, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "(?<!:)/{2,}", "/")


def paired_annotations(pairs: DataFrame, headers: DataFrame, options: dict) -> DataFrame:
    """Annotations of the files that ``pairs`` names, with the ``path`` of their signal file.

    Nothing is lost silently: an annotation file that is not there and a
    signal file that is not staged are errors that name it, and so are two
    annotation files for one signal file.
    """
    named = materialize(
        pairs.select(F.col("hypnogram_path").alias("path"), _spelled("psg_path").alias("_signal")).distinct(), "pairs"
    )
    staged = headers.select(F.col("path").alias("_path"), _spelled("path").alias("_signal"))
    lost = named.join(staged, "_signal", "left_anti").select(F.col("_signal").alias("psg_path"), "path")
    checks.raise_on(lost, "pairs name signal files that are not staged")
    twice = named.groupBy("_signal").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    checks.raise_on(twice, "more than one annotation file for a signal file")
    checks.raise_on(file_rejects(named), "annotation files that cannot be read")
    owners = named.withColumnRenamed("path", "hypnogram_path").join(staged, "_signal")
    texts = read_listed(named, "annotations", **options).withColumnRenamed("path", "hypnogram_path")
    return texts.join(owners, "hypnogram_path").drop("_signal").withColumnRenamed("_path", "path")


def stage_recordings(
    spark: SparkSession,
    settings: Settings,
    signal_path: str,
    annotation_path: str | None = None,
    model: str | Callable = "trees",
    pairs: DataFrame | None = None,
    signal_glob: str = "*" + S.SIGNAL_SUFFIX,
    annotation_glob: str = "*" + S.ANNOTATION_SUFFIX,
    max_bytes: int = discovery.MAX_BYTES,
    **edf_options,
) -> StagedRecordings:
    """Stage every signal file below a path on its grid from t = 0, one plan for all.

    Annotation files, where given, belong to the signal file ``pairs`` names
    (``psg_path, hypnogram_path``), else to the one with the same six-character
    name key. A file above ``max_bytes`` is refused before anything is read
    (FLT12).
    """
    dataset = settings.dataset
    present = sources.list_files(spark, signal_path, signal_glob)
    checks.raise_on(discovery.oversized_files(present, max_bytes), "file too large")
    signals = lambda mode, **more: read_edf(
        spark, signal_path, mode, glob=signal_glob, **{**edf_options, **more}
    )
    headers = _checked_headers(signals, settings)
    checks.raise_on(
        checks.too_short(headers, dataset.epoch_samples, _FILE), "shorter than one epoch"
    )
    stats = _signal_stats(signals, settings)
    plan = grid_plan(headers.join(stats, "path"), dataset.epoch_samples, _FILE).select(
        "path", "epoch_idx", "start_sample", "mean", "std"
    )
    epochs = _epoch_rows(plan, settings)
    expert = None
    if annotation_path is not None or pairs is not None:
        grid = headers.select(
            "path", quotient(F.col("n_samples"), dataset.epoch_samples).alias("n_epochs")
        )
        if pairs is not None:
            owned = paired_annotations(pairs, headers, edf_options)
        else:
            raw = read_edf(spark, annotation_path, "annotations", glob=annotation_glob, **edf_options)
            owned = raw.withColumnRenamed("path", "hypnogram_path")
            owned = owned.withColumn("_key", _name_key("hypnogram_path")).join(
                grid.select("path", _name_key("path").alias("_key")), "_key"
            )
        annotations = row_index(owned, _FILE, ["onset", "duration", "ann_no"], "ann_idx")
        expert = expert_grid(annotations, grid, dataset, _FILE)
    fitted = load_model(spark, settings, model)
    return stage_epochs(epochs, fitted, _FILE, settings, model_name(model), expert)


def stage_sample(
    spark: SparkSession, settings: Settings, path: str, model: str | Callable = "trees"
) -> StagedRecordings:
    """Stage a packaged night (SRC10); its stored stages, where present, are the expert."""
    night, _ = sources.read_sample(spark, path)
    epochs = night.drop("stage").withColumn("_f", feature_struct(F.col("signal"), settings))
    epochs = epochs.select(*S.REC, "epoch_idx", "signal", "_f.*")
    expert = None
    if "stage" in night.columns:
        expert = night.select(
            *S.REC, "epoch_idx", F.coalesce("stage", F.lit(S.UNSCORED)).alias("expert")
        )
    fitted = load_model(spark, settings, model)
    return stage_epochs(epochs, fitted, S.REC, settings, model_name(model), expert)
