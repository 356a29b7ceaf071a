import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions import spectral
from epochwright.operators import nights
from epochwright.plans import derived, flows
from epochwright.settings import PathSettings, RawModelSettings, Settings, SplitSettings, TreeSettings
from epochwright.sinks import tables as sinks
from epochwright.sources import tables as sources

FULL = (-100, 100, -32768, 32767)
TEXT = ["Sleep stage W", "Sleep stage 1", "Sleep stage 2", "Sleep stage 3", "Sleep stage R"]
STAGES = [0, 0, 1, 2, 3, 4, 2, 1, 0, 0]  # per 30 s epoch
SUBJECTS = 6


def _recording(seed):
    """Each stage is a tone of its own in noise, so a model can tell them apart."""
    rng = np.random.default_rng(seed)
    t = np.arange(3000) / 100.0
    hz = {0: 10.0, 1: 6.0, 2: 13.5, 3: 1.5, 4: 20.0}
    x = [30 * np.sin(2 * np.pi * hz[s] * t) + rng.normal(0, 5, 3000) for s in STAGES]
    return np.concatenate(x) + 3.0


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    """Raw files of six subjects: 30 s records for some, 7 s records for others."""
    base = tmp_path_factory.mktemp("study")
    raw = base / "raw"
    for s in range(SUBJECTS):
        x = _recording(s)
        seconds = 30 if s % 2 else 7
        records = len(x) // (100 * seconds)
        digital = np.rint(np.clip(x, -100, 100) / 200 * 65535 - 0.5).astype("<i2")
        digital = digital[: records * 100 * seconds].reshape(records, -1)
        derived.write_file(
            str(raw / f"SC4{s:02d}1E0-PSG.edf"),
            derived.edf_bytes(seconds, [("EEG Fpz-Cz", "uV", FULL, digital)]),
        )
        notes = [(30 * i, 30, TEXT[st]) for i, st in enumerate(STAGES)]
        # file order is not time order
        derived.write_file(
            str(raw / f"SC4{s:02d}1EC-Hypnogram.edf"), derived.edf_bytes(0, [], notes[::-1])
        )
    paths = PathSettings().anchored(str(base))
    paths = replace(
        paths,
        raw_dir=str(raw),
        processed_dir=str(base / "processed"),
        models_dir=str(base / "models"),
        reports_dir=str(base / "reports"),
    )
    return Settings(
        paths=paths,
        split=SplitSettings(seed=1, val_frac=0.2, test_frac=0.2),
        trees=TreeSettings(rounds=2),
        raw_model=RawModelSettings(rounds=2, patience=1),
    )


@pytest.fixture(scope="module")
def study(spark, home):
    files = sources.list_files(spark, home.paths.raw_dir, "*.edf")
    names = files.withColumn("pos", F.lit(0))
    manifest = flows.discover(spark, names, home)
    counts = flows.build_epochs(spark, home, splitBytes=20_000, recordsPerBlock=2)
    splits = flows.make_split(spark, home)
    return {"manifest": manifest, "counts": counts, "splits": splits}


@pytest.fixture(scope="module")
def trees(spark, home, study):
    return flows.train(spark, home, "trees")


def test_manifest(study):
    assert study["manifest"].count() == SUBJECTS


def test_counts(study):
    got = {r["name"]: r["n"] for r in study["counts"].collect()}
    assert got == {"W": 21, "N1": 12, "N2": 12, "N3": 6, "REM": 6}


def test_store_equals_one_array_per_recording(spark, home, study):
    epochs = sources.read_epochs(spark, home.paths.epochs)
    assert epochs.columns == S.EPOCH_SCHEMA.names
    rows = epochs.orderBy("subject_id", "epoch_idx").collect()
    for s in range(SUBJECTS):
        x = _recording(s)
        seconds = 30 if s % 2 else 7
        digital = np.rint(np.clip(x, -100, 100) / 200 * 65535 - 0.5)[: len(x) // (100 * seconds) * 100 * seconds]
        signal = (digital + 32768) * 200 / 65535 - 100
        z = (signal - signal.mean()) / (signal.std() + 1e-8)
        want = z[: len(z) // 3000 * 3000].reshape(-1, 3000)
        own = [r for r in rows if r["subject_id"] == f"SC{s:02d}"]
        assert [r["stage"] for r in own] == STAGES[: len(want)]
        assert [r["epoch_idx"] for r in own] == list(range(len(want)))
        np.testing.assert_allclose([r["signal"] for r in own], want, rtol=1e-5, atol=1e-6)
        features = spectral.feature_matrix(want, 100, home.bands.edges())
        got = [[r[n] for n in S.FEATURES] for r in own]
        np.testing.assert_allclose(got, features, rtol=1e-4, atol=1e-6)


def test_split_files(spark, home, study):
    table = {r["subject_id"]: r["split"] for r in study["splits"].collect()}
    assert sorted(table.values()) == ["test"] + ["train"] * 4 + ["val"]
    document = sources.read_split_document(spark, home.paths.splits)
    again = {r["subject_id"]: r["split"] for r in sources.splits_of_document(document).collect()}
    assert again == table
    for row in document.collect():
        assert row["ids"] == sorted(row["ids"]) and row["n_ids"] == len(row["ids"]) and row["seed"] == 1


def test_split_filter_prunes_partitions(spark, home, study):
    plan = sources.read_epochs(spark, home.paths.epochs).filter("subject_id = 'SC01'").select("stage")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subject_id" in text and "signal" not in text


@pytest.mark.parametrize("model", ["trees", "raw"])
def test_train_and_evaluate(spark, home, trees, model):
    if model == "raw":
        flows.train(spark, home, model, factor=30)
    report = flows.evaluate(spark, home, model)
    text = spark.read.text(f"{home.paths.reports_dir}/metrics_{model}.json").first()[0]
    doc = json.loads(text)
    assert doc["model"] == model and doc["n_test_subjects"] == 1
    assert doc["n_epochs"] == sum(map(sum, doc["confusion_matrix"])) > 0
    assert report.first()["accuracy"] == pytest.approx(doc["accuracy"])
    if model == "trees":
        assert doc["accuracy"] > 0.6
    night = spark.read.parquet(f"{home.paths.reports_dir}/hypnogram_{model}")
    assert night.count() == doc["n_epochs"]


def test_confusion_report(spark, home, trees):
    report = flows.confusion_report(spark, home, "trees", "val")
    n = report["per_class"].agg(F.sum("support")).first()[0]
    assert n == flows.load_split(spark, home, "val").count() > 0
    assert report["counts"].count() == 5 and report["shares"].count() == 25


def test_stage_recordings(spark, home, trees):
    raw = home.paths.raw_dir
    staged = flows.stage_recordings(spark, home, raw, raw, "trees")
    rows = staged.predictions.orderBy("path", "epoch_idx").collect()
    # the grid starts at 0 and is not trimmed: the 7 s files lose their last, partial epoch
    assert len(rows) == 3 * 10 + 3 * 9
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 and len(r["proba"]) == 5 for r in rows)
    assert {r["expert"] for r in rows} == {0, 1, 2, 3, 4}
    metrics = staged.metrics.collect()
    assert len(metrics) == SUBJECTS and all(m["n_scored_epochs"] in (9, 10) for m in metrics)
    stats = staged.stats.filter(F.col("path").contains("SC4011")).first()
    assert stats["time_in_bed_min"] == 5.0
    assert staged.stages.count() == SUBJECTS * 5
    assert not flows.stage_recordings(spark, home, raw, None, "trees").has_expert


def test_sample(spark, home, study, trees, tmp_path):
    epochs = sources.read_epochs(spark, home.paths.epochs)
    splits = study["splits"]
    test_subject = splits.filter("split = 'test'").first()["subject_id"]
    other = splits.filter("split = 'train'").first()["subject_id"]
    path = str(tmp_path / "sample")
    assert sinks.write_sample(epochs, splits, test_subject, 1, home.dataset, path)
    staged = flows.stage_sample(spark, home, path, "trees")
    assert staged.metrics.first()["n_scored_epochs"] == staged.predictions.count()
    assert not sinks.write_sample(epochs, splits, other, 1, home.dataset, path)
    with pytest.raises(ValueError, match="no epochs"):
        sinks.write_sample(epochs, splits, "SC77", 1, home.dataset, path)


def test_sample_label(spark, home, study, tmp_path):
    epochs = sources.read_epochs(spark, home.paths.epochs)
    sinks.write_sample(epochs, study["splits"], "SC01", 1, home.dataset, str(tmp_path / "s"))
    _, meta = sources.read_sample(spark, str(tmp_path / "s"))
    row = meta.first()
    assert (row["n_epochs"], row["epoch_samples"], row["channel"]) == (10, 3000, "EEG Fpz-Cz")


def test_missing_inputs_name_the_step(spark, home, tmp_path):
    empty = replace(home, paths=PathSettings().anchored(str(tmp_path)))
    with pytest.raises(FileNotFoundError, match="Run discover first"):
        flows.build_epochs(spark, empty)
    with pytest.raises(FileNotFoundError, match="Run build_epochs first"):
        flows.make_split(spark, empty)
    with pytest.raises(ValueError, match="unknown model"):
        flows.train(spark, empty, "forest")
    with pytest.raises(ValueError, match="no paired"):
        flows.discover(spark, spark.createDataFrame([("x", 1)], "name string, pos int"), empty)


def test_wrong_rate_is_an_error(spark, home, tmp_path):
    digital = np.zeros((30, 200), "<i2")
    derived.write_file(
        str(tmp_path / "SC4001E0-PSG.edf"), derived.edf_bytes(1.0, [("EEG Fpz-Cz", "uV", FULL, digital)])
    )
    with pytest.raises(ValueError, match="sample rate.*200"):
        flows.stage_recordings(spark, home, str(tmp_path))


def test_short_recording_is_an_error(spark, home, tmp_path):
    digital = np.zeros((29, 100), "<i2")
    derived.write_file(
        str(tmp_path / "SC4001E0-PSG.edf"), derived.edf_bytes(1.0, [("EEG Fpz-Cz", "uV", FULL, digital)])
    )
    with pytest.raises(ValueError, match="shorter than one epoch"):
        flows.stage_recordings(spark, home, str(tmp_path))


def test_night_arithmetic(spark):
    rows = [("a", 1, i, s) for i, s in enumerate([0, 0, 2, 2, 2, 4])] + [("b", 1, i, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "subject_id string, night int, epoch_idx int, stage int")
    counts = nights.night_counts(df, "stage")
    a, b = nights.sleep_stats(counts, 30).orderBy("subject_id").collect()
    assert (a["total_sleep_min"], a["time_in_bed_min"], a["sleep_onset_min"]) == (2.0, 3.0, 1.0)
    assert a["sleep_efficiency_pct"] == pytest.approx(66.667, abs=1e-3)
    assert b["sleep_onset_min"] is None and b["total_sleep_min"] == 0.0
    summary = {(r["subject_id"], r["name"]): r for r in nights.stage_summary(counts, 30).collect()}
    assert summary[("a", "N2")]["epochs"] == 3 and summary[("a", "N3")]["pct"] == 0.0
    assert nights.summary_text(nights.sleep_stats(counts, 30)).filter("subject_id = 'b'").first()["sleep_onset"] == "—"


def _manifest(spark, home, **changed):
    rows = [
        (f"SC{s:02d}", 1, f"{home.paths.raw_dir}/SC4{s:02d}1E0-PSG.edf", f"{home.paths.raw_dir}/SC4{s:02d}1EC-Hypnogram.edf")
        for s in range(2)
    ]
    rows[1] = (*rows[1][:2], changed.get("signal", rows[1][2]), changed.get("annotations", rows[1][3]))
    return spark.createDataFrame(rows, S.MANIFEST_SCHEMA)


def test_the_manifest_drives_the_scan(spark, home):
    want = flows.epochs_from_files(spark, _manifest(spark, home), home).count()
    assert want > 0
    base = home.paths.raw_dir
    # another spelling of a path is the same file; files beside the named ones are not read
    derived.write_file(f"{base}/stray/notes-PSG.edf", b"not a recording")
    again = _manifest(spark, home, signal=f"file:{base}//SC4011E0-PSG.edf")
    assert flows.epochs_from_files(spark, again, home).count() == want


@pytest.mark.parametrize("side", ["signal", "annotations"])
def test_a_missing_file_is_an_error(spark, home, side):
    lost = _manifest(spark, home, **{side: f"{home.paths.raw_dir}/lost.edf"})
    with pytest.raises(Exception, match="lost.edf"):
        flows.epochs_from_files(spark, lost, home).count()


def test_oversized_files_are_refused(spark, home):
    with pytest.raises(ValueError, match="too large"):
        flows.stage_recordings(spark, home, home.paths.raw_dir, max_bytes=100)


def test_a_predictor_serves_the_steps(spark, home, study):
    def constant():
        return lambda x: np.tile([0.1, 0.1, 0.6, 0.1, 0.1], (len(x), 1))

    report = flows.evaluate(spark, home, constant).first()
    assert report["model"] == "constant" and report["per_stage"]["N2"]["recall"] == 1.0
