"""Builds that read only what has changed, files that cannot be used, and pairs that must hold."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.plans import derived, flows
from epochwright.settings import PathSettings, Settings
from epochwright.sources import edf
from epochwright.sources import tables as sources

FULL = (-100, 100, -32768, 32767)
CHANNEL = "EEG Fpz-Cz"


def signal(path, seed=0, epochs=6, channel=CHANNEL, rate=100):
    x = np.random.default_rng(seed).integers(-32768, 32767, (epochs, 30 * rate)).astype("<i2")
    derived.write_file(str(path), derived.edf_bytes(30, [(channel, "uV", FULL, x)]))
    return str(path)


def notes(path, texts):
    derived.write_file(str(path), derived.edf_bytes(0, [], [(30 * i, 30, f"Sleep stage {t}") for i, t in enumerate(texts)]))
    return str(path)


@pytest.fixture
def study(spark, tmp_path):
    """Three subjects, one with two nights."""
    raw, rows = tmp_path / "raw", []
    for subject, night in (("SC00", 1), ("SC00", 2), ("SC01", 1), ("SC02", 1)):
        stem = f"SC4{subject[2:]}{night}"
        rows.append(
            (subject, night, signal(raw / f"{stem}E0-PSG.edf", hash(stem) % 97), notes(raw / f"{stem}EC-Hypnogram.edf", "W12R2W"))
        )
    paths = replace(PathSettings(), processed_dir=str(tmp_path / "processed"), raw_dir=str(raw))
    settings = Settings(paths=paths)
    manifest = spark.createDataFrame(rows, S.MANIFEST_SCHEMA)
    manifest.write.option("header", True).csv(settings.paths.manifest)
    return settings, rows


def store(spark, settings):
    rows = sources.read_epochs(spark, settings.paths.epochs).select(*S.REC, "epoch_idx", "stage", "signal").collect()
    return sorted((r["subject_id"], r["night"], r["epoch_idx"], r["stage"], tuple(r["signal"][:5])) for r in rows)


def files(settings):
    base = settings.paths.epochs
    return {d: sorted(f for f in os.listdir(f"{base}/{d}") if f.endswith(".parquet")) for d in os.listdir(base) if "=" in d}


def test_a_second_build_reads_no_signal(spark, study, monkeypatch):
    settings, _ = study
    first = {r["name"]: r["n"] for r in flows.build_epochs(spark, settings).collect()}
    before = files(settings)
    monkeypatch.setattr(flows, "planned_epochs", None)  # nothing may be planned or read
    monkeypatch.setattr(flows, "read_slices", None)
    again = {r["name"]: r["n"] for r in flows.build_epochs(spark, settings).collect()}
    assert again == first and sum(first.values()) == 24 and files(settings) == before


def test_a_changed_file_is_built_again_and_others_stay(spark, study):
    settings, rows = study
    flows.build_epochs(spark, settings)
    before = files(settings)
    notes(rows[1][3], "RRRR22")
    flows.build_epochs(spark, settings)
    after = files(settings)
    assert after["subject_id=SC00"] != before["subject_id=SC00"]
    assert {d: f for d, f in after.items() if "SC00" not in d} == {d: f for d, f in before.items() if "SC00" not in d}
    got = store(spark, settings)
    flows.build_epochs(spark, settings, rebuild=True)
    assert got == store(spark, settings)
    assert [r[3] for r in got if r[:2] == ("SC00", 2)] == [4, 4, 4, 4, 2, 2]
    # other settings are another build
    other = replace(settings, dataset=replace(settings.dataset, wake_pad_min=0))
    flows.build_epochs(spark, other)
    assert len(store(spark, other)) == 3 * 4 + 6


def test_subjects_that_go_or_come_to_nothing(spark, study):
    settings, rows = study
    flows.build_epochs(spark, settings)
    notes(rows[3][3], "??????")  # SC02 has no scored epoch any more
    flows.build_epochs(spark, settings)
    assert {r[0] for r in store(spark, settings)} == {"SC00", "SC01"}
    spark.createDataFrame(rows[:2], S.MANIFEST_SCHEMA).write.mode("overwrite").option("header", True).csv(settings.paths.manifest)
    flows.build_epochs(spark, settings)
    assert {r[0] for r in store(spark, settings)} == {"SC00"}


def test_a_build_that_broke_off_is_not_taken_for_whole(spark, study, monkeypatch):
    settings, _ = study
    flows.build_epochs(spark, settings)
    monkeypatch.setattr(flows.sinks, "write_epochs", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        flows.build_epochs(spark, settings, rebuild=True)
    monkeypatch.undo()
    stale = flows.stale_subjects(spark, flows._files_wanted(sources.read_manifest(spark, settings.paths.manifest), settings), settings)
    assert {r[0] for r in stale.collect()} == {"SC00", "SC01", "SC02"}


def test_bad_files_become_rows(spark, study, tmp_path):
    settings, rows = study
    derived.write_file(rows[0][2], b"not a recording")
    with open(rows[2][2], "rb") as handle:
        content = handle.read()
    derived.write_file(rows[2][2], content[: len(content) // 2])
    os.remove(rows[3][3])
    with pytest.raises(Exception):
        flows.build_epochs(spark, settings)
    flows.build_epochs(spark, settings, on_bad="skip")
    assert {r[:2] for r in store(spark, settings)} == {("SC00", 2)}
    rejects = spark.read.json(settings.paths.rejects).collect()
    assert sorted((r["subject_id"], r["night"], r["reason"]) for r in rejects) == [
        ("SC00", 1, "unreadable"), ("SC01", 1, "truncated"), ("SC02", 1, "missing"),
    ]
    with pytest.raises(ValueError, match="on_bad"):
        flows.build_epochs(spark, settings, on_bad="guess")


def test_reasons(spark, tmp_path):
    named = {
        "good": signal(tmp_path / "good.edf"),
        "channel": signal(tmp_path / "channel.edf", channel="EOG"),
        "rate": signal(tmp_path / "rate.edf", rate=200),
        "missing": str(tmp_path / "nowhere.edf"),
        "folder": str(tmp_path),
    }
    derived.write_file(str(tmp_path / "empty.edf"), b"")
    named["empty"] = str(tmp_path / "empty.edf")
    paths = spark.createDataFrame([(p,) for p in named.values()] * 2 + [(None,)], "path string")
    got = {r["path"]: r["reason"] for r in edf.file_rejects(paths, CHANNEL, 100).collect()}
    assert got == {
        named["channel"]: "channel", named["rate"]: "rate", named["missing"]: "missing", named["folder"]: "missing",
        named["empty"]: "unreadable", None: "missing",
    }


def stage(spark, settings, pairs):
    def flat():
        return lambda x: np.tile(np.eye(5)[2], (len(x), 1))

    raw = settings.paths.raw_dir
    table = spark.createDataFrame(pairs, "psg_path string, hypnogram_path string")
    return flows.stage_recordings(spark, settings, raw, raw, flat, table)


def test_staging_loses_no_annotation(spark, study):
    settings, rows = study
    spellings = [lambda p: p, lambda p: p.replace("/raw/", "//raw///"), lambda p: f"file:{p}", lambda p: f"file://{p}"]
    pairs = [(s(r[2]), s(r[3])) for s, r in zip(spellings, rows)]
    staged = stage(spark, settings, pairs)
    assert staged.metrics.count() == 4 and staged.predictions.count() == 24
    assert {r["n_scored_epochs"] for r in staged.metrics.collect()} == {6}


@pytest.mark.parametrize("fault, message", [("signal", "not staged.*lost-PSG"), ("text", "cannot be read.*lost-Hyp"), ("twice", "more than one")])
def test_staging_refuses_wrong_pairs(spark, study, fault, message):
    settings, rows = study
    pairs = [(r[2], r[3]) for r in rows]
    raw = settings.paths.raw_dir
    if fault == "signal":
        pairs[0] = (f"{raw}/lost-PSG.edf", pairs[0][1])
    elif fault == "text":
        pairs[0] = (pairs[0][0], f"{raw}/lost-Hypnogram.edf")
    else:
        pairs.append((pairs[0][0], pairs[1][1]))
    with pytest.raises(ValueError, match=message):
        stage(spark, settings, pairs)


def test_swapped_pairs_are_followed(spark, study):
    settings, rows = study
    notes(rows[1][3], "222222")
    pairs = [(rows[0][2], rows[1][3]), (rows[1][2], rows[0][3])]
    staged = stage(spark, settings, pairs)
    accuracy = {os.path.basename(r["path"]): r["accuracy"] for r in staged.metrics.filter("accuracy is not null").collect()}
    assert accuracy[os.path.basename(rows[0][2])] == 1.0 and accuracy[os.path.basename(rows[1][2])] < 1.0
    expert = staged.predictions.filter(F.col("path").endswith(os.path.basename(rows[3][2])))
    assert {r["expert"] for r in expert.collect()} == {S.UNSCORED}  # no pair, so no label
