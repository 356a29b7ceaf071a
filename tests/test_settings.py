import json

import pytest

from epochwright.settings import (
    BandSettings,
    DatasetSettings,
    RawModelSettings,
    Settings,
    SplitSettings,
    load_settings,
)


def test_defaults_and_derived_values():
    settings = Settings()
    assert settings.dataset.epoch_samples == 3000
    assert settings.dataset.pad_epochs == 60
    assert settings.paths.epochs.endswith("processed/epochs.parquet")


@pytest.mark.parametrize("band", [(4.0, 0.5), (3.0, 3.0), (-1.0, 4.0)])
def test_bad_band(band):
    with pytest.raises(ValueError, match="delta"):
        BandSettings(delta=band)


@pytest.mark.parametrize("val, test", [(0.5, 0.5), (0.9, 0.2), (1.0, 0.0), (-0.1, 0.1)])
def test_bad_fractions(val, test):
    with pytest.raises(ValueError):
        SplitSettings(val_frac=val, test_frac=test)


def test_zero_fraction_is_allowed_here():
    assert SplitSettings(val_frac=0.0).val_frac == 0.0


@pytest.mark.parametrize("field", [{"sample_rate": 0}, {"epoch_sec": -1}, {"wake_pad_min": -1}])
def test_bad_dataset(field):
    with pytest.raises(ValueError):
        DatasetSettings(**field)


@pytest.mark.parametrize("value", ["none", "NULL", "", None])
def test_class_weights_off(value):
    assert RawModelSettings(class_weights=value).class_weights is None


def test_class_weights_unknown():
    with pytest.raises(ValueError):
        RawModelSettings(class_weights="heavy")


def test_unknown_keys():
    with pytest.raises(ValueError, match="unknown"):
        Settings.from_mapping({"dataset": {"chanel": "x"}})
    with pytest.raises(ValueError, match="unknown"):
        Settings.from_mapping({"data": {}})


def test_load_anchors_relative_paths(tmp_path):
    file = tmp_path / "run.json"
    file.write_text(json.dumps({"paths": {"raw_dir": "raw", "models_dir": "/abs/models"}}))
    paths = load_settings(str(file)).paths
    assert paths.raw_dir == str(tmp_path / "raw")
    assert paths.models_dir == "/abs/models"


def test_named_file_must_exist(tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        load_settings(str(tmp_path / "absent.json"))
    monkeypatch.chdir(tmp_path)
    assert load_settings().paths.models_dir == str(tmp_path / "models")
