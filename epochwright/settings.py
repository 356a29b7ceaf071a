"""Run settings as validated, immutable values."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import Any, Mapping

from epochwright import schema as S


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class PathSettings:
    data_dir: str = "data"
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    models_dir: str = "models"
    reports_dir: str = "reports"

    @property
    def manifest(self) -> str:
        return f"{self.processed_dir}/manifest.csv"

    @property
    def epochs(self) -> str:
        return f"{self.processed_dir}/epochs.parquet"

    @property
    def built(self) -> str:
        return f"{self.processed_dir}/built.parquet"

    @property
    def rejects(self) -> str:
        return f"{self.processed_dir}/rejects.json"

    @property
    def splits(self) -> str:
        return f"{self.processed_dir}/splits.json"

    @property
    def split_table(self) -> str:
        return f"{self.processed_dir}/splits.parquet"

    def anchored(self, base_dir: str) -> "PathSettings":
        """Relative folders placed below ``base_dir``; absolute paths and URIs kept."""

        def place(path: str) -> str:
            if "://" in path or os.path.isabs(path):
                return path
            return os.path.normpath(os.path.join(base_dir, path))

        return PathSettings(**{f.name: place(getattr(self, f.name)) for f in fields(self)})


@dataclass(frozen=True)
class DatasetSettings:
    name: str = "cassette"
    channel: str = "EEG Fpz-Cz"
    sample_rate: int = 100
    epoch_sec: int = 30
    wake_pad_min: float = 30

    def __post_init__(self) -> None:
        _require(self.sample_rate > 0, "sample_rate must be positive")
        _require(self.epoch_sec > 0, "epoch_sec must be positive")
        _require(self.wake_pad_min >= 0, "wake_pad_min must not be negative")

    @property
    def epoch_samples(self) -> int:
        return self.sample_rate * self.epoch_sec

    @property
    def pad_epochs(self) -> int:
        return round(self.wake_pad_min * 60 / self.epoch_sec)


@dataclass(frozen=True)
class BandSettings:
    # fixed values: default band edges in Hz, [low, high)
    delta: tuple[float, float] = (0.5, 4.0)
    theta: tuple[float, float] = (4.0, 8.0)
    alpha: tuple[float, float] = (8.0, 13.0)
    sigma: tuple[float, float] = (11.0, 16.0)
    beta: tuple[float, float] = (16.0, 30.0)

    def __post_init__(self) -> None:
        for name in S.BAND_NAMES:
            low, high = getattr(self, name)
            _require(0 <= low < high, f"band {name}: need 0 <= low < high, got [{low}, {high})")

    def edges(self) -> list[tuple[float, float]]:
        return [tuple(getattr(self, name)) for name in S.BAND_NAMES]


@dataclass(frozen=True)
class SplitSettings:
    seed: int = 42
    val_frac: float = 0.15
    test_frac: float = 0.15

    def __post_init__(self) -> None:
        for name in ("val_frac", "test_frac"):
            _require(0.0 <= getattr(self, name) < 1.0, f"{name} must be in [0, 1)")
        _require(
            self.val_frac + self.test_frac < 1.0,
            "val_frac + test_frac must stay below 1 to leave training data",
        )


@dataclass(frozen=True)
class RawModelSettings:
    batch_size: int = 128
    learning_rate: float = 1e-3
    rounds: int = 30
    patience: int = 6
    class_weights: str | None = "auto"

    def __post_init__(self) -> None:
        _require(self.batch_size > 0, "batch_size must be positive")
        _require(self.learning_rate > 0, "learning_rate must be positive")
        _require(self.rounds > 0, "rounds must be positive")
        _require(self.patience >= 0, "patience must not be negative")
        if self.class_weights is not None and self.class_weights.lower() in {"none", "null", ""}:
            object.__setattr__(self, "class_weights", None)
        _require(self.class_weights in (None, "auto"), "class_weights must be 'auto' or none")


@dataclass(frozen=True)
class TreeSettings:
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 3
    seed: int = 42

    def __post_init__(self) -> None:
        _require(self.rounds > 0, "rounds must be positive")
        _require(self.learning_rate > 0, "learning_rate must be positive")
        _require(self.max_depth > 0, "max_depth must be positive")


@dataclass(frozen=True)
class Settings:
    paths: PathSettings = field(default_factory=PathSettings)
    dataset: DatasetSettings = field(default_factory=DatasetSettings)
    bands: BandSettings = field(default_factory=BandSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    raw_model: RawModelSettings = field(default_factory=RawModelSettings)
    trees: TreeSettings = field(default_factory=TreeSettings)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any], base_dir: str = ".") -> "Settings":
        """Nested plain values to settings; unknown sections or keys are errors."""
        sections = {f.name: f.default_factory for f in fields(cls)}
        unknown = set(values) - set(sections)
        _require(not unknown, f"unknown settings section(s): {sorted(unknown)}")
        built = {}
        for name, kind in sections.items():
            given = values.get(name) or {}
            extra = set(given) - {f.name for f in fields(kind)}
            _require(not extra, f"unknown key(s) in {name}: {sorted(extra)}")
            built[name] = kind(**given)
        built["paths"] = built["paths"].anchored(base_dir)
        return cls(**built)


def load_settings(path: str | None = None) -> Settings:
    """Settings from a JSON file. Only the unnamed default file may be absent."""
    chosen = path or "settings.json"
    if not os.path.exists(chosen):
        if path is not None:
            raise FileNotFoundError(f"settings file not found: {path}")
        return Settings.from_mapping({}, os.getcwd())
    with open(chosen, encoding="utf-8") as handle:
        values = json.load(handle)
    return Settings.from_mapping(values, os.path.dirname(os.path.abspath(chosen)))
