"""Scoring epochs with any predictor (ML4, UDF4)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from epochwright import schema as S

BATCH = 128  # fixed value: epochs per call of a predictor

Predictor = Callable[[np.ndarray], np.ndarray]


def score_with(
    epochs: DataFrame,
    make_predictor: Callable[[], Predictor],
    keys: list[str],
    batch_size: int = BATCH,
) -> DataFrame:
    """``keys`` + ``pred`` + ``proba`` from a predictor of (n, samples) FLOAT -> (n, 5).

    ``make_predictor`` runs on the worker, once per task, so a model is loaded
    there and reused for all batches of the task. Small fixed batches bound the
    predictor's memory whatever the Arrow batch size. Epochs of a task must be
    equally long (FLT13): another length is an error, never a shifted sample.
    """
    out = T.StructType(
        [epochs.schema[k] for k in keys]
        + [T.StructField("pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))]
    )
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, width = make_predictor(), None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                signal = part.column(n_keys)
                lengths = np.unique(signal.value_lengths().to_numpy(zero_copy_only=False))
                width = lengths[0] if width is None else width
                if signal.null_count or (lengths != width).any():
                    raise ValueError(f"epochs of unequal length: {sorted(set(lengths) | {width})}")
                x = signal.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                proba = np.asarray(predict(x.reshape(part.num_rows, -1)), dtype=float)
                offsets = np.arange(0, proba.size + 1, proba.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:n_keys],
                        pa.array(proba.argmax(axis=1).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(proba.reshape(-1))),
                    ],
                    names=[*keys, "pred", "proba"],
                )

    return epochs.select(*keys, "signal").mapInArrow(run, out)


@dataclass
class PredictorModel:
    """A predictor where the steps expect a fitted model."""

    make_predictor: Callable[[], Predictor]

    def score(self, epochs: DataFrame) -> DataFrame:
        """ML4: the epochs' keys and stage, where there is one, with ``pred`` and ``proba``."""
        kept = [c for c in epochs.columns if c != "signal" and c not in S.FEATURES]
        return score_with(epochs, self.make_predictor, kept)


def require_model_name(name: str, known: list[str]) -> str:
    """FLT17."""
    if name not in known:
        raise ValueError(f"unknown model {name!r}; expected one of {known}")
    return name
