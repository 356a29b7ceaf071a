"""Per-epoch signal features as one Arrow pass (FN4-FN9).

A Fourier transform has no Spark expression, so epochs travel to Python as
Arrow batches: a batch of equally long epochs becomes one matrix, and every
feature is computed over all of its rows at once. The spectrum is computed once
and shared by the band powers and the entropy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.settings import Settings

_ROWS_AT_ONCE = 128  # bounds the segment matrix whatever the Arrow batch size
_MIN_SEGMENT = 256  # fixed value: shortest Welch segment, unless the epoch is shorter

FEATURE_TYPE = "struct<" + ", ".join(f"{name}: double" for name in S.FEATURES) + ">"
RECORD_TYPE = (
    "struct<signal: array<float>, " + ", ".join(f"{name}: float" for name in S.FEATURES) + ">"
)


def welch(epochs: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """FN4: one-sided power spectral density of each row; (freqs, density)."""
    length = min(epochs.shape[1], max(_MIN_SEGMENT, int(2 * rate)))
    hop = length - length // 2
    segments = sliding_window_view(epochs, length, axis=1)[:, ::hop]
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(length) / length)
    centred = segments - segments.mean(axis=2, keepdims=True)
    spectrum = np.fft.rfft(centred * window, axis=2)
    density = (spectrum.real**2 + spectrum.imag**2).mean(axis=1)
    density /= rate * np.square(window).sum()
    # fold the negative half in; DC and an even length's Nyquist bin have no mirror image
    mirrored = slice(1, -1) if length % 2 == 0 else slice(1, None)
    density[:, mirrored] *= 2.0
    return np.fft.rfftfreq(length, 1.0 / rate), density


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros_like(part), where=whole > 0.0)


def band_shares(freqs: np.ndarray, density: np.ndarray, bands) -> np.ndarray:
    """FN5: power in each [low, high) band over the power in the analysis range."""
    members = [(freqs >= low) & (freqs < high) for low, high in bands]
    analysed = (freqs >= S.ANALYSIS_LOW_HZ) & (freqs <= S.ANALYSIS_HIGH_HZ)
    power = density @ np.array(members, dtype=float).T
    return _ratio(power, np.broadcast_to(density @ analysed[:, None], power.shape))


def spectral_entropy(density: np.ndarray) -> np.ndarray:
    """FN6: Shannon entropy without DC, over the log of the number of positive bins."""
    bins = density[:, 1:]
    shares = _ratio(bins, np.broadcast_to(bins.sum(axis=1, keepdims=True), bins.shape))
    positive = shares > 0.0
    logs = np.log(shares, out=np.zeros_like(shares), where=positive)
    count = positive.sum(axis=1)
    ceiling = np.where(count > 1, np.log(np.maximum(count, 1)), 0.0)
    return _ratio(-(shares * logs).sum(axis=1), ceiling)


def hjorth(epochs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FN7: activity, mobility, complexity from population variances (WIN9 differences)."""
    slope = np.diff(epochs, axis=1)
    activity, slope_var, bend_var = (
        block.var(axis=1) for block in (epochs, slope, np.diff(slope, axis=1))
    )
    mobility = np.sqrt(_ratio(slope_var, activity))
    return activity, mobility, _ratio(np.sqrt(_ratio(bend_var, slope_var)), mobility)


def feature_matrix(epochs: np.ndarray, rate: float, bands) -> np.ndarray:
    """FN9: all ten features, one row per epoch, in store order."""
    out = np.empty((len(epochs), len(S.FEATURES)))
    for start in range(0, len(epochs), _ROWS_AT_ONCE):
        rows = slice(start, start + _ROWS_AT_ONCE)
        block = epochs[rows]
        freqs, density = welch(block, rate)
        rms = np.sqrt(np.square(block).mean(axis=1))
        out[rows] = np.column_stack(
            [band_shares(freqs, density, bands), spectral_entropy(density), *hjorth(block), rms]
        )
    return out


def _by_length(batch: pa.Array):
    """(row numbers, matrix) for each epoch length in an Arrow list batch."""
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        yield np.arange(len(lengths)), values.reshape(len(lengths), lengths[0])
        return
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]


def feature_struct(signal: Column, settings: Settings) -> Column:
    """FN9 for an ARRAY<DOUBLE> column: a struct of ten DOUBLEs."""
    rate, bands = settings.dataset.sample_rate, settings.bands.edges()
    names = S.FEATURES

    @F.arrow_udf(FEATURE_TYPE)
    def features(signal: pa.Array) -> pa.Array:
        table = np.empty((len(signal), len(names)))
        for rows, epochs in _by_length(signal):
            table[rows] = feature_matrix(epochs, rate, bands)
        return pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=names)

    return features(signal.cast("array<double>"))


def epoch_record(samples: Column, mean: Column, std: Column, settings: Settings) -> Column:
    """FN1 + FN9 in one pass: raw samples to the normalized FLOAT signal and its features.

    Features come from the DOUBLE z-score; only the results are narrowed.
    """
    rate, bands = settings.dataset.sample_rate, settings.bands.edges()
    names = S.FEATURES

    @F.arrow_udf(RECORD_TYPE)
    def record(samples: pa.Array, mean: pa.Array, std: pa.Array) -> pa.Array:
        centre = mean.to_numpy(zero_copy_only=False)
        scale = std.to_numpy(zero_copy_only=False) + S.ZSCORE_EPS
        lengths = samples.value_lengths().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        signal = np.empty(offsets[-1], dtype=np.float32)
        table = np.empty((len(samples), len(names)), dtype=np.float32)
        for rows, epochs in _by_length(samples):
            z = (epochs - centre[rows, None]) / scale[rows, None]
            signal[offsets[rows][:, None] + np.arange(z.shape[1])] = z
            table[rows] = feature_matrix(z, rate, bands)
        arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(signal))]
        arrays += [pa.array(column) for column in table.T]
        return pa.StructArray.from_arrays(arrays, names=["signal", *names])

    return record(samples.cast("array<double>"), mean, std)
