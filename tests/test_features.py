import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions import spectral
from epochwright.functions.spectral import epoch_record, feature_struct
from epochwright.settings import Settings

SETTINGS = Settings()
T = np.arange(3000) / 100.0


def _features(spark, signals):
    rows = [(name, [float(v) for v in x]) for name, x in signals.items()]
    df = spark.createDataFrame(rows, "id string, signal array<double>").repartition(3)
    out = df.select("id", feature_struct(F.col("signal"), SETTINGS).alias("f")).collect()
    return {r["id"]: r["f"].asDict() for r in out}


@pytest.fixture(scope="module")
def known(spark):
    signals = {f"sine{hz}": np.sin(2 * np.pi * hz * T) for hz in (1, 2, 10, 20)}
    signals["noise"] = np.random.default_rng(0).standard_normal(3000)
    signals["flat"] = np.ones(3000)
    return _features(spark, signals), signals


def test_sine_power_lies_in_its_band(known):
    got, _ = known
    assert got["sine10"]["feat_bp_alpha"] > 0.5
    for hz, band in ((1, "delta"), (2, "delta"), (20, "beta")):
        powers = {b: got[f"sine{hz}"][f"feat_bp_{b}"] for b in S.BAND_NAMES}
        assert max(powers, key=powers.get) == band


def test_constant_signal_yields_zeros(known):
    got, _ = known
    flat = got["flat"]
    assert flat.pop("feat_rms") == 1.0
    assert set(flat.values()) == {0.0}


def test_entropy_separates_noise_from_a_tone(known):
    got, _ = known
    assert got["noise"]["feat_spec_entropy"] > 0.8
    assert got["sine10"]["feat_spec_entropy"] < 0.3


def test_hjorth(known):
    got, signals = known
    assert got["noise"]["feat_hjorth_activity"] == pytest.approx(np.var(signals["noise"]), rel=1e-12)
    assert got["sine2"]["feat_hjorth_complexity"] == pytest.approx(1.0, abs=0.05)
    assert got["sine20"]["feat_hjorth_mobility"] > got["sine2"]["feat_hjorth_mobility"]


def _welch_by_definition(x, rate):
    """Segment by segment, bin by bin, straight from the definition."""
    n = min(len(x), max(256, 2 * rate))
    hop = n - n // 2
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)]
    scale = rate * sum(w * w for w in window)
    segments = [x[i : i + n] for i in range(0, len(x) - n + 1, hop)]
    power = np.zeros(n // 2 + 1)
    for segment in segments:
        v = (segment - np.mean(segment)) * window
        for b in range(n // 2 + 1):
            angle = 2 * np.pi * b * np.arange(n) / n
            p = (np.sum(v * np.cos(angle)) ** 2 + np.sum(v * np.sin(angle)) ** 2) / scale
            mirrored = 0 < b and not (n % 2 == 0 and b == n // 2)
            power[b] += p * (2 if mirrored else 1) / len(segments)
    return np.arange(n // 2 + 1) * rate / n, power


@pytest.mark.parametrize("length, rate", [(3000, 100), (700, 100), (64, 100), (65, 100), (900, 200)])
def test_welch_against_its_definition(length, rate):
    x = np.random.default_rng(length).standard_normal(length)
    freqs, density = spectral.welch(x[None, :], rate)
    want_freqs, want = _welch_by_definition(x, rate)
    np.testing.assert_allclose(freqs, want_freqs)
    np.testing.assert_allclose(density[0], want, rtol=1e-9, atol=1e-15)


def test_mixed_lengths_in_one_batch(spark):
    rng = np.random.default_rng(4)
    signals = {f"s{i}": rng.standard_normal(300 + 100 * (i % 3)) for i in range(9)}
    got = _features(spark, signals)
    for name, x in signals.items():
        want = spectral.feature_matrix(x[None, :], 100, SETTINGS.bands.edges())[0]
        np.testing.assert_allclose(list(got[name].values()), want, rtol=1e-12)


def test_record_is_normalized_and_narrowed(spark):
    x = np.random.default_rng(5).standard_normal(3000) * 12.5 + 3.0
    df = spark.createDataFrame(
        [([float(v) for v in x], 3.0, 12.5)], "samples array<double>, mean double, std double"
    )
    record = epoch_record(F.col("samples"), F.col("mean"), F.col("std"), SETTINGS)
    got = df.select(record.alias("r")).first()["r"]
    z = (x - 3.0) / (12.5 + 1e-8)
    np.testing.assert_array_equal(np.float32(got["signal"]), z.astype(np.float32))
    want = spectral.feature_matrix(z[None, :], 100, SETTINGS.bands.edges())[0]
    np.testing.assert_allclose([got[n] for n in S.FEATURES], want.astype(np.float32), rtol=1e-6)
