import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright.operators import checks
from epochwright.operators.blocks import merge_moments
from epochwright.plans import derived
from epochwright.sources import edf

FULL = (-100, 100, -32768, 32767)
CHANNEL = "EEG Fpz-Cz"


def _write(path, content):
    derived.write_file(str(path), content)
    return str(path)


def _signal(records, samples, seed=0):
    return np.random.default_rng(seed).integers(-32768, 32767, (records, samples)).astype("<i2")


def _physical(digital, scale=FULL):
    low, high, dmin, dmax = scale
    return (digital.astype(float) - dmin) * (high - low) / (dmax - dmin) + low


@pytest.mark.parametrize("split_bytes, per_block", [(10**9, 1), (700, 1), (700, 3), (150, 2), (5000, 5)])
def test_signal_is_the_same_for_any_split(spark, tmp_path, split_bytes, per_block):
    files = {}
    for i, records in enumerate((12, 7, 1)):
        digital = _signal(records, 100, i)
        other = _signal(records, 30, 9)
        files[f"f{i}-PSG.edf"] = digital
        _write(
            tmp_path / f"f{i}-PSG.edf",
            derived.edf_bytes(1.0, [("EOG", "uV", FULL, other), (CHANNEL, "uV", FULL, digital)]),
        )
    df = edf.read_edf(
        spark, str(tmp_path), "signal", channel=CHANNEL, splitBytes=split_bytes, recordsPerBlock=per_block
    )
    rows = df.collect()
    parts = edf.read_edf(
        spark, str(tmp_path), "moments", channel=CHANNEL, splitBytes=split_bytes, recordsPerBlock=per_block
    )
    stats = {r["path"].split("/")[-1]: r for r in merge_moments(parts, ["path"]).collect()}
    for name, digital in files.items():
        x = _physical(digital)
        assert stats[name]["n_samples"] == x.size
        assert (stats[name]["mean"], stats[name]["std"]) == pytest.approx((x.mean(), x.std()))
        own = sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: r["block_idx"])
        assert [r["block_idx"] for r in own] == list(range(-(-len(digital) // per_block)))
        assert [r["start_sample"] for r in own] == [i * per_block * 100 for i in range(len(own))]
        got = np.concatenate([r["samples"] for r in own])
        np.testing.assert_allclose(got, _physical(digital).reshape(-1), rtol=1e-12, atol=1e-9)
    if split_bytes == 150:
        assert df.rdd.getNumPartitions() > 20


class _Counted:
    """An open file that counts the bytes read from it."""

    def __init__(self, handle, read):
        self.handle, self.done = handle, read

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.handle.close()

    def seek(self, place):
        self.handle.seek(place)

    def read(self, size):
        self.done.append(size)
        return self.handle.read(size)


def _two_files(tmp_path):
    for i in range(2):
        content = [("EOG", "uV", FULL, _signal(400, 50, 7)), (CHANNEL, "uV", FULL, _signal(400, 100, i))]
        _write(tmp_path / f"f{i}-PSG.edf", derived.edf_bytes(1.0, content))


def test_filters_are_pushed_into_the_scan(spark, tmp_path):
    _two_files(tmp_path)
    load = lambda **more: edf.read_edf(
        spark, str(tmp_path), "signal", channel=CHANNEL, splitBytes=9_000, recordsPerBlock=3, **more
    )
    everything = load(pushFilters=True).collect()
    assert len(everything) == 2 * 134
    path = everything[0]["path"]
    cases = [
        (F.col("path") == path, lambda r: r["path"] == path),
        (F.col("path").isin(path, "nowhere"), lambda r: r["path"] == path),
        (F.col("path").endswith("f1-PSG.edf"), lambda r: r["path"].endswith("f1-PSG.edf")),
        (F.col("path").contains("f0"), lambda r: "f0" in r["path"]),
        (F.col("channel") == "EOG", lambda r: False),
        (F.col("block_idx") == 7, lambda r: r["block_idx"] == 7),
        (F.col("block_idx").between(100, 110), lambda r: 100 <= r["block_idx"] <= 110),
        ((F.col("start_sample") > 300) & (F.col("start_sample") < 1200), lambda r: 300 < r["start_sample"] < 1200),
        ((F.col("start_sample") >= 299) & (F.col("start_sample") <= 900), lambda r: 299 <= r["start_sample"] <= 900),
        (F.col("start_sample") > 10**9, lambda r: False),
        (F.col("block_idx") < 0, lambda r: False),
        (F.col("block_idx").isin(3, 5), lambda r: r["block_idx"] in (3, 5)),
        (F.col("path").like("%f_-PSG%") & (F.size("samples") < 300), lambda r: len(r["samples"]) < 300),
    ]
    for condition, wanted in cases:
        got = load(pushFilters=True).filter(condition).collect()
        key = lambda r: (r["path"], r["block_idx"])
        assert sorted(got, key=key) == sorted(filter(wanted, everything), key=key), condition
    header = edf.read_edf(spark, str(tmp_path), "header", pushFilters=True)
    assert [r["channel"] for r in header.filter(F.col("channel") == "EOG").collect()] == ["EOG", "EOG"]


def test_a_frame_without_the_option_may_be_used_twice(spark, tmp_path):
    _two_files(tmp_path)
    signal = edf.read_edf(spark, str(tmp_path), "signal", channel=CHANNEL)
    few = signal.filter("start_sample < 1000")
    assert (few.count(), signal.count(), few.unionByName(signal).count()) == (20, 800, 820)


def test_pushed_filters_show_in_the_plan(spark, tmp_path, capsys):
    _two_files(tmp_path)
    signal = edf.read_edf(spark, str(tmp_path), "signal", channel=CHANNEL, pushFilters=True)
    signal.filter((F.col("path") == "x") & (F.col("start_sample") >= 5)).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(path,x)" in plan and "GreaterThanOrEqual(start_sample,5)" in plan
    assert " Filter" not in plan  # nothing is left for Spark to do


def test_filters_spare_bytes(tmp_path, monkeypatch):
    _two_files(tmp_path)
    counts, real = [], edf._open
    monkeypatch.setattr(edf, "_open", lambda path: _Counted(real(path), counts))

    def volume(*filters):
        counts.clear()
        reader = edf.EdfReader({"path": str(tmp_path), "channel": CHANNEL, "pushfilters": "True"}, "signal")
        assert list(reader.pushFilters(list(filters))) == []
        rows = sum(len(b) for p in reader.partitions() for b in reader.read(p))
        return rows, sum(counts)

    all_rows, all_bytes = volume()
    name = edf._list_files(str(tmp_path), "*.edf")[0][0]
    one_rows, one_bytes = volume(edf.EqualTo(("path",), name))
    few_rows, few_bytes = volume(edf.LessThan(("start_sample",), 1000))
    assert (all_rows, one_rows, few_rows) == (800, 400, 20)
    assert one_bytes * 2 == all_bytes
    assert few_bytes == all_bytes - 780 * 2 * 150  # headers, and ten records of each file


@pytest.mark.parametrize("unit, factor", [("uV", 1.0), ("mV", 1e3), ("V", 1e6)])
def test_units(spark, tmp_path, unit, factor):
    digital = _signal(2, 10)
    path = _write(tmp_path / "u.edf", derived.edf_bytes(1.0, [(CHANNEL, unit, (-1, 1, -32768, 32767), digital)]))
    rows = edf.read_edf(spark, path, "signal", channel=CHANNEL).orderBy("block_idx").collect()
    want = _physical(digital, (-1, 1, -32768, 32767)).reshape(-1) * factor
    np.testing.assert_allclose(np.concatenate([r["samples"] for r in rows]), want)


def test_headers_and_checks(spark, tmp_path):
    _write(tmp_path / "a.edf", derived.edf_bytes(30.0, [(CHANNEL, "uV", FULL, _signal(4, 3000))]))
    _write(tmp_path / "b.edf", derived.edf_bytes(1.0, [(CHANNEL, "uV", FULL, _signal(4, 200))]))
    _write(tmp_path / "c.edf", derived.edf_bytes(1.0, [("EOG", "uV", FULL, _signal(4, 100))]))
    headers = edf.read_edf(spark, str(tmp_path), "header", recordsPerBlock=2).cache()
    got = {r["path"][-5]: (r["channel"], r["sfreq"], r["n_samples"], r["block_len"]) for r in headers.collect()}
    assert got == {
        "a": (CHANNEL, 100.0, 12000, 6000), "b": (CHANNEL, 200.0, 800, 400), "c": ("EOG", 100.0, 400, 200),
    }
    wrong = checks.wrong_rate(headers, CHANNEL, 100).collect()
    assert [(r["path"][-5], r["sample_rate"]) for r in wrong] == [("b", 200)]
    absent = checks.missing_channel(headers, CHANNEL)
    assert [(r["path"][-5], r["available"]) for r in absent.collect()] == [("c", ["EOG"])]
    with pytest.raises(ValueError, match="no channel.*EOG"):
        checks.raise_on(absent, "no channel")


def test_unknown_record_count_comes_from_the_size(spark, tmp_path):
    content = bytearray(derived.edf_bytes(1.0, [(CHANNEL, "uV", FULL, _signal(5, 100))]))
    content[236:244] = b"-1      "
    path = _write(tmp_path / "open.edf", bytes(content))
    assert edf.read_edf(spark, path, "header").first()["n_samples"] == 500


def test_annotations(spark, tmp_path):
    entries = [(0, 60, "Sleep stage W"), (60, 30, "Sleep stage 1"), (90.5, 0, "Lights off"), (150, 30, "Sleep stage R")]
    path = _write(tmp_path / "n.edf", derived.edf_bytes(0, [], entries))
    rows = edf.read_edf(spark, path, "annotations").orderBy("ann_no").collect()
    assert [(r["onset"], r["duration"], r["description"]) for r in rows] == entries


def test_annotation_bytes():
    raw = b"+0\x14\x14\x00+1.5\x152\x14one\x14two\x14\x00+3\x14no duration\x14\x00\x00\x00"
    assert list(edf.parse_annotations(raw)) == [(1.5, 2.0, "one"), (1.5, 2.0, "two"), (3.0, 0.0, "no duration")]


def test_errors(spark, tmp_path):
    bad = _write(tmp_path / "bad.edf", b"not a recording")
    with pytest.raises(Exception, match="could not read .*bad.edf"):
        edf.read_edf(spark, bad, "header").collect()
    good = _write(tmp_path / "good.edf", derived.edf_bytes(1.0, [("EOG", "uV", FULL, _signal(2, 10))]))
    with pytest.raises(Exception, match="available.*EOG"):
        edf.read_edf(spark, good, "signal", channel=CHANNEL).collect()
    with pytest.raises(Exception, match="no such file"):
        edf.read_edf(spark, str(tmp_path / "absent"), "header").collect()
    with pytest.raises(Exception, match="unknown mode"):
        edf.read_edf(spark, good, "everything").collect()


def test_slices_read_from_files(spark, tmp_path):
    """Any order of rows, gaps, overlaps, several files, epochs across records."""
    rng = np.random.default_rng(8)
    signals, rows = {}, []
    for i in range(3):
        digital = _signal(40, 64, i)
        path = str(tmp_path / f"s{i}.edf")
        _write(path, derived.edf_bytes(0.64, [("EOG", "uV", FULL, digital[:, :8]), (CHANNEL, "uV", FULL, digital)]))
        signals[path] = _physical(digital).reshape(-1)
        starts = rng.integers(0, 40 * 64 - 100 + 1, 120).tolist() + [0, 40 * 64 - 100]
        rows += [(path, int(s), f"tag{s}") for s in starts]
    plan = spark.createDataFrame(rows, "path string, start_sample long, tag string").repartition(5)
    got = edf.read_slices(plan, CHANNEL, 100).collect()
    assert sorted((r["path"], r["start_sample"], r["tag"]) for r in got) == sorted(rows)
    for r in got:
        want = signals[r["path"]][r["start_sample"] : r["start_sample"] + 100]
        np.testing.assert_allclose(r["samples"], want, rtol=1e-12, atol=1e-9)
