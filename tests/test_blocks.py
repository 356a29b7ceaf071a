import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright.operators import blocks, checks

REC = ["rec"]


def _blocks(spark, signals, block_len):
    rows = [
        (rec, i // block_len, [float(v) for v in x[i : i + block_len]])
        for rec, x in signals.items()
        for i in range(0, len(x), block_len)
    ]
    schema = "rec string, block_idx long, samples array<double>"
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {r: rng.standard_normal(n) * 3 + 1e6 for r, n in (("a", 950), ("b", 1000), ("c", 99))}


def test_statistics_of_a_split_recording(spark, signals):
    got = {r["rec"]: r for r in blocks.block_stats(_blocks(spark, signals, 70), REC).collect()}
    for rec, x in signals.items():
        assert got[rec]["n_samples"] == len(x)
        assert got[rec]["mean"] == pytest.approx(x.mean(), rel=1e-14)
        assert got[rec]["std"] == pytest.approx(x.std(), rel=1e-8)


def test_merged_moments(spark, signals):
    rows = [
        (rec, len(p), float(p.mean()), float(((p - p.mean()) ** 2).sum()))
        for rec, x in signals.items()
        for p in np.split(x, [10, 11, 50])
    ]
    parts = spark.createDataFrame(rows, "rec string, n long, mean double, m2 double").repartition(4)
    for r in blocks.merge_moments(parts, REC).collect():
        x = signals[r["rec"]]
        assert r["n_samples"] == len(x)
        assert (r["mean"], r["std"]) == pytest.approx((x.mean(), x.std()), rel=1e-8)


@pytest.mark.parametrize("block_len", [30, 70, 100, 250, 1000])
def test_slices_equal_array_slices(spark, signals, block_len):
    starts = [0, 1, 69, 70, 100, 333, 850, 899, 900, 950]
    plan = spark.createDataFrame(
        [(r, i, s, block_len, f"{r}{i}") for r in signals for i, s in enumerate(starts)],
        "rec string, plan_idx int, start_sample long, block_len long, tag string",
    )
    got = blocks.slice_blocks(_blocks(spark, signals, block_len), plan, 100, REC).collect()
    assert all(r["tag"] == f"{r['rec']}{r['plan_idx']}" for r in got)
    got = {(r["rec"], r["plan_idx"]): r["samples"] for r in got}
    want = {
        (rec, i): list(x[s : s + 100])
        for rec, x in signals.items()
        for i, s in enumerate(starts)
        if s + 100 <= len(x)
    }
    assert got == want


def test_grid_drops_the_trailing_part(spark):
    recs = spark.createDataFrame([("a", 9500), ("b", 2999), ("c", 3000)], "rec string, n_samples long")
    got = blocks.grid_plan(recs, 3000, REC).orderBy("rec", "epoch_idx").collect()
    assert [(r["rec"], r["epoch_idx"], r["start_sample"]) for r in got] == [
        ("a", 0, 0), ("a", 1, 3000), ("a", 2, 6000), ("c", 0, 0),
    ]
    assert [r["rec"] for r in checks.too_short(recs, 3000, REC).collect()] == ["b"]


def test_cut_epochs(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(19)], "rec string, pos long, v double")
    got = blocks.cut_epochs(df.repartition(4), "pos", "v", 8, REC).orderBy("epoch_idx").collect()
    assert [r["signal"] for r in got] == [list(map(float, range(8))), list(map(float, range(8, 16)))]


def test_normalize_samples(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 5.0)], "rec string, v double"
    )
    got = {(r["rec"], r["v"]): r["z"] for r in blocks.normalize_samples(df, "v", REC).collect()}
    assert got[("a", 1.0)] == pytest.approx(-1.0) and got[("b", 5.0)] == 0.0


def test_moments_in_one_exchange_at_a_large_offset(spark):
    rng = np.random.default_rng(5)
    pieces = {("a", 1): [1e9 + rng.normal(0, 0.5, n) for n in (1000, 1, 37, 4000)], ("b", 2): [rng.normal(-3, 2, 50)]}
    rows = [
        (*rec, len(p), float(p.mean()), float(np.square(p - p.mean()).sum())) for rec, all_ in pieces.items() for p in all_
    ]
    parts = spark.createDataFrame(rows, "subject_id string, night int, n long, mean double, m2 double").repartition(4)
    keys = ["subject_id", "night"]
    merged = blocks.merge_moments(parts, keys)
    for r in merged.collect():
        whole = np.concatenate(pieces[r["subject_id"], r["night"]])
        assert r["n_samples"] == len(whole)
        np.testing.assert_allclose([r["mean"], r["std"]], [whole.mean(), (whole - whole.mean()).std()], rtol=1e-7)
    plan = blocks.merge_moments(parts.coalesce(2), keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
