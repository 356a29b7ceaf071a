import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwright.operators import blocks, planning
from epochwright.settings import DatasetSettings

REC = ["rec"]
W, S1, S2, R, UNK = (f"Sleep stage {c}" for c in "W12R?")


def _plan(spark, rows, n_samples, trimmed=False, **dataset):
    notes = spark.createDataFrame(
        [("r", i, float(o), float(d), t) for i, (o, d, t) in enumerate(rows)],
        "rec string, ann_idx int, onset double, duration double, description string",
    )
    recs = spark.createDataFrame([("r", n_samples)], "rec string, n_samples long")
    settings = DatasetSettings(**dataset)
    if trimmed:
        plan = planning.plan_epochs(notes, recs, settings, REC).orderBy("epoch_idx")
        return [(r["epoch_idx"], r["plan_idx"], r["start_sample"], r["stage"]) for r in plan.collect()]
    runs = planning.plan_runs(notes, recs, settings, REC)
    rows = planning.expand_runs(runs, settings, REC).orderBy("plan_idx").collect()
    assert [r["plan_idx"] for r in rows] == list(range(len(rows)))
    return [(r["start_sample"], r["stage"]) for r in rows]


def test_expand(spark):
    got = _plan(spark, [(0, 90, W), (90, 60, S2)], 20000)
    assert got == [(0, 0), (3000, 0), (6000, 0), (9000, 2), (12000, 2)]


def test_drop_and_range(spark):
    assert _plan(spark, [(0, 30, UNK), (30, 30, S2), (60, 30, S2)], 6000) == [(3000, 2)]


def test_count_rounds_half_to_even(spark):
    assert len(_plan(spark, [(0, 75, S2)], 20000)) == 2
    assert _plan(spark, [(0, 10, S2)], 20000) == []


def test_overlaps_are_kept_in_annotation_order(spark):
    got = _plan(spark, [(0, 60, S1), (0, 30, S2)], 20000)
    assert got == [(0, 1), (3000, 1), (0, 2)]


def test_start_before_zero_is_dropped(spark):
    assert _plan(spark, [(-45, 90, S1)], 20000) == [(1500, 1)]


def test_huge_duration_is_clipped(spark):
    assert len(_plan(spark, [(0, 1e13, S2)], 9000)) == 3


@pytest.mark.parametrize("onset", [0.005, 12.345, 0.015, 29.995, -0.005, -30.004, -30.006])
def test_starts_round_like_python(spark, onset):
    for n_samples in (14999, 15000, 15001):
        starts = [round((onset + k * 30) * 100) for k in range(9)]
        want = [s for s in starts if 0 <= s <= n_samples - 3000]
        assert [s for s, _ in _plan(spark, [(onset, 270, S1)], n_samples)] == want


def test_trim_keeps_a_pad_on_each_side(spark):
    rows = [(0, 3000, W), (3000, 300, S2), (3300, 3000, W)]
    got = _plan(spark, rows, 10**7, trimmed=True, wake_pad_min=30)
    assert len(got) == 130
    assert [g[0] for g in got] == list(range(130))
    assert got[0][1] == 40 and [g[3] for g in got].count(2) == 10


def test_trim_without_sleep_keeps_everything(spark):
    assert len(_plan(spark, [(0, 1500, W)], 10**7, trimmed=True)) == 50


def test_trim_pad_zero(spark):
    rows = [(0, 150, W), (150, 90, "Sleep stage 3"), (240, 150, W)]
    got = _plan(spark, rows, 10**7, trimmed=True, wake_pad_min=0)
    assert [g[3] for g in got] == [3, 3, 3]


def test_trim_keeps_wake_between_sleep(spark):
    rows = [(0, 30, S1), (30, 300, W), (330, 30, R)]
    assert len(_plan(spark, rows, 10**7, trimmed=True, wake_pad_min=0)) == 12


def test_many_recordings_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    texts = [W, S1, S2, R, UNK]
    stage = {W: 0, S1: 1, S2: 2, R: 4, UNK: None}
    notes, recs, want = [], [], set()
    for r in range(6):
        n_samples = int(rng.integers(20_000, 200_000))
        recs.append((f"r{r}", n_samples))
        plan = []
        for i in range(40):
            onset, duration = float(rng.uniform(-60, 2000)), float(rng.uniform(0, 200))
            text = texts[rng.integers(len(texts))]
            notes.append((f"r{r}", i, onset, duration, text))
            if stage[text] is None:
                continue
            for k in range(round(duration / 30)):
                start = round((onset + k * 30) * 100)
                if 0 <= start and start + 3000 <= n_samples:
                    plan.append((start, stage[text]))
        asleep = [i for i, p in enumerate(plan) if p[1] != 0]
        lo, hi = (asleep[0] - 2, asleep[-1] + 2) if asleep else (0, len(plan))
        kept = [p for i, p in enumerate(plan) if lo <= i <= hi]
        want |= {(f"r{r}", i, *p) for i, p in enumerate(kept)}
    notes = spark.createDataFrame(
        notes, "rec string, ann_idx int, onset double, duration double, description string"
    ).repartition(5)
    recs = spark.createDataFrame(recs, "rec string, n_samples long")
    got = planning.plan_epochs(notes, recs, DatasetSettings(wake_pad_min=1), REC).collect()
    assert {(r["rec"], r["epoch_idx"], r["start_sample"], r["stage"]) for r in got} == want
    assert len(got) == len(want)


def _grid(spark, rows, n_epochs):
    notes = spark.createDataFrame(
        [("r", i, float(o), float(d), t) for i, (o, d, t) in enumerate(rows)],
        "rec string, ann_idx int, onset double, duration double, description string",
    )
    recs = spark.createDataFrame([("r", n_epochs)], "rec string, n_epochs int")
    grid = planning.expert_grid(notes, recs, DatasetSettings(), REC).orderBy("epoch_idx")
    return [r["expert"] for r in grid.collect()]


def test_grid(spark):
    rows = [(0, 60, W), (60, 30, S1), (90, 60, UNK), (150, 30, R)]
    assert _grid(spark, rows, 8) == [0, 0, 1, -1, -1, 4, -1, -1]


def test_grid_clips(spark):
    assert _grid(spark, [(0, 300, S2)], 3) == [2, 2, 2]
    assert _grid(spark, [(-60, 90, S2)], 3) == [2, -1, -1]


def test_grid_later_annotation_wins(spark):
    assert _grid(spark, [(0, 90, S2), (30, 30, R)], 4) == [2, 4, 2, -1]


def test_grid_without_annotations(spark):
    assert _grid(spark, [(0, 30, UNK)], 2) == [-1, -1]


def test_grid_of_a_thousand_nested_annotations(spark):
    rng = np.random.default_rng(8)
    rows = [(30.0 * i, 30.0 * (2000 - 2 * i), S2 if i % 2 else R) for i in range(1000)]  # each inside the one before
    rows += [(30.0 * int(a), 30.0 * int(n), W) for a, n in zip(rng.integers(0, 9000, 300), rng.integers(1, 900, 300))]
    n_epochs = 9000  # three stretches
    want = np.full(n_epochs, -1)
    for onset, duration, text in rows:
        want[int(onset / 30) : int((onset + duration) / 30)] = {S2: 2, R: 4, W: 0}[text]
    assert _grid(spark, rows, n_epochs) == want.tolist()


def test_pieces_do_not_grow_with_depth(spark):
    recs = spark.createDataFrame([("a", 1, 5000)], "subject_id string, night int, n_epochs long")
    rows = [("a", 1, 0, 4999 - i % 3, i, i % 5) for i in range(5000)]
    deep = spark.createDataFrame(rows, "subject_id string, night int, from long, to long, ann_idx long, stage int")
    stages = planning.winning_stages(deep, recs).orderBy("stretch").collect()
    assert [len(r["stages"]) for r in stages] == [4096, 904]
    assert stages[0]["stages"] == [4] * 4096 and stages[1]["stages"][-3:] == [4, 4, 3]


@pytest.mark.parametrize("first, last", [(0, 0), (0, 4095), (1, 4094), (7, 8), (5, 5), (100, 3001)])
def test_aligned_pieces_cover_once(spark, first, last):
    pieces = spark.range(1).select(planning._aligned_pieces(F.lit(first), F.lit(last)).alias("p")).first()["p"]
    covered = sorted(e for p in pieces for e in range(p["first"], p["last"] + 1))
    assert covered == list(range(first, last + 1)) and len(pieces) <= 24


def test_epochs_with_their_expert_are_not_broadcast(spark, tmp_path):
    notes = spark.createDataFrame(
        [("a", 0, 30.0, 60.0, W), ("b", 0, 0.0, 30.0, R), (None, 0, 0.0, 30.0, R)],
        "rec string, ann_idx int, onset double, duration double, description string",
    )
    recs = spark.createDataFrame([("a", 50_000), ("b", 2), (None, 1)], "rec string, n_epochs int")
    recs.write.parquet(str(tmp_path / "recs"))  # of a written table the planner knows the size
    recs = spark.read.parquet(str(tmp_path / "recs"))
    grid = planning.expert_grid(notes, recs, DatasetSettings(), REC)
    few = recs.withColumn("n_samples", F.col("n_epochs").cast("long") * 10)
    predicted = blocks.grid_plan(few, 10, REC).select("rec", "epoch_idx", (F.col("epoch_idx") % 5).alias("pred"))
    joined = planning.with_expert(predicted, grid, [*REC, "epoch_idx"])
    # three recordings look small, their epochs are not
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert next(line for line in plan.splitlines() if "Join" in line).strip("+- ").startswith("SortMergeJoin")
    got = {(r["rec"], r["epoch_idx"]): (r["pred"], r["expert"]) for r in joined.collect()}
    assert len(got) == 50_002 and got["a", 1] == (1, 0) and got["a", 49_999] == (4, -1) and got["b", 0] == (0, 4)
