"""Boosted trees and the raw-signal network against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwright import schema as S
from epochwright.models import boosting
from epochwright.models.network import Adam, Shape
from epochwright.models.raw_signal import RawModel, macro_f1, train_raw
from epochwright.models.trees import TreeModel, portable_score, train_trees
from epochwright.operators.agreement import scorer_parity
from epochwright.settings import RawModelSettings, TreeSettings

EPOCH = [*S.REC, "epoch_idx"]
EPOCHS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("night", T.IntegerType()),
        T.StructField("epoch_idx", T.IntegerType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("signal", T.ArrayType(T.FloatType())),
    ]
    + [T.StructField(n, T.FloatType()) for n in S.FEATURES]
)


def epochs(spark, n=240, seed=1, samples=8, stages=5, noise=0.6):
    """Stages that features and signal tell apart, with noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        stage = int(rng.integers(0, stages) if i % 3 else 0)  # stage 0 is frequent
        features = rng.normal(0, noise, len(S.FEATURES))
        features[stage % 4] += 1.0
        features[4] += stage * (1 if features[5] > 0 else -1)
        signal = rng.normal(0, noise, samples)
        signal[stage] += 2.0
        rows.append((f"SC{i % 5:02d}", 1, i, stage, signal.tolist(), *features.tolist()))
    return spark.createDataFrame(rows, EPOCHS).repartition(3)


def columns(df):
    rows = df.orderBy("epoch_idx").collect()
    values = np.array([[r[f] for f in S.FEATURES] for r in rows], dtype=float)
    return values, np.array([r["stage"] for r in rows])


def brute_round(raw, values, label, weight, edges, depth, rate):
    """One round by trying every cut of every feature on the rows themselves."""
    k = raw.shape[1]
    p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
    added, leaves = np.zeros_like(raw), []
    for c in range(k):
        r = (label == c) - p[:, c]
        groups = [np.arange(len(label))]
        for _ in range(depth):
            parted = []
            for at in groups:
                best = (1e-9, None)
                for f, cuts in enumerate(edges):
                    for cut in cuts:
                        left = values[at, f] <= cut
                        wl, wr = weight[at][left].sum(), weight[at][~left].sum()
                        if wl > 0 and wr > 0:
                            gl, gr = (weight[at] * r[at])[left].sum(), (weight[at] * r[at])[~left].sum()
                            gain = wl * wr / (wl + wr) * (gl / wl - gr / wr) ** 2
                            if gain > best[0] + 1e-7:
                                best = (gain, left)
                left = best[1] if best[1] is not None else np.ones(len(at), dtype=bool)
                parted += [at[left], at[~left]]
            groups = parted
        for at in groups:
            h = (weight[at] * np.abs(r[at]) * (1 - np.abs(r[at]))).sum()
            value = rate * (k - 1) / k * (weight[at] * r[at]).sum() / h if len(at) and h > 0 else 0.0
            added[at, c] = value
            leaves.append(value)
    return raw + added, leaves


def test_trees_equal_brute_force(spark):
    df = epochs(spark, 150)
    model = train_trees(df, TreeSettings(rounds=3, max_depth=2, learning_rate=0.3))
    values, stage = columns(df)
    counts = np.bincount(stage, minlength=5)
    weight = (len(stage) / (5 * counts))[stage]
    raw, want = np.tile(np.log(np.ones(5) / 5), (len(stage), 1)), []
    for _ in range(3):
        raw, leaves = brute_round(raw, values, stage, weight, model.trees.edges, 2, 0.3)
        want.append(leaves)
    np.testing.assert_allclose(model.trees.value.reshape(3, -1), want, rtol=1e-4, atol=1e-5)
    got = model.score(df).orderBy("epoch_idx").collect()
    proba = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
    np.testing.assert_allclose([r["proba"] for r in got], proba, rtol=1e-4, atol=1e-6)
    assert "signal" not in got[0] and abs(sum(got[0]["proba"]) - 1) < 1e-12


def test_spread_rows_give_the_same_trees(spark, monkeypatch):
    df = epochs(spark, 120)
    one = train_trees(df, TreeSettings(rounds=5)).trees
    monkeypatch.setattr(boosting.fit, "__defaults__", (0,))
    monkeypatch.setattr(boosting, "RENEW", 2)  # scores are written again twice
    monkeypatch.setattr(boosting, "_FEW_TASKS", 2)  # and sums are added in steps
    spread = train_trees(df.repartition(5), TreeSettings(rounds=5)).trees
    for name in ("feature", "cut", "value"):
        assert np.array_equal(getattr(one, name), getattr(spread, name))


def test_trees_are_no_worse_than_one_against_rest(spark):
    train, test = epochs(spark, 600, 1), epochs(spark, 400, 2)
    ours = macro_f1(train_trees(train, TreeSettings(rounds=15, learning_rate=0.2)).score(test))
    vector = VectorAssembler(inputCols=S.FEATURES, outputCol="features")
    label = F.col("stage").cast("double").alias("label")
    rows = vector.transform(train).select(label, "features").coalesce(2).persist()
    trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.2, seed=1)
    fitted = OneVsRest(classifier=trees).fit(rows)
    theirs = fitted.transform(vector.transform(test)).withColumn("pred", F.col("prediction").cast("int"))
    assert ours >= macro_f1(theirs.select(*EPOCH, "stage", "pred")) - 0.02 and ours > 0.6


def test_saved_trees_and_column_expressions_score_alike(spark, tmp_path):
    df = epochs(spark, 200, stages=4)  # stage 4 never occurs
    model = train_trees(df, TreeSettings(rounds=12))
    model.save(str(tmp_path))
    loaded = TreeModel.load(spark, str(tmp_path))
    assert loaded.classes == [0, 1, 2, 3]
    scored = model.score(df).collect()
    assert {r["proba"][4] for r in scored} == {0.0}
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(loaded.score(df).collect()) == key(scored)
    parity = scorer_parity(loaded.score(df), portable_score(loaded, df), EPOCH).first()
    assert parity["n_epochs"] == 200 and parity["label_diffs"] == 0 and parity["max_gap"] <= 1e-9
    plan = portable_score(loaded, df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # a scorer that is off is found out
    loaded.trees.value[0, 1, :] += 3.0
    off = scorer_parity(loaded.score(df), portable_score(model, df), EPOCH).first()
    assert off["max_gap"] > 0.1


def test_equal_features_and_one_stage(spark):
    df = epochs(spark, 40).withColumn("stage", F.lit(2))
    assert {r["pred"] for r in train_trees(df, TreeSettings(rounds=2)).score(df).collect()} == {2}
    same = epochs(spark, 40)
    for f in S.FEATURES:
        same = same.withColumn(f, F.lit(1.0).cast("float"))
    assert len({tuple(r["proba"]) for r in train_trees(same, TreeSettings(rounds=2)).score(same).collect()}) == 1
    with pytest.raises(ValueError, match="no training rows"):
        train_trees(df.limit(0), TreeSettings(rounds=1))


def test_gradient():
    rng = np.random.default_rng(2)
    shape = Shape(6, 4, 3)
    flat = shape.start(1) + 0.1 * rng.normal(size=shape.size)
    x, y, w = rng.normal(size=(7, 6)), rng.integers(0, 3, 7), rng.uniform(0.2, 3, 7)
    _, gradient = shape.gradient(flat, x, y, w)
    for i in range(shape.size):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (shape.gradient(up, x, y, w)[0] - shape.gradient(down, x, y, w)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5


def test_adam_goes_downhill():
    state = Adam.at(np.array([5.0, -3.0]))
    for _ in range(2000):
        state.step(2 * state.weights, 0.01)
    assert np.abs(state.weights).max() < 0.05


def test_raw_model_learns_and_settings_act(spark, tmp_path):
    train, val = epochs(spark, 600, 1), epochs(spark, 200, 2)
    fit = lambda **more: train_raw(
        train, val, RawModelSettings(**{"rounds": 12, "batch_size": 16, "learning_rate": 0.01, **more}), 8
    )
    model = fit()
    assert [h["round"] for h in model.history] == list(range(1, len(model.history) + 1))
    assert model.history[-1]["loss"] < model.history[0]["loss"]
    reached = macro_f1(model.score(val))
    assert reached > 0.7 and max(h["macro_f1"] for h in model.history) == pytest.approx(reached)
    slower, bigger, unweighted = fit(learning_rate=0.001, rounds=1), fit(batch_size=64, rounds=1), fit(class_weights=None, rounds=1)
    base = fit(rounds=1)
    for other in (slower, bigger, unweighted):
        assert not np.allclose(base.weights, other.weights)
    assert np.array_equal(base.weights, fit(rounds=1).weights)
    model.save(str(tmp_path))
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(RawModel.load(spark, str(tmp_path)).score(val).collect()) == key(model.score(val).collect())


def test_rare_stages_weigh_more(spark):
    """With weights in the loss, no row is left out and a rare stage is found as well as a frequent one."""
    train = epochs(spark, 500, 3, noise=1.2).filter("stage = 0 or (stage = 1 and epoch_idx % 8 = 1)")
    settings = lambda w: RawModelSettings(rounds=20, patience=20, batch_size=16, learning_rate=0.01, class_weights=w)
    recall = {}
    for weights in ("auto", None):
        scored = train_raw(train, train, settings(weights), 8).score(train)
        recall[weights] = scored.filter("stage = 1").agg(F.avg((F.col("pred") == 1).cast("double"))).first()[0]
    assert recall["auto"] > recall[None]


def test_early_stopping_keeps_the_best_round(spark):
    train, val = epochs(spark, 200, 1), epochs(spark, 100, 2)
    model = train_raw(train, val, RawModelSettings(rounds=30, patience=2, batch_size=8, learning_rate=0.2), 8)
    scores = [h["macro_f1"] for h in model.history]
    assert len(scores) < 30 and macro_f1(model.score(val)) == pytest.approx(max(scores))
    with pytest.raises(ValueError, match="does not divide"):
        train_raw(train, val, RawModelSettings(rounds=1), 8, factor=3)
