import json
import math
import random

import pytest
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.operators import agreement as agree


def _count(spark, true, pred):
    df = spark.createDataFrame(list(zip(true, pred)), "stage int, pred int")
    return agree.agreement(df, "stage", "pred")


def _by_definition(true, pred):
    labels = sorted(set(true) | set(pred))
    f1 = []
    for c in labels:
        tp = sum(t == p == c for t, p in zip(true, pred))
        total = true.count(c) + pred.count(c)
        f1.append(2 * tp / total if total else 0.0)
    n = len(true)
    po = sum(t == p for t, p in zip(true, pred)) / n
    pe = sum(true.count(c) * pred.count(c) for c in labels) / n**2
    return po, sum(f1) / len(f1), (po - pe) / (1 - pe) if pe != 1 else math.nan


def test_perfect(spark):
    stages = [0, 1, 2, 3, 4, 0, 1, 2]
    row = agree.headline(_count(spark, stages, stages)).first()
    assert (row["accuracy"], row["macro_f1"], row["cohen_kappa"]) == (1.0, 1.0, 1.0)


def test_per_class_and_matrix(spark):
    counted = _count(spark, [0, 0, 1, 2, 2, 3, 4], [0, 1, 1, 2, 2, 3, 0])
    wake = agree.per_class(counted).filter("stage = 0").first()
    assert (wake["support"], wake["recall"], wake["precision"]) == (2, 0.5, 0.5)
    cells = {(r["true"], r["pred"]): r["n"] for r in agree.confusion(counted).collect()}
    assert len(cells) == 25 and sum(cells.values()) == 7 and cells[(4, 0)] == 1
    wide = {r["true"]: r for r in agree.confusion_wide(counted).collect()}
    assert wide[4]["pred_W"] == 1 and wide[2]["pred_N2"] == 2


def test_constant_prediction(spark):
    row = agree.headline(_count(spark, [0, 1, 2, 3, 4] * 4, [0] * 20)).first()
    assert row["accuracy"] == pytest.approx(0.2) and row["cohen_kappa"] == pytest.approx(0.0)


def test_macro_f1_covers_present_classes_only(spark):
    row = agree.headline(_count(spark, [0, 0, 2], [0, 2, 2])).first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_one_constant_class_has_no_kappa(spark):
    row = agree.headline(_count(spark, [2, 2], [2, 2])).first()
    assert math.isnan(row["cohen_kappa"]) and row["accuracy"] == 1.0


def test_empty_row_shares_are_zero(spark):
    shares = agree.confusion(_count(spark, [0, 0], [0, 1])).collect()
    assert {r["row_share"] for r in shares if r["true"] == 3} == {0.0}
    assert {r["row_share"] for r in shares if r["true"] == 0} == {0.0, 0.5}


def test_no_rows(spark):
    row = agree.headline(_count(spark, [], [])).first()
    assert (row["n_epochs"], row["accuracy"], row["macro_f1"]) == (0, 0.0, 0.0)


def test_labels_outside_the_domain(spark):
    counted = _count(spark, [0, 2, -1, 7, 2], [0, 7, -1, 0, None])
    row = counted.first()
    assert row["n_epochs"] == 5 and row["accuracy"] == pytest.approx(0.4)
    assert sum(map(sum, row["cm"])) == 1
    n2 = row["scores"][2]
    assert n2["support"] == 2 and n2["recall"] == 0.0
    assert row["scores"][0]["precision"] == 0.5


def test_groups_against_definition(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(7), rng.randrange(5), rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, stage int, pred int").repartition(6)
    got = agree.headline(agree.agreement(df, "stage", "pred", ["g"]), ["g"]).collect()
    assert len(got) == 7
    for r in got:
        true = [t for g, t, _ in rows if g == r["g"]]
        pred = [p for g, _, p in rows if g == r["g"]]
        want = _by_definition(true, pred)
        assert (r["accuracy"], r["macro_f1"], r["cohen_kappa"]) == pytest.approx(want)


def test_scored_only(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (4,)], "expert int")
    assert agree.scored_only(df, "expert").count() == 2


def test_document(spark):
    text = agree.metrics_document(_count(spark, [0, 1, 2], [0, 1, 1])).select(
        F.to_json(F.struct("*"))
    ).first()[0]
    doc = json.loads(text)
    assert list(doc) == [
        "accuracy", "macro_f1", "cohen_kappa", "per_stage", "confusion_matrix", "class_names", "n_epochs",
    ]
    assert doc["class_names"] == S.STAGE_NAMES and doc["per_stage"]["N1"]["support"] == 1


def test_compare_models(spark):
    rows = [("x", 0, 0), ("x", 1, 1), ("y", 0, 1), ("y", 1, 1)]
    df = spark.createDataFrame(rows, "model string, stage int, pred int")
    table = agree.compare_models(agree.agreement(df, "stage", "pred", ["model"]), ["x", "y"])
    got = {r["metric"]: (r["x"], r["y"]) for r in table.collect()}
    assert got["accuracy"] == (1.0, 0.5) and len(got) == 8


def test_scorer_parity(spark):
    a = spark.createDataFrame([(1, 0, [0.6, 0.4]), (2, 1, [0.3, 0.7])], "k int, pred int, proba array<double>")
    b = spark.createDataFrame([(1, 0, [0.59, 0.41]), (2, 0, [0.5, 0.5])], "k int, pred int, proba array<double>")
    row = agree.scorer_parity(a, b, ["k"]).first()
    assert row["label_diffs"] == 1 and row["max_gap"] == pytest.approx(0.2)
