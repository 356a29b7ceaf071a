import numpy as np
import pytest

from epochwright.models.scoring import require_model_name, score_with


def test_predictor_sees_small_batches_and_all_rows(spark):
    rows = [(i, [float(i)] * 8) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, signal array<float>").repartition(2)

    def make():
        def predict(x):
            assert len(x) <= 16 and x.dtype == np.float32
            proba = np.zeros((len(x), 5))
            proba[np.arange(len(x)), x[:, 0].astype(int) % 5] = 1.0
            return proba

        return predict

    got = score_with(df, make, ["k"], batch_size=16).collect()
    assert {r["k"]: r["pred"] for r in got} == {i: i % 5 for i in range(300)}


def test_ties_go_to_the_first_class(spark):
    df = spark.createDataFrame([(1, [1.0])], "k int, signal array<float>")
    got = score_with(df, lambda: (lambda x: np.full((len(x), 5), 0.2)), ["k"]).first()
    assert got["pred"] == 0 and len(got["proba"]) == 5


def test_model_names():
    assert require_model_name("trees", ["trees", "raw"]) == "trees"
    with pytest.raises(ValueError, match="unknown model"):
        require_model_name("x", ["trees"])


def test_unequal_epochs_are_an_error(spark):
    rows = spark.createDataFrame([(1, [0.0] * 6), (2, [0.0] * 10)], "k int, signal array<float>").coalesce(1)
    with pytest.raises(Exception, match="unequal length"):
        score_with(rows, lambda: lambda x: np.ones((len(x), 5)), ["k"]).collect()
