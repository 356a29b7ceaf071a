import pytest
from pyspark.sql import functions as F

from epochwright.operators import cohort


def _subjects(spark, n, stages=(0, 1, 2, 3, 4)):
    rows = [(f"SC{i:02d}", list(stages)) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id string, stages array<int>")


def _assigned(spark, n, seed=42, val=0.15, test=0.15):
    return {r["subject_id"]: r["split"] for r in cohort.assign_splits(_subjects(spark, n), seed, val, test).collect()}


@pytest.mark.parametrize(
    "n, val, test, want",
    [
        (20, 0.15, 0.15, (14, 3, 3)),
        (78, 0.15, 0.15, (54, 12, 12)),
        (3, 0.15, 0.15, (1, 1, 1)),
        (4, 0.4, 0.4, (1, 2, 1)),
        (10, 0.0, 0.2, (8, 0, 2)),
        (10, 0.25, 0.0, (8, 2, 0)),
    ],
)
def test_sizes(n, val, test, want):
    assert tuple(cohort.split_sizes(n, val, test).values()) == want


def test_too_few_subjects():
    with pytest.raises(ValueError, match="at least 3"):
        cohort.split_sizes(2, 0.15, 0.15)


def test_split_is_complete_seeded_and_partition_independent(spark):
    first = _assigned(spark, 20)
    assert len(first) == 20
    assert sorted(first.values()).count("train") == 14
    again = cohort.assign_splits(_subjects(spark, 20).repartition(7), 42, 0.15, 0.15)
    assert {r["subject_id"]: r["split"] for r in again.collect()} == first
    assert _assigned(spark, 20, seed=7) != first


def test_checks_pass(spark):
    subjects = _subjects(spark, 20)
    cohort.check_splits(cohort.assign_splits(subjects, 42, 0.15, 0.15), subjects)


def test_missing_stage_is_named(spark):
    subjects = _subjects(spark, 9, (0, 1, 2, 3)).unionByName(
        spark.createDataFrame([("SC99", [0, 1, 2, 3, 4])], "subject_id string, stages array<int>")
    )
    with pytest.raises(ValueError, match=r"missing stage\(s\) \[4\]"):
        cohort.check_splits(cohort.assign_splits(subjects, 42, 0.15, 0.15), subjects)


def test_empty_split_misses_every_stage(spark):
    subjects = _subjects(spark, 10)
    splits = cohort.assign_splits(subjects, 42, 0.0, 0.2)
    with pytest.raises(ValueError, match=r"'val' is missing stage\(s\) \[0, 1, 2, 3, 4\]"):
        cohort.check_splits(splits, subjects)


def test_overlap_and_incompleteness_are_found(spark):
    subjects = _subjects(spark, 3)
    splits = spark.createDataFrame(
        [("SC00", "train"), ("SC00", "val"), ("SC01", "test"), ("SC77", "test")],
        "subject_id string, split string",
    )
    assert [r[0] for r in cohort.overlapping_subjects(splits).collect()] == ["SC00"]
    incomplete = {r["subject_id"]: (r["in_splits"], r["in_subjects"]) for r in cohort.incomplete_subjects(splits, subjects).collect()}
    assert incomplete == {"SC02": (0, 1), "SC77": (1, 0)}
    with pytest.raises(ValueError):
        cohort.check_splits(splits, subjects)


def test_class_weights(spark):
    rows = [(0,)] * 90 + [(1,)] * 5 + [(2,)] * 5
    got = cohort.class_weights(spark.createDataFrame(rows, "stage int")).collect()
    assert {r["stage"]: round(r["weight"], 4) for r in got} == {0: 0.3704, 1: 6.6667, 2: 6.6667}
    assert {r["stage"]: round(r["relative"], 4) for r in got} == {0: 0.0556, 1: 1.0, 2: 1.0}


def test_resampling_balances_and_repeats(spark):
    rows = [(i, 0 if i % 10 else 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, stage int")
    pick = cohort.resample_by_weight(df, cohort.class_weights(df), F.col("k"), 1)
    counts = {r["stage"]: r["count"] for r in pick.groupBy("stage").count().collect()}
    assert counts[1] == 400 and 300 < counts[0] < 500
    other = cohort.resample_by_weight(df.repartition(9), cohort.class_weights(df), F.col("k"), 1)
    assert sorted(r["k"] for r in other.collect()) == sorted(r["k"] for r in pick.collect())


def test_split_epochs(spark):
    epochs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "subject_id string, x int")
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "subject_id string, split string")
    assert sorted(r["x"] for r in cohort.split_epochs(epochs, splits, "test").collect()) == [2, 3]


def test_warning_uses_priority(spark):
    night = spark.createDataFrame([("a", 1), ("b", 1), ("z", 2)], "subject_id string, night int")
    splits = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "subject_id string, split string")
    got = {r["subject_id"]: (r["split"], r["not_test"]) for r in cohort.warn_if_not_test(night, splits).collect()}
    assert got == {"a": ("test", False), "b": ("val", True), "z": (None, True)}


def test_first_subjects(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("c", 1)], "subject_id string, night int")
    assert cohort.first_subjects(df, 1).count() == 2
    assert cohort.first_subjects(df, 2).count() == 3
    assert cohort.first_subjects(df, None).count() == 4


def test_overview(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("a", 2)], "subject_id string, night int")
    assert tuple(cohort.subject_overview(df).first()) == (4, 3, 2)
