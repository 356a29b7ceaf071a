"""Subject splits, their checks, class weights and training order (AGG4, AGG6, WIN6-WIN8, SET2-SET5, J4, J7, J10, ML8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.operators.indexing import row_index


def subject_stages(epochs: DataFrame) -> DataFrame:
    """AGG4 (SRC7): the set of stages each subject has. Sets hold at most five values."""
    return epochs.groupBy("subject_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def subset_size(n: int, fraction: float) -> int:
    """WIN8: subjects for a fraction: none, or at least one, rounded half to even."""
    return max(1, round(n * fraction)) if fraction > 0 else 0


def split_sizes(n: int, val_frac: float, test_frac: float) -> dict[str, int]:
    """WIN8: subjects per split; test, then val, gives way until train has one."""
    if n < 3:
        raise ValueError(f"a train/val/test split needs at least 3 subjects, got {n}")
    test, val = subset_size(n, test_frac), subset_size(n, val_frac)
    excess = test + val - (n - 1)
    for _ in range(max(0, excess)):
        if test >= val:
            test -= 1
        else:
            val -= 1
    return {"train": n - test - val, "val": val, "test": test}


def seeded_order(df: DataFrame, seed: int, key: Column, out: str = "position") -> DataFrame:
    """WIN7 / ML8: a repeatable shuffle as a dense position, the same on any partitioning.

    Orders by an MD5 of seed and key through the distributed numbering, so the
    order is not computed in one task.
    """
    mixed = df.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), key)))
    ties = [c for c, t in df.dtypes if t in ("string", "int", "bigint")]
    return row_index(mixed, [], ["_mix", *ties], out).drop("_mix")


def assign_splits(
    subjects: DataFrame, seed: int, val_frac: float, test_frac: float
) -> DataFrame:
    """WIN7 + WIN8: ``(subject_id, split)``; first test, then val, the rest train.

    ``subjects`` has one row per ``subject_id``.
    """
    ordered = seeded_order(subjects, seed, F.col("subject_id"))
    sizes = split_sizes(ordered.count(), val_frac, test_frac)
    position = F.col("position")
    split = (
        F.when(position < sizes["test"], "test")
        .when(position < sizes["test"] + sizes["val"], "val")
        .otherwise("train")
    )
    return ordered.select("subject_id", split.alias("split"))


def split_counts(splits: DataFrame) -> DataFrame:
    """Subjects per split."""
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_subjects"))


def _split_names(spark) -> DataFrame:
    names = F.array(*[F.lit(s) for s in S.SPLITS])
    return spark.range(1).select(F.explode(names).alias("split"))


def stage_coverage(splits: DataFrame, stages: DataFrame) -> DataFrame:
    """SET2 + SET3: covered and missing stages of each split; an empty split misses all."""
    covered = (
        splits.join(stages, "subject_id")
        .select("split", F.explode("stages").alias("stage"))
        .groupBy("split")
        .agg(F.array_sort(F.collect_set("stage")).alias("covered"))
    )
    nothing = F.array().cast("array<int>")
    domain = F.array(*[F.lit(s) for s in S.STAGES])
    return (
        _split_names(splits.sparkSession)
        .join(covered, "split", "left")
        .withColumn("covered", F.coalesce("covered", nothing))
        .withColumn("missing", F.array_except(domain, F.col("covered")))
    )


def overlapping_subjects(splits: DataFrame) -> DataFrame:
    """SET4: subjects found in more than one split; must be empty."""
    return (
        splits.groupBy("subject_id")
        .agg(F.count_distinct("split").alias("n_splits"))
        .filter(F.col("n_splits") > 1)
    )


def incomplete_subjects(splits: DataFrame, subjects: DataFrame) -> DataFrame:
    """SET5: subjects on one side only; must be empty."""
    return (
        splits.select("subject_id", F.lit(1).alias("_s"), F.lit(0).alias("_a"))
        .unionByName(subjects.select("subject_id", F.lit(0).alias("_s"), F.lit(1).alias("_a")))
        .groupBy("subject_id")
        .agg(F.max("_s").alias("in_splits"), F.max("_a").alias("in_subjects"))
        .filter(F.col("in_splits") + F.col("in_subjects") < 2)
    )


def check_splits(splits: DataFrame, stages: DataFrame) -> None:
    """SET3-SET5 as errors. Each check looks at bounded results only."""
    if not overlapping_subjects(splits).isEmpty():
        raise ValueError("a subject appears in more than one split")
    if not incomplete_subjects(splits, stages).isEmpty():
        raise ValueError("splits do not cover exactly the subjects of the epoch store")
    gaps = stage_coverage(splits, stages).filter(F.size("missing") > 0).collect()
    if gaps:
        text = "; ".join(f"split '{g['split']}' is missing stage(s) {g['missing']}" for g in gaps)
        raise ValueError(f"{text}; use another seed or more subjects")


def split_epochs(epochs: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """J4 / FLT8: epochs of one split's subjects.

    The subject list grows with the data, so it is joined, not collected or
    force-broadcast; where it is small Spark broadcasts it and prunes partitions.
    """
    chosen = splits.filter(F.col("split") == split).select("subject_id")
    return epochs.join(chosen, "subject_id", "left_semi")


def warn_if_not_test(night: DataFrame, splits: DataFrame) -> DataFrame:
    """J10: the split of each recording's subject, test over val over train, and a warning flag."""
    rank = {"test": 0, "val": 1, "train": 2}
    priority = F.coalesce(*[F.when(F.col("split") == s, r) for s, r in rank.items()])
    best = splits.groupBy("subject_id").agg(F.min_by("split", priority).alias("split"))
    return (
        night.select(*S.REC)
        .distinct()
        .join(best, "subject_id", "left")
        .withColumn("not_test", ~F.col("split").eqNullSafe("test"))
    )


def class_weights(df: DataFrame, stage: str = "stage") -> DataFrame:
    """AGG6: ``weight`` n / (classes present x class count), over the closed stage domain.

    ``relative`` is the weight over the largest one. The counts collapse into one row of five, so no window over the data is
    needed and the result has at most five rows.
    """
    counts = df.agg(*[F.count_if(F.col(stage) == s).alias(f"n{s}") for s in S.STAGES])
    n = F.array(*[F.col(f"n{s}") for s in S.STAGES])
    rows = counts.select(n.alias("_n")).select(
        F.aggregate("_n", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"),
        F.filter("_n", lambda x: x > 0).alias("_present"),
        F.posexplode("_n").alias("stage", "n"),
    )
    return rows.filter(F.col("n") > 0).select(
        "stage",
        "n",
        (F.col("total") / (F.size("_present") * F.col("n"))).alias("weight"),
        (F.array_min("_present") / F.col("n")).alias("relative"),
    )


def weigh_rows(df: DataFrame, weights: DataFrame, stage: str = "stage") -> DataFrame:
    """J7: each row's class weight; ``weights`` has at most five rows."""
    small = weights.select(F.col("stage").alias(stage), "weight")
    return df.join(F.broadcast(small), stage)


def resample_by_weight(df: DataFrame, weights: DataFrame, key: Column, seed: int) -> DataFrame:
    """Class balance for trainers without a weight column (ML2): keep a row with
    probability weight / largest weight, decided by an MD5 of seed and key, as splits are."""
    chance = weights.select("stage", F.col("relative").alias("weight"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return weigh_rows(df, chance).filter(draw < F.col("weight")).drop("weight")


def first_subjects(df: DataFrame, limit: int | None) -> DataFrame:
    """WIN6: all rows of the first ``limit`` subjects in id order; None keeps everything.

    ``limit`` is the caller's number; Spark keeps that many ids per partition.
    """
    if limit is None:
        return df
    kept = df.select("subject_id").distinct().orderBy("subject_id").limit(limit)
    return df.join(kept, "subject_id", "left_semi")


def subject_overview(df: DataFrame) -> DataFrame:
    """AGG3 + AGG5: rows, recordings and subjects of a table."""
    return (
        df.groupBy(*S.REC)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("n_recordings"),
            F.count_distinct("subject_id").alias("n_subjects"),
        )
    )
