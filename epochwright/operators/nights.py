"""Per-recording tables of the serve path (AGG13-AGG15, J8, WIN11, FN14, SRT2, SNK5, SNK7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import display_order, share
from epochwright.functions.labels import (
    efficiency_text,
    onset_text,
    stage_name,
    stage_ypos,
    whole_text,
)


def night_counts(df: DataFrame, stage: str, keys: list[str] = S.REC) -> DataFrame:
    """One pre-aggregated pass: epochs, epochs per stage, sleep epochs, first sleep epoch."""
    asleep = F.col(stage) != S.WAKE
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.array(*[F.count_if(F.col(stage) == s) for s in S.STAGES]).alias("stage_n"),
        F.count_if(asleep).alias("sleep_n"),
        F.min(F.when(asleep, F.col("epoch_idx"))).alias("onset_idx"),
    )


def stage_summary(counts: DataFrame, epoch_sec: int, keys: list[str] = S.REC) -> DataFrame:
    """AGG13: epochs, percent and minutes of every stage, zero-filled."""
    rows = counts.select(*keys, "n_epochs", F.posexplode("stage_n").alias("stage", "epochs"))
    return rows.select(
        *keys,
        "stage",
        stage_name(F.col("stage")).alias("name"),
        "epochs",
        share(F.col("epochs") * 100, F.col("n_epochs")).alias("pct"),
        (F.col("epochs") * (epoch_sec / 60.0)).alias("minutes"),
    )


def sleep_stats(counts: DataFrame, epoch_sec: int, keys: list[str] = S.REC) -> DataFrame:
    """AGG14: total sleep, time in bed, efficiency, sleep onset (NULL without sleep)."""
    minutes = epoch_sec / 60.0
    return counts.select(
        *keys,
        "n_epochs",
        (F.col("sleep_n") * minutes).alias("total_sleep_min"),
        (F.col("n_epochs") * minutes).alias("time_in_bed_min"),
        share(F.col("sleep_n") * 100, F.col("n_epochs")).alias("sleep_efficiency_pct"),
        (F.col("onset_idx") * minutes).alias("sleep_onset_min"),
    )


def summary_report(counts: DataFrame, epoch_sec: int, keys: list[str] = S.REC) -> DataFrame:
    """SNK7: the stage table as shown to a reader, one decimal, halves to even."""
    return stage_summary(counts, epoch_sec, keys).select(
        *keys,
        F.col("name").alias("Stage"),
        F.col("epochs").alias("Epochs"),
        F.bround("pct", 1).alias("%"),
        F.bround("minutes", 1).alias("Minutes"),
    )


def summary_text(stats: DataFrame, keys: list[str] = S.REC) -> DataFrame:
    """FN15: one readable line of facts per recording."""
    hours = F.bround(F.col("time_in_bed_min") / 60.0, 1).cast("string")
    return stats.select(
        *keys,
        F.concat(F.col("n_epochs").cast("string"), F.lit(" epochs, "), hours, F.lit(" h")).alias(
            "recording"
        ),
        whole_text(F.col("total_sleep_min"), " min").alias("total_sleep"),
        efficiency_text(F.col("sleep_efficiency_pct")).alias("efficiency"),
        onset_text(F.col("sleep_onset_min")).alias("sleep_onset"),
    )


def hypnogram(
    df: DataFrame, true: str, pred: str, epoch_sec: int, keys: list[str] = S.REC
) -> DataFrame:
    """WIN11: hours on x, row height on y; an unscored epoch leaves a NULL gap."""
    return df.select(
        *keys,
        "epoch_idx",
        (F.col("epoch_idx") * F.lit(float(epoch_sec)) / 3600.0).alias("hours"),
        stage_ypos(F.col(true)).alias("true_y"),
        stage_ypos(F.col(pred)).alias("pred_y"),
    )


def probability_strip(df: DataFrame, proba: str, keys: list[str]) -> DataFrame:
    """FN14: one row per epoch and stage, in hypnogram row order."""
    names = F.array(*[F.lit(S.STAGE_NAMES[s]) for s in S.DISPLAY_ORDER])
    rows = df.select(*keys, F.posexplode(display_order(F.col(proba))).alias("row", "p"))
    return rows.select(*keys, "row", F.element_at(names, F.col("row") + 1).alias("name"), "p")


def first_night(df: DataFrame, keys: list[str] = S.REC) -> DataFrame:
    """SRT2: the epochs of the first recording in key order, sorted by epoch.

    The minimum is one pre-aggregated row, so its broadcast is bounded.
    """
    first = df.agg(F.min(F.struct(*keys)).alias("_k")).select("_k.*")
    return df.join(F.broadcast(first), keys, "left_semi").orderBy(*keys, "epoch_idx")


def epoch_export(
    df: DataFrame, pred: str, epoch_sec: int, expert: str | None = None, keys: list[str] = S.REC
) -> DataFrame:
    """SNK5 rows: epoch, start second and stage names; an unscored expert says so."""
    columns = [
        *keys,
        "epoch_idx",
        (F.col("epoch_idx") * epoch_sec).alias("start_sec"),
        stage_name(F.col(pred)).alias("pred_stage"),
    ]
    if expert is not None:
        columns.append(
            F.coalesce(stage_name(F.col(expert)), F.lit("unscored")).alias("expert_stage")
        )
    return df.select(*columns)


def stage_counts(df: DataFrame, by: list[str] = []) -> DataFrame:
    """AGG2: epochs and percent per stage, zero-filled, per ``by`` group."""
    counted = df.groupBy(*by).agg(
        F.array(*[F.count_if(F.col("stage") == s) for s in S.STAGES]).alias("_n"),
        F.count(F.lit(1)).alias("_total"),
    )
    rows = counted.select(*by, "_total", F.posexplode("_n").alias("stage", "n"))
    return rows.select(
        *by,
        "stage",
        stage_name(F.col("stage")).alias("name"),
        "n",
        share(F.col("n") * 100, F.col("_total")).alias("pct"),
    )
