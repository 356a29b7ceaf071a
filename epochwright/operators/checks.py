"""Input guards as reject tables and errors (FLT7, FLT13-FLT16, FLT19)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import probability_violation


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """FLT15: ``df`` itself, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_or_explain(read, path: str, what: str, step: str) -> DataFrame:
    """FLT16: run ``read(path)``; a missing path names the step that writes it."""
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{what} not found: {path}. Run {step} first.") from error
        raise


def wrong_rate(headers: DataFrame, channel: str, sample_rate: int) -> DataFrame:
    """FLT7: files whose channel is not sampled at the expected rate."""
    rate = F.rint("sfreq").cast("int")
    return (
        headers.filter((F.col("channel") == channel) & (rate != sample_rate))
        .select(
            "path", "channel", rate.alias("sample_rate"), F.lit(sample_rate).alias("expected")
        )
    )


def missing_channel(headers: DataFrame, channel: str) -> DataFrame:
    """SRC4: files without the channel, with the channels they do have."""
    per_file = headers.groupBy("path").agg(
        F.max(F.col("channel") == channel).alias("_has"),
        F.array_sort(F.collect_set("channel")).alias("available"),
    )
    return per_file.filter(~F.col("_has")).select("path", "available")


def too_short(recordings: DataFrame, length: int, keys: list[str] = S.REC) -> DataFrame:
    """FLT15: recordings with less than one epoch of samples."""
    return recordings.filter(F.col("n_samples") < length).select(*keys, "n_samples")


def wrong_shape(epochs: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """FLT13: epochs that do not hold exactly ``length`` samples."""
    return epochs.filter(F.size("signal") != length).select(*keys, F.size("signal").alias("size"))


def unmatched_epochs(predicted: DataFrame, expert: DataFrame, keys: list[str]) -> DataFrame:
    """FLT14: epochs only one of the two tables has."""
    left = predicted.select(*keys, F.lit(True).alias("_p"))
    right = expert.select(*keys, F.lit(True).alias("_e"))
    return (
        left.join(right, keys, "full_outer")
        .filter(F.col("_p").isNull() | F.col("_e").isNull())
        .select(
            *keys,
            F.col("_p").isNotNull().alias("predicted"),
            F.col("_e").isNotNull().alias("expert"),
        )
    )


def bad_probabilities(scored: DataFrame, keys: list[str]) -> DataFrame:
    """FLT19: rows whose probabilities are not five values summing to 1."""
    return scored.filter(probability_violation(F.col("proba"))).select(*keys, "proba")


def raise_on(rejects: DataFrame, message: str, shown: int = 5) -> None:
    """Fail with the first few rejected rows in the message."""
    rows = rejects.limit(shown).collect()
    if rows:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))
