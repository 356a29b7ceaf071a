"""File listings to recordings (SRC1, FLT1, J1, J11, SRT1, SET1, FLT12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.labels import parse_stem, recording_key


MAX_BYTES = 200_000_000  # fixed value: largest file that is staged


def listed_names(
    pages: DataFrame,
    page_key: str,
    text: str,
    pattern: str = S.LISTING_PATTERN,
    group: int = 0,
) -> DataFrame:
    """SRC1 + SET1: distinct matches of ``pattern`` with their first (page, position).

    Names are reduced before the shuffle, so a name listed everywhere is cheap.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    return (
        pages.select(F.col(page_key).alias("page"), F.posexplode(found).alias("pos", "name"))
        .groupBy("name")
        .agg(F.min(F.struct("page", "pos")).alias("_first"))
        .select("name", F.col("_first.page").alias("page"), F.col("_first.pos").alias("pos"))
    )


def _sides(names: DataFrame) -> DataFrame:
    """One row per recording key with the last signal and annotation name of each.

    Both sides come out of one aggregation; a join of two filtered scans would
    read and shuffle the listing twice. Positions restart on each page of a
    listing, so where there is a ``page`` it counts first.
    """
    at = F.struct("page", "pos") if "page" in names.columns else F.col("pos")
    is_signal = F.col("name").endswith(S.SIGNAL_SUFFIX)
    is_annotation = F.col("name").endswith(S.ANNOTATION_SUFFIX)
    return (
        names.filter(is_signal | is_annotation)
        .groupBy(recording_key(F.col("name")).alias("key"))
        .agg(
            F.max_by(F.when(is_signal, F.col("name")), F.when(is_signal, at)).alias(
                "psg_name"
            ),
            F.max_by(
                F.when(is_annotation, F.col("name")), F.when(is_annotation, at)
            ).alias("hypnogram_name"),
        )
    )


def pair_recordings(names: DataFrame) -> DataFrame:
    """J1 + FLT1: paired recordings ``(subject_id, night, psg_name, hypnogram_name)``.

    ``names`` has ``name`` and its listing position ``pos`` (and ``page``); a later name replaces
    an earlier one of the same key and side.
    """
    subject, night = parse_stem(F.substring("psg_name", 1, 8))
    return (
        _sides(names)
        .filter(F.col("psg_name").isNotNull() & F.col("hypnogram_name").isNotNull())
        .select(
            subject.alias("subject_id"), night.alias("night"), "psg_name", "hypnogram_name"
        )
        .filter(F.col("subject_id").isNotNull())
    )


def unpaired_names(names: DataFrame) -> DataFrame:
    """J11: keys with only one side, and the name that is there."""
    both = F.col("psg_name").isNotNull() & F.col("hypnogram_name").isNotNull()
    return _sides(names).filter(~both).select(
        "key",
        F.coalesce("psg_name", "hypnogram_name").alias("name"),
        F.when(F.col("psg_name").isNull(), "signal").otherwise("annotations").alias("missing"),
    )


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """SRC11 + J11: wanted ``name`` rows with no non-empty file of that name."""
    return wanted.join(
        present.filter(F.col("length") > 0).select("name"), "name", "left_anti"
    )


def oversized_files(present: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """FLT12: files above the size limit."""
    return present.filter(F.col("length") > max_bytes)
