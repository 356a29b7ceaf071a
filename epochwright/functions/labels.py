"""Column expressions over annotation texts, stage ids and file names (FLT1, FLT2, J8, FN11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import half_even


def _lookup(key: Column, table: dict) -> Column:
    """Value for ``key`` in a small fixed table, else NULL.

    A literal map: the key is evaluated once and no join is needed.
    """
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), key)


def map_annotation(text: Column) -> Column:
    """FLT2: annotation text to stage id; NULL means the annotation is dropped."""
    stripped = F.btrim(text, F.lit(" \t\n\r\f\v"))
    return _lookup(stripped, S.ANNOTATION_STAGE)


def stage_name(stage: Column) -> Column:
    """J8: stage id to its display name, NULL outside the domain."""
    return _lookup(stage, dict(zip(S.STAGES, S.STAGE_NAMES)))


def stage_ypos(stage: Column) -> Column:
    """J8: stage id to its height on a hypnogram (wake on top), NULL outside the domain."""
    top = S.N_STAGES - 1
    return _lookup(stage, {stage_id: top - row for row, stage_id in enumerate(S.DISPLAY_ORDER)})


def parse_stem(stem: Column) -> tuple[Column, Column]:
    """FLT1: 8-character stem to (subject_id, night), both NULL when it does not match."""
    matches = stem.rlike(S.STEM_PATTERN)
    subject = F.concat(F.lit("SC"), F.regexp_extract(stem, S.STEM_PATTERN, 1))
    night = F.regexp_extract(stem, S.STEM_PATTERN, 2)
    return F.when(matches, subject), F.when(matches, F.try_to_number(night, F.lit("9")).cast("int"))


def recording_key(name: Column) -> Column:
    """FN11: the first six characters, shared by both files of a recording."""
    return F.substring(name, 1, 6)


def whole_text(value: Column, unit: str) -> Column:
    """FN15: a number without decimals (halves to even) and its unit; NULL stays NULL."""
    return F.concat(half_even(value).cast("string"), F.lit(unit))


def efficiency_text(percent: Column) -> Column:
    """FN15: sleep efficiency as whole percent."""
    return whole_text(percent, "%")


def onset_text(minutes: Column) -> Column:
    """FN15: sleep onset in whole minutes, a dash when there was no sleep."""
    return F.coalesce(whole_text(minutes, " min"), F.lit("—"))


def source_text(subject: Column, night: Column) -> Column:
    """FN15: human-readable label of a packaged night."""
    return F.concat(
        F.lit("sample: "),
        F.coalesce(subject, F.lit("?")),
        F.lit(" night "),
        F.coalesce(night.cast("string"), F.lit("?")),
    )


def agreement_band(kappa: Column) -> Column:
    """FN16: Landis and Koch wording for a kappa value."""
    # fixed values: upper bounds and names of the published bands
    bands = [
        (0.2, "slight"),
        (0.4, "fair"),
        (0.6, "moderate"),
        (0.8, "substantial"),
        (1.0, "almost perfect"),
    ]
    expr = F.when(kappa.isNull() | F.isnan(kappa), F.lit(None).cast("string")).when(
        kappa < 0.0, "poor"
    )
    for upper, name in bands:
        expr = expr.when(kappa <= upper, name)
    return expr
