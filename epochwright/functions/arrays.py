"""Array and number expressions that stay inside the JVM (FN1-FN3, FN10, FN12-FN14, SRT4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwright import schema as S


def half_even(value: Column) -> Column:
    """FN10: round half to even, as a BIGINT (``round`` would round half up)."""
    return F.rint(value).cast("long")


def quotient(value: Column, divisor: Column | int) -> Column:
    """Whole-number division of non-negative integers, exact at any size."""
    by = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value, by)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """FN1 for one sample."""
    return (value - mean) / (std + F.lit(S.ZSCORE_EPS))


def zscore_array(samples: Column, mean: Column, std: Column) -> Column:
    """FN1 for an array of samples."""
    return F.transform(samples, lambda x: zscore(x, mean, std))


def argmax(values: Column) -> Column:
    """SRT4: 0-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def expand_probabilities(by_class: Column) -> Column:
    """FN13: MAP<INT, DOUBLE> of the classes a model knows to one value per stage."""
    return F.array(
        *[F.coalesce(F.try_element_at(by_class, F.lit(c)), F.lit(0.0)) for c in S.STAGES]
    )


def display_order(probabilities: Column) -> Column:
    """FN14: probabilities in hypnogram row order."""
    return F.array(*[F.element_at(probabilities, c + 1) for c in S.DISPLAY_ORDER])


def probability_violation(probabilities: Column) -> Column:
    """FLT19: true unless there is one value per stage and they sum to 1 within 1e-4."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p)
    return (F.size(probabilities) != S.N_STAGES) | (F.abs(total - 1.0) > 1e-4)
