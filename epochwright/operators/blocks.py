"""Long recordings as blocks of samples: statistics, slicing, cutting (AGG1, J2, J3, WIN5, FLT6).

A block is one row ``(REC, block_idx, samples)``. All blocks of a recording hold
``block_len`` samples, except a shorter last one, so a sample position gives its
block by division and slicing is an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import quotient, zscore
from epochwright.session import materialize, sized


def sample_stats(samples: DataFrame, value: str, keys: list[str] = S.REC) -> DataFrame:
    """AGG1 over one row per sample: ``n_samples``, ``mean``, ``std`` (population).

    The aggregates merge counts, means and squared deviations, so partitions are
    reduced before the shuffle and a hot recording costs one row per partition.
    """
    return samples.groupBy(*keys).agg(
        F.count(value).alias("n_samples"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def block_stats(blocks: DataFrame, keys: list[str] = S.REC) -> DataFrame:
    """AGG1 over blocks: each is folded to count, mean and squared deviations where it lies."""
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x)
    sized_blocks = blocks.filter(F.size("samples") > 0).select(
        *keys, "samples", F.size("samples").cast("long").alias("n"), (total / F.size("samples")).alias("mean")
    )
    m2 = F.aggregate(
        "samples", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean"))
    )
    return merge_moments(sized_blocks.select(*keys, "n", "mean", m2.alias("m2")), keys)


def merge_moments(parts: DataFrame, keys: list[str] = S.REC) -> DataFrame:
    """AGG1 from partial statistics ``n``, ``mean``, ``m2`` of any pieces of a recording.

    States are merged pairwise about their common mean, first inside each task,
    so one exchange moves a state per recording and task; a hot recording has
    no more states than there are tasks. Nothing cancels for signals with a
    large offset, as sums of squares would.
    """
    parts = parts.select(*keys, F.col("n").cast("long"), F.col("mean").cast("double"), F.col("m2").cast("double"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    states = parts.mapInArrow(_merge_inside(keys), parts.schema).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))).alias("_states")
    )
    merged = states.select(*keys, F.aggregate("_states", zero, _merged).alias("_s"))
    return merged.select(
        *keys,
        F.col("_s.n").alias("n_samples"),
        F.col("_s.mean").alias("mean"),
        F.sqrt(F.col("_s.m2") / F.col("_s.n")).alias("std"),
    )


def _merged(a: Column, b: Column) -> Column:
    n, shift = a["n"] + b["n"], b["mean"] - a["mean"]
    share = b["n"] / n
    return F.struct(
        n.alias("n"),
        (a["mean"] + shift * share).alias("mean"),
        (a["m2"] + b["m2"] + shift * shift * a["n"] * share).alias("m2"),
    )


_KEYS_HELD = 65_536  # recordings whose states a task holds at once


def _merge_inside(keys: list[str]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, float, float]] = {}
        schema = None
        for part in parts:
            schema = part.schema
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for *key, n, mean, m2 in zip(*columns):
                if not n:
                    continue
                n0, mean0, m20 = held.get(tuple(key), (0, 0.0, 0.0))
                shift, total = mean - mean0, n0 + n
                held[tuple(key)] = (
                    total, mean0 + shift * (n / total), m20 + m2 + shift * shift * n0 * (n / total)
                )
            if len(held) >= _KEYS_HELD:
                yield states(held, schema)
                held = {}
        if held:
            yield states(held, schema)

    def states(held, schema):
        rows = [(*key, *state) for key, state in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return batches


def normalize_samples(samples: DataFrame, value: str, keys: list[str] = S.REC) -> DataFrame:
    """J2 + FN1 over one row per sample: adds ``mean``, ``std`` and ``z``.

    The statistics are written first, so the samples are shuffled only if there
    are too many recordings to broadcast.
    """
    stats = sized(sample_stats(samples, value, keys).drop("n_samples"), "stats")
    return samples.join(stats, keys).withColumn(
        "z", zscore(F.col(value), F.col("mean"), F.col("std"))
    )


def to_blocks(
    samples: DataFrame, position: str, value: str, block_len: int, keys: list[str] = S.REC
) -> DataFrame:
    """One row per sample to blocks of ``block_len`` samples (the tumbling window of WIN5)."""
    return (
        samples.groupBy(*keys, quotient(F.col(position), block_len).alias("block_idx"))
        .agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("_rows"))
        .select(*keys, "block_idx", F.col("_rows").getField(value).alias("samples"))
    )


def cut_epochs(
    samples: DataFrame, position: str, value: str, length: int, keys: list[str] = S.REC
) -> DataFrame:
    """WIN5: consecutive epochs of ``length`` samples from t = 0, a trailing part dropped."""
    cut = to_blocks(samples, position, value, length, keys)
    return cut.filter(F.size("samples") == length).select(
        *keys, F.col("block_idx").cast("int").alias("epoch_idx"), F.col("samples").alias("signal")
    )


def grid_plan(recordings: DataFrame, length: int, keys: list[str] = S.REC) -> DataFrame:
    """WIN5 as a plan for :func:`slice_blocks`: ``epoch_idx`` and ``start_sample`` from t = 0."""
    n_epochs = quotient(F.col("n_samples"), length)
    return (
        recordings.filter(F.col("n_samples") >= length)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), n_epochs - 1)).alias("_k"))
        .withColumn("epoch_idx", F.col("_k").cast("int"))
        .withColumn("start_sample", F.col("_k") * length)
        .drop("_k")
    )


def slice_blocks(
    blocks: DataFrame, plan: DataFrame, length: int, keys: list[str] = S.REC
) -> DataFrame:
    """J3: the ``length`` samples from each plan row's ``start_sample``, as ``samples``.

    ``plan`` carries ``block_len`` and any further columns, which pass through;
    ``keys`` + ``plan_idx`` identify its rows. Slices that do not fill an epoch
    are dropped (FLT6).

    The blocks, by far the larger side, are read and shuffled once. The plan is
    written first, so one look at it tells whether any epoch crosses blocks.
    Where none does (epochs aligned to file records) a slice needs one join row
    and is done; else epochs are cut into pieces and put together again.
    """
    first = quotient(F.col("start_sample"), F.col("block_len"))
    last = quotient(F.col("start_sample") + length - 1, F.col("block_len"))
    spans = materialize(plan.withColumn("_first", first).withColumn("_last", last), "slices")
    aligned = spans.filter(F.col("_first") < F.col("_last")).isEmpty()
    extra = [c for c in plan.columns if c not in [*keys, "plan_idx"]]

    begin = F.col("block_idx") * F.col("block_len")
    lo = F.greatest(F.col("start_sample") - begin, F.lit(0))
    hi = F.least(F.col("start_sample") + length - begin, F.size("samples").cast("long"))
    part = F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))

    block = F.col("_first") if aligned else F.explode(F.sequence("_first", "_last"))
    parts = (
        spans.withColumn("block_idx", block)
        .join(blocks, [*keys, "block_idx"])
        .select(*keys, "plan_idx", *extra, "block_idx", part.alias("_part"))
    )
    if aligned:
        slices = parts.select(*keys, "plan_idx", *extra, F.col("_part").alias("samples"))
    else:
        slices = (
            parts.groupBy(*keys, "plan_idx")
            .agg(
                *[F.first(c).alias(c) for c in extra],
                F.array_sort(F.collect_list(F.struct("block_idx", "_part"))).alias("_parts"),
            )
            .select(*keys, "plan_idx", *extra, F.flatten(F.col("_parts._part")).alias("samples"))
        )
    return slices.filter(F.size("samples") == length)
