"""Interval annotations to labelled epochs (FLT2-FLT5, WIN1-WIN4, J5).

The plan is computed on annotation rows: how many epochs each yields, from
which step on, and at which plan position. Trimming works on these numbers too,
so rows are multiplied only at the very end. Columns in: the recording keys,
``ann_idx``, ``onset``, ``duration``, ``description``; a recordings table adds
``n_samples``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import half_even
from epochwright.functions.labels import map_annotation
from epochwright.operators.indexing import number_rows
from epochwright.session import sized
from epochwright.settings import DatasetSettings

_STRETCH_BITS = 12  # epochs of a stretch of a label grid: 4,096

def map_stages(annotations: DataFrame) -> DataFrame:
    """FLT2 + FLT3: add ``stage``, drop annotations without one."""
    return annotations.withColumn("stage", map_annotation(F.col("description"))).filter(
        F.col("stage").isNotNull()
    )


def _start(step: Column, dataset: DatasetSettings) -> Column:
    """First sample of an annotation's epoch number ``step``."""
    seconds = F.col("onset") + step * F.lit(dataset.epoch_sec)
    return half_even(seconds * F.lit(dataset.sample_rate))


_RUN = ["stage", "onset", "first_step", "n_epochs"]


def plan_runs(
    annotations: DataFrame,
    recordings: DataFrame,
    dataset: DatasetSettings,
    keys: list[str] = S.REC,
    carry: list[str] = [],
    order: list[str] = ["ann_idx"],
) -> DataFrame:
    """WIN1 + FLT4 + WIN2: one row per annotation that yields epochs.

    Adds ``first_step`` and ``n_epochs``, the annotation's epochs within the
    signal, and ``first_idx``, the plan position of the first one. Overlaps are
    kept. Starts grow with the step, so the epochs inside the signal are one
    range of steps; its ends are estimated by division and then settled by the
    rounded starts themselves, at most one step away. ``carry`` names columns of
    ``recordings`` to keep, so facts about a recording need no later join with
    the far more numerous epochs. ``order`` puts a recording's annotations in
    sequence; they need not have been numbered.
    """
    rate, sec = float(dataset.sample_rate), float(dataset.epoch_sec)
    last_start = F.col("n_samples") - dataset.epoch_samples
    low, high = F.col("_low"), F.col("_high")
    first = F.when(_start(low - 1, dataset) >= 0, low - 1).when(
        _start(low, dataset) >= 0, low
    )
    last = F.when(_start(high + 1, dataset) <= last_start, high + 1).when(
        _start(high, dataset) <= last_start, high
    )
    runs = (
        map_stages(annotations)
        .withColumn("_steps", half_even(F.col("duration") / F.lit(sec)))
        .filter(F.col("_steps") > 0)
        .join(recordings.select(*keys, "n_samples", *carry), keys)
        .withColumn("_low", F.ceil(-F.col("onset") / sec))
        .withColumn("_high", F.floor((last_start / F.lit(rate) - F.col("onset")) / sec))
        .withColumn("first_step", F.greatest(F.lit(0), first.otherwise(low + 1)))
        .withColumn("_last", F.least(F.col("_steps") - 1, last.otherwise(high - 1)))
        .withColumn("n_epochs", F.col("_last") - F.col("first_step") + 1)
        .filter(F.col("n_epochs") > 0)
        .select(*keys, *carry, *order, *[c for c in _RUN if c not in order])
    )
    return number_rows(runs, keys, order, {"first_idx": F.col("n_epochs")}, out="run_idx")


def trim_runs(
    runs: DataFrame, dataset: DatasetSettings, keys: list[str] = S.REC
) -> DataFrame:
    """WIN3 + FLT5: add the kept plan range ``lo``..``hi``, drop runs outside it.

    Counts plan rows, not clock time. Without any sleep both bounds are NULL
    and everything is kept.
    """
    asleep = F.col("stage") != S.WAKE
    last_idx = F.col("first_idx") + F.col("n_epochs") - 1
    pad = dataset.pad_epochs
    bounds = runs.groupBy(*keys).agg(
        (F.min(F.when(asleep, F.col("first_idx"))) - pad).alias("lo"),
        (F.max(F.when(asleep, last_idx)) + pad).alias("hi"),
    )
    return runs.join(sized(bounds, "trim-bounds"), keys).filter(
        F.col("lo").isNull() | ((last_idx >= F.col("lo")) & (F.col("first_idx") <= F.col("hi")))
    )


def _expand(
    runs: DataFrame, dataset: DatasetSettings, first: Column, last: Column
) -> DataFrame:
    """Rows for the epochs ``first``..``last`` of each run, counted within the run."""
    return (
        runs.withColumn("_from", first)
        .withColumn("_to", last)
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("_i", F.explode(F.sequence("_from", "_to")))
        .withColumn("plan_idx", F.col("first_idx") + F.col("_i"))
        .withColumn("start_sample", _start(F.col("first_step") + F.col("_i"), dataset))
    )


def expand_runs(
    runs: DataFrame, dataset: DatasetSettings, keys: list[str] = S.REC
) -> DataFrame:
    """Plan rows ``(keys, plan_idx, start_sample, stage)`` of untrimmed runs."""
    rows = _expand(runs, dataset, F.lit(0).cast("long"), F.col("n_epochs") - 1)
    return rows.select(*keys, "plan_idx", "start_sample", "stage")


def expand_trimmed(
    trimmed: DataFrame,
    dataset: DatasetSettings,
    keys: list[str] = S.REC,
    carry: list[str] = [],
) -> DataFrame:
    """WIN4: kept plan rows with ``epoch_idx``, dense from 0 after trimming."""
    start = F.greatest(F.coalesce("lo", F.lit(0)), F.lit(0))
    first = F.greatest(start - F.col("first_idx"), F.lit(0))
    last = F.least(F.coalesce(F.col("hi") - F.col("first_idx"), F.col("n_epochs")), F.col("n_epochs") - 1)
    return (
        _expand(trimmed, dataset, first, last)
        .withColumn("epoch_idx", (F.col("plan_idx") - start).cast("int"))
        .select(*keys, *carry, "epoch_idx", "plan_idx", "start_sample", "stage")
    )


def plan_epochs(
    annotations: DataFrame,
    recordings: DataFrame,
    dataset: DatasetSettings,
    keys: list[str] = S.REC,
    carry: list[str] = [],
    order: list[str] = ["ann_idx"],
) -> DataFrame:
    """Annotations to trimmed, labelled epochs: WIN1-WIN4 with FLT2-FLT5."""
    runs = plan_runs(annotations, recordings, dataset, keys, carry, order)
    return expand_trimmed(trim_runs(runs, dataset, keys), dataset, keys, carry)


def _aligned_pieces(first: Column, last: Column) -> Column:
    """An interval of a stretch as few aligned pieces of 1, 2, 4 ... epochs: array<struct<first, last>>.

    From the finest level up, an odd first and an even last piece are split
    off; what lies between goes on in pieces of twice the size.
    """
    none = F.array().cast("array<struct<first:int,last:int>>")

    def piece(node: Column, level: Column) -> Column:
        begin = F.call_function("shiftleft", node, level)
        return F.array(
            F.struct(begin.alias("first"), (F.call_function("shiftleft", node + 1, level) - 1).alias("last"))
        )

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        odd, even = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        a_next, b_next = a + odd.cast("int"), b - even.cast("int")
        done = a_next > b_next
        return F.struct(
            F.when(done, F.lit(1)).otherwise(F.shiftright(a_next, 1)).alias("a"),
            F.when(done, F.lit(0)).otherwise(F.shiftright(b_next, 1)).alias("b"),
            F.concat(
                state["pieces"], F.when(odd, piece(a, level)).otherwise(none), F.when(even, piece(b, level)).otherwise(none)
            ).alias("pieces"),
        )

    begin = F.struct(first.cast("int").alias("a"), last.cast("int").alias("b"), none.alias("pieces"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_STRETCH_BITS)), begin, step)["pieces"]


def winning_stages(intervals: DataFrame, recordings: DataFrame, keys: list[str] = S.REC) -> DataFrame:
    """(keys, stretch, stages): the stage of each epoch of a stretch, ``UNSCORED`` where no interval lies.

    ``intervals`` (keys, from, to, ann_idx, stage) may overlap in any depth; the
    one with the largest ``ann_idx`` wins. Recordings are cut into stretches of
    4,096 epochs, intervals into aligned pieces of them. Equal pieces are
    reduced to their winner before anything is moved, so a stretch is made of
    fewer than 8,192 pieces however many annotations lie over each other, and a
    long recording is many groups.
    """
    size = 1 << _STRETCH_BITS
    begin = F.col("_stretch") * size
    parts = (
        intervals.select(
            *keys, "from", "to", "ann_idx", "stage",
            F.explode(F.sequence(F.shiftright("from", _STRETCH_BITS), F.shiftright("to", _STRETCH_BITS))).alias("_stretch"),
        )
        .select(
            *keys, "_stretch", "ann_idx", "stage",
            F.explode(
                _aligned_pieces(F.greatest(F.col("from") - begin, F.lit(0)), F.least(F.col("to") - begin, F.lit(size - 1)))
            ).alias("_piece"),
        )
        .groupBy(*keys, "_stretch", "_piece")
        .agg(F.max(F.struct("ann_idx", "stage")).alias("_best"))
        .select(*keys, "_stretch", F.struct("_best.ann_idx", "_best.stage", "_piece.first", "_piece.last").alias("_p"))
    )
    last = F.shiftright(F.col("n_epochs").cast("long") - 1, _STRETCH_BITS)
    stretches = recordings.filter(F.col("n_epochs") > 0).select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_stretch"),
        F.col("n_epochs").cast("long").alias("_n"),
    )
    grouped = (
        parts.withColumn("_n", F.lit(None).cast("long"))
        .unionByName(stretches, allowMissingColumns=True)
        .groupBy(*keys, "_stretch")
        .agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list("_p")).alias("_pieces"))
    )
    here = F.least(F.col("_n") - begin, F.lit(size)).cast("int")

    def paint(stages: Column, p: Column) -> Column:
        """Later annotations over earlier ones."""
        return F.concat(
            F.slice(stages, F.lit(1), p["first"]),
            F.array_repeat(p["stage"], p["last"] - p["first"] + 1),
            F.slice(stages, p["last"] + 2, F.greatest(here - p["last"] - 1, F.lit(0))),
        )

    painted = F.aggregate("_pieces", F.array_repeat(F.lit(S.UNSCORED), here), paint)
    return grouped.select(*keys, F.col("_stretch").alias("stretch"), painted.alias("stages"))


def expert_grid(
    annotations: DataFrame,
    recordings: DataFrame,
    dataset: DatasetSettings,
    keys: list[str] = S.REC,
) -> DataFrame:
    """J5: expert stage of each epoch on the grid from t = 0, ``UNSCORED`` where none.

    ``recordings`` carries ``n_epochs``. Annotations stay intervals until
    :func:`winning_stages` has settled which one holds where; epochs are made
    once, at the end.
    """
    sec = dataset.epoch_sec
    first = half_even(F.col("onset") / sec)
    steps = half_even(F.col("duration") / sec)
    intervals = (
        map_stages(annotations)
        .join(recordings.select(*keys, "n_epochs"), keys)
        .withColumn("from", F.greatest(first, F.lit(0)))
        .withColumn("to", F.least(first + steps, F.col("n_epochs").cast("long")) - 1)
        .filter(F.col("from") <= F.col("to"))
        .select(*keys, "from", "to", F.col("ann_idx").cast("long"), F.col("stage").cast("int"))
    )
    return winning_stages(intervals, recordings, keys).select(
        *keys, "stretch", F.posexplode("stages").alias("_at", "expert")
    ).select(*keys, (F.col("stretch") * (1 << _STRETCH_BITS) + F.col("_at")).cast("int").alias("epoch_idx"), "expert")


def with_expert(predicted: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """J6: predictions joined with the expert stages of the same epochs.

    Both sides are made by multiplying few rows (recordings, annotations) into
    epochs. The planner does not see that, takes a side for as small as what it
    is made of, and would send all its epochs through the driver to every task.
    So the join is asked to sort both sides, each task a part of the epochs.
    """
    return predicted.hint("merge").join(grid, on)
