"""A classifier on the raw epoch, trained in mini-batches with early stopping (ML2, ML3, ML7, ML9).

A round is one pass over the training rows. Every task starts from the shared
weights, takes Adam steps over mini-batches of its own rows, and gives its
weights back; their mean, weighted by rows, starts the next round. With one
task this is plain mini-batch training. Rows were spread over tasks by a hash
once, are permuted anew in every round, and are weighted by class in the loss;
none is discarded. Only weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.models.network import Adam, Shape
from epochwright.models.scoring import score_with
from epochwright.operators.agreement import agreement, headline
from epochwright.operators.cohort import class_weights
from epochwright.session import materialize
from epochwright.settings import RawModelSettings

HIDDEN = 32
_FEW_TASKS = 64
_MODEL = "inputs int, hidden int, classes int, factor int, weights array<double>"


def average_down(signal: Column, factor: int) -> Column:
    """Means of ``factor`` consecutive samples; ``factor`` divides the length (see :func:`train_raw`)."""
    if factor == 1:
        return signal.cast("array<double>")
    wide = signal.cast("array<double>")
    groups = F.sequence(F.lit(0), F.floor(F.size(signal) / factor).cast("int") - 1)

    def mean(i: Column) -> Column:
        part = F.slice(wide, i * factor + 1, factor)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / float(factor)

    return F.transform(groups, mean)


def signal_view(epochs: DataFrame, factor: int) -> DataFrame:
    """ML7: keys, stage and the averaged signal; the feature columns are never read."""
    keys = [c for c in epochs.columns if c != "signal" and c not in S.FEATURES]
    return epochs.select(*keys, average_down(F.col("signal"), factor).cast("array<float>").alias("signal"))


@dataclass
class RawModel:
    shape: Shape
    weights: np.ndarray
    factor: int
    history: list[dict] = field(default_factory=list)  # round, loss and validation macro-F1

    def score(self, epochs: DataFrame) -> DataFrame:
        """ML4: adds ``pred`` and ``proba``."""
        return self.score_view(signal_view(epochs, self.factor))

    def score_view(self, view: DataFrame) -> DataFrame:
        """The same for rows that already are averaged."""
        shape, weights = self.shape, self.weights
        keys = [c for c in view.columns if c != "signal"]
        return score_with(view, lambda: lambda x: shape.proba(weights, x.astype(float)), keys)

    def save(self, path: str) -> None:
        """SNK9."""
        row = (self.shape.inputs, self.shape.hidden, self.shape.classes, self.factor, self.weights.tolist())
        spark = SparkSession.active()
        spark.createDataFrame([row], _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RawModel":
        row = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
        shape = Shape(row["inputs"], row["hidden"], row["classes"])
        return cls(shape, np.array(row["weights"]), row["factor"])


def macro_f1(scored: DataFrame) -> float:
    """AGG16: macro-F1 of a scored table; one row reaches the driver."""
    return headline(agreement(scored, "stage", "pred")).first()["macro_f1"]


def _matrix(part: pa.RecordBatch, inputs: int) -> np.ndarray:
    signal = part.column("signal")
    lengths = signal.value_lengths().to_numpy(zero_copy_only=False)
    if signal.null_count or (lengths != inputs).any():
        raise ValueError(f"epochs of unequal length: {sorted(set(lengths))}, expected {inputs}")
    return signal.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, inputs)


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        for sums in part.column("sums").to_pylist():
            sums = np.frombuffer(sums)
            total = sums if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def train_round(
    rows: DataFrame, tasks: int, shape: Shape, state: Adam, of_class: np.ndarray, batch_size: int, rate: float, seed: int
) -> tuple[Adam, float]:
    """One pass over the rows (stage, signal) from ``state``; the mean state and the mean loss."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Adam(state.weights, state.mean, state.square, state.steps)
        rng, loss, seen = np.random.default_rng(seed), 0.0, 0
        x, y = np.zeros((0, shape.inputs)), np.zeros(0, dtype=np.int64)

        def take(x, y):
            value, gradient = shape.gradient(own.weights, x, y, of_class[y])
            own.step(gradient, rate)
            return value * len(y), len(y)

        for part in parts:
            order = rng.permutation(part.num_rows)
            x = np.vstack([x, _matrix(part, shape.inputs)[order]])
            y = np.r_[y, part.column("stage").to_numpy(zero_copy_only=False)[order]]
            while len(y) >= batch_size:
                value, n = take(x[:batch_size], y[:batch_size])
                loss, seen, x, y = loss + value, seen + n, x[batch_size:], y[batch_size:]
        if len(y):
            value, n = take(x, y)
            loss, seen = loss + value, seen + n
        if seen:
            flat = np.concatenate([seen * own.weights, seen * own.mean, seen * own.square, [seen * own.steps, loss, seen]])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()])], names=["sums"])

    sums = rows.select("stage", "signal").mapInArrow(run, "sums binary")
    if tasks > _FEW_TASKS:  # added in few tasks first, so the driver adds few
        sums = sums.repartition(int(tasks**0.5)).mapInArrow(_added, "sums binary")
    total = sum(np.frombuffer(part) for part in sums.toArrow().column("sums").to_pylist())
    mean, n = total / total[-1], shape.size
    return Adam(mean[:n], mean[n : 2 * n], mean[2 * n : 3 * n], mean[-3]), float(mean[-2])


def train_raw(
    train: DataFrame,
    val: DataFrame,
    settings: RawModelSettings,
    epoch_samples: int,
    factor: int = 1,
    seed: int = 42,
    hidden: int = HIDDEN,
) -> RawModel:
    """ML2 + ML3: passes of mini-batch training, each starting from the last mean weights.

    After a round the validation macro-F1 is taken; the best round is kept and
    ``patience`` rounds without a better one end the training.
    """
    if epoch_samples % factor:
        raise ValueError(f"averaging factor {factor} does not divide {epoch_samples} samples")
    weights = {r["stage"]: float(r["weight"]) for r in class_weights(train).collect()}  # a row per stage
    balanced = settings.class_weights == "auto"
    of_class = np.array([weights.get(c, 0.0) if balanced else 1.0 for c in S.STAGES])
    shape = Shape(epoch_samples // factor, hidden, S.N_STAGES)
    # spread and ordered by a hash, so neighbours in time do not share a mini-batch
    turn = F.xxhash64(F.lit(seed), *[c for c in train.columns if c in (*S.REC, "epoch_idx")])
    rows = signal_view(train, factor).select("stage", "signal", turn.alias("_turn"))
    rows = materialize(rows.repartition("_turn").sortWithinPartitions("_turn"), "raw-rows")
    tasks = rows.rdd.getNumPartitions()
    checked = materialize(signal_view(val, factor), "raw-checked")  # averaged once, not once per round
    best, best_f1, stale, history = None, -1.0, 0, []
    state = Adam.at(shape.start(seed))
    for number in range(settings.rounds):
        state, loss = train_round(
            rows, tasks, shape, state, of_class, settings.batch_size, settings.learning_rate, seed + number
        )
        f1 = macro_f1(RawModel(shape, state.weights, factor).score_view(checked))
        history.append({"round": number + 1, "loss": loss, "macro_f1": f1})
        if f1 > best_f1:
            best, best_f1, stale = state.weights, f1, 0
        else:
            stale += 1
        if stale and stale >= settings.patience:
            break
    return RawModel(shape, best, factor, history)
