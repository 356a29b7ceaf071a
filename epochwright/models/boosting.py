"""K-class gradient boosting on binned features, grown level by level over all partitions (ML1).

A round grows one tree per class on the softmax residuals of that class. Rows
stay where they are, packed into blocks of bins, labels, weights and raw
scores. For a level of the trees every task adds up its rows' weighted
residuals by class, node, feature and bin; one histogram serves all
classes, and the driver, which sees histograms only, picks the splits. The last
level's histogram also holds what the leaves need, so a round takes as many
passes as the trees are deep. Every ``RENEW`` rounds the blocks are written
again with their scores, so a pass never walks more than the last few trees and
a lost executor costs few rounds.

Sums are taken in whole numbers (multiples of 2**-24), so the fitted trees do not
depend on partitions, order or repeated tasks. For the same reason rows that one
task can hold may be boosted there without a job per level: it gives the same
trees to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.session import materialize

BINS = 64
BLOCK = 4_096
RENEW = 20
ONE_TASK_ROWS = 1 << 17  # up to so many rows (some megabytes) all rounds run in one task, with the same result
_FEW_TASKS = 64
_UNIT = float(2**24)
_LEFT = 255  # a cut that every bin is below
_BLOCKS = "bins binary, label binary, weight binary, raw binary"


@dataclass
class Ensemble:
    """Trees of equal depth in arrays: [round, class, node]; a row goes left if its bin is at most the cut."""

    edges: list[np.ndarray]  # of each feature, ascending; bin b ends at edge b
    prior: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.value.shape[2]).bit_length() - 1

    @classmethod
    def empty(cls, edges: list[np.ndarray], prior: np.ndarray, depth: int) -> "Ensemble":
        k, inner = len(prior), 2**depth - 1
        return cls(
            edges, prior, np.zeros((0, k, inner), np.int16), np.zeros((0, k, inner), np.uint8), np.zeros((0, k, inner + 1))
        )

    def thresholds(self) -> np.ndarray:
        """The cuts as feature values: left if the value is at most that; infinite where no split was made."""
        out = np.full(self.cut.shape, np.inf)
        for f, edges in enumerate(self.edges):
            at = (self.feature == f) & (self.cut < len(edges))
            out[at] = edges[self.cut[at]]
        return out


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) of bin numbers; what is not a number gets the last bin."""
    return np.stack([np.searchsorted(e, values[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, trees): the node of each row after the levels given, numbered within its level.

    ``feature`` and ``cut`` are (trees, nodes), nodes level by level.
    """
    trees = np.arange(len(feature))
    node = np.zeros((len(bins), len(feature)), dtype=np.int64)
    rows = np.arange(len(bins))[:, None]
    level = 0
    while 2**level - 1 < feature.shape[1]:
        at = node + (2**level - 1)
        node = 2 * node + (bins[rows, feature[trees, at]] > cut[trees, at])
        level += 1
    return node


def add_scores(raw: np.ndarray, bins: np.ndarray, trees: Ensemble, since: int = 0) -> np.ndarray:
    """``raw`` (rows, classes) and what the trees from round ``since`` on add to it, round by round.

    Always added in this order, so raw scores are the same to the last bit wherever they are made.
    """
    k = np.arange(len(trees.prior))
    for r in range(since, len(trees.value)):
        raw = raw + trees.value[r][k, walk(bins, trees.feature[r], trees.cut[r])]
    return raw


def softmax(raw: np.ndarray) -> np.ndarray:
    up = np.exp(raw - raw.max(axis=1, keepdims=True))
    return up / up.sum(axis=1, keepdims=True)


def residuals(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted residual and curvature (rows, classes) and the weight, in whole units."""
    r = np.eye(raw.shape[1])[label] - softmax(raw)
    w = weight[:, None]
    return np.rint(_UNIT * w * r), np.rint(_UNIT * w * np.abs(r) * (1 - np.abs(r))), np.rint(_UNIT * weight)


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, sums: tuple) -> np.ndarray:
    """(classes, nodes, features, BINS, 3): whole sums of residual, curvature and weight."""
    g, h, w = sums
    k, n_features = g.shape[1], bins.shape[1]
    out = np.zeros((k, nodes, n_features, BINS, 3))
    size = nodes * BINS
    for c in range(k):
        for f in range(n_features):
            cell = node[:, c] * BINS + bins[:, f]
            for i, values in enumerate((g[:, c], h[:, c], w)):
                out[c, :, f, :, i] += np.bincount(cell, values, size).reshape(nodes, BINS)
    return out


def best_splits(hist: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) for each class and node: the split that lowers the squared error of the residuals most."""
    left = np.cumsum(hist, axis=3)
    total = left[:, :, :, -1:, :]
    g, w = left[..., 0] / _UNIT, left[..., 2] / _UNIT
    g_all, w_all = total[..., 0] / _UNIT, total[..., 2] / _UNIT
    w_right = w_all - w
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = w * w_right / w_all * (g / w - (g_all - g) / w_right) ** 2
    usable = (w > 0) & (w_right > 0)
    for f, e in enumerate(edges):
        usable[:, :, f, len(e) :] = False
    gain = np.where(usable, gain, 0.0)
    k, nodes, n_features, n_bins = gain.shape
    flat = gain.reshape(k, nodes, -1)
    at = flat.argmax(axis=2)
    found = np.take_along_axis(flat, at[:, :, None], 2)[:, :, 0] > 1e-9
    feature = np.where(found, at // n_bins, 0)
    cut = np.where(found, at % n_bins, _LEFT)
    return feature.astype(np.int16), cut.astype(np.uint8)


def leaf_values(hist: np.ndarray, feature: np.ndarray, cut: np.ndarray, rate: float) -> np.ndarray:
    """(classes, leaves): a Newton step on each side of the last level's splits, times the learning rate."""
    k, nodes = feature.shape
    left = np.cumsum(hist, axis=3)
    at = np.minimum(cut, BINS - 1).astype(int)
    c, n = np.arange(k)[:, None], np.arange(nodes)[None, :]
    low = left[c, n, feature, at]
    high = left[c, n, feature, -1] - low
    sums = np.stack([low, high], axis=2).reshape(k, 2 * nodes, 3)
    g, h = sums[..., 0], sums[..., 1]
    step = (k - 1) / k * g / np.where(h > 0, h, 1.0)
    return rate * np.where(h > 0, step, 0.0)


def quantile_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 distinct cut points of each feature."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, shares, 1e-3)
    return [np.unique(np.array(e, dtype=float)) for e in found]


def pack_blocks(
    rows: DataFrame, features: list[str], edges, classes: list[int], weights: dict[int, float], prior: np.ndarray
) -> DataFrame:
    """Blocks of bins, labels, weights and first raw scores, written once; the signal is never read."""
    of_class = np.array([weights[c] for c in classes])
    known = np.array(classes)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            bins = np.concatenate([b for b, _ in held])
            label = np.concatenate([y for _, y in held])
            return pa.RecordBatch.from_pydict(
                {
                    "bins": [bins.tobytes()],
                    "label": [label.tobytes()],
                    "weight": [of_class[label].tobytes()],
                    "raw": [np.tile(prior, (len(label), 1)).tobytes()],
                },
                schema=_ARROW,
            )

        for part in parts:
            values = np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            label = np.searchsorted(known, part.column("stage").to_numpy(zero_copy_only=False)).astype(np.uint8)
            held.append((to_bins(values, edges), label))
            n += len(label)
            if n >= BLOCK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    wanted = rows.select("stage", *[F.col(f).cast("double").alias(f) for f in features])
    return materialize(wanted.mapInArrow(pack, _BLOCKS), "boosting-rows")


_ARROW = pa.schema([(name, pa.binary()) for name in ("bins", "label", "weight", "raw")])


def _unpacked(parts: Iterator[pa.RecordBatch], n_features: int, k: int):
    for part in parts:
        for bins, label, weight, raw in zip(*[part.column(c).to_pylist() for c in ("bins", "label", "weight", "raw")]):
            yield (
                np.frombuffer(bins, np.uint8).reshape(-1, n_features),
                np.frombuffer(label, np.uint8),
                np.frombuffer(weight),
                np.frombuffer(raw).reshape(-1, k),
            )


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        for sums in part.column("sums").to_pylist():
            sums = np.frombuffer(sums, np.int64)
            total = sums if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def level_histogram(
    blocks: DataFrame, tasks: int, trees: Ensemble, since: int, feature: np.ndarray, cut: np.ndarray
) -> np.ndarray:
    """The histogram of the next level, given the levels the round has so far (classes, nodes).

    Each of the ``tasks`` over the blocks gives one array of fixed size. If they are many, they are
    first added in about the root of their number of tasks, so the driver adds few.
    """
    k, n_features = len(trees.prior), len(trees.edges)
    nodes = feature.shape[1] + 1
    shape = (k, nodes, n_features, BINS, 3)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for bins, label, weight, raw in _unpacked(parts, n_features, k):
            raw = add_scores(raw, bins, trees, since)
            total += histogram(bins, walk(bins, feature, cut), nodes, residuals(raw, label, weight))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()])], names=["sums"])

    sums = blocks.mapInArrow(add, "sums binary")
    if tasks > _FEW_TASKS:
        sums = sums.repartition(int(tasks**0.5)).mapInArrow(_summed, "sums binary")
    total = np.zeros(int(np.prod(shape)), dtype=np.int64)
    for part in sums.toArrow().column("sums").to_pylist():
        total += np.frombuffer(part, np.int64)
    return total.reshape(shape).astype(float)


def renewed(blocks: DataFrame, trees: Ensemble, since: int) -> DataFrame:
    """The blocks with the trees from round ``since`` on added to their raw scores."""
    k, n_features = len(trees.prior), len(trees.edges)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, weight, raw in _unpacked(parts, n_features, k):
            row = {"bins": bins, "label": label, "weight": weight, "raw": add_scores(raw, bins, trees, since)}
            yield pa.RecordBatch.from_pydict({c: [v.tobytes()] for c, v in row.items()}, schema=_ARROW)

    return materialize(blocks.mapInArrow(add, _BLOCKS), "boosting-rows")


def grow_round(level, trees: Ensemble, depth: int, rate: float) -> Ensemble:
    """``trees`` and one more round; ``level(feature, cut)`` gives the histogram of the next level."""
    k = len(trees.prior)
    feature, cut = np.zeros((k, 0), np.int16), np.zeros((k, 0), np.uint8)
    for _ in range(depth):
        hist = level(feature, cut)
        found = best_splits(hist, trees.edges)
        feature, cut = np.hstack([feature, found[0]]), np.hstack([cut, found[1]])
    value = leaf_values(hist, *found, rate)
    return Ensemble(
        trees.edges,
        trees.prior,
        np.concatenate([trees.feature, feature[None]]),
        np.concatenate([trees.cut, cut[None]]),
        np.concatenate([trees.value, value[None]]),
    )


def grow_all(parts, trees: Ensemble, rounds: int, rate: float, depth: int) -> Ensemble:
    """All rounds over blocks of rows (bins, label, weight, raw) that one task holds."""
    blocks = [list(part) for part in parts]

    def level(feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        nodes = feature.shape[1] + 1
        return sum(histogram(b, walk(b, feature, cut), nodes, residuals(raw, y, w)) for b, y, w, raw in blocks)

    for done in range(rounds):
        trees = grow_round(level, trees, depth, rate)
        for block in blocks:
            block[3] = add_scores(block[3], block[0], trees, done)
    return trees


def _in_one_task(blocks: DataFrame, trees: Ensemble, rounds: int, rate: float, depth: int) -> Ensemble:
    k, n_features = len(trees.prior), len(trees.edges)

    def grow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = grow_all(_unpacked(parts, n_features, k), trees, rounds, rate, depth)
        fields = [made.feature.tobytes(), made.cut.tobytes(), made.value.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([f]) for f in fields], names=["feature", "cut", "value"])

    row = blocks.coalesce(1).mapInArrow(grow, "feature binary, cut binary, value binary").collect()[0]
    inner = 2**depth - 1
    return Ensemble(
        trees.edges,
        trees.prior,
        np.frombuffer(row["feature"], np.int16).reshape(rounds, k, inner),
        np.frombuffer(row["cut"], np.uint8).reshape(rounds, k, inner),
        np.frombuffer(row["value"]).reshape(rounds, k, inner + 1),
    )


def fit(
    rows: DataFrame, features: list[str], classes: list[int], counts: dict[int, int], weights: dict[int, float],
    rounds: int, rate: float, depth: int, one_task_rows: int = ONE_TASK_ROWS,
) -> Ensemble:
    """An ensemble from rows (stage, features); starts at the log of the classes' weighted shares."""
    edges = quantile_edges(rows, features)
    share = np.array([counts[c] * weights[c] for c in classes], dtype=float)
    trees = Ensemble.empty(edges, np.log(share / share.sum()), depth)
    blocks, since = pack_blocks(rows, features, edges, classes, weights, trees.prior), 0
    if sum(counts.values()) <= one_task_rows:
        return _in_one_task(blocks, trees, rounds, rate, depth)
    tasks = blocks.rdd.getNumPartitions()
    for done in range(rounds):
        if done - since == RENEW:
            blocks, since = renewed(blocks, trees, since), done
        trees = grow_round(lambda f, c: level_histogram(blocks, tasks, trees, since, f, c), trees, depth, rate)
    return trees
