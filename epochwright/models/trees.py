"""Boosted trees on the feature table (ML1, ML6, ML7, SNK9)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwright import schema as S
from epochwright.functions.arrays import argmax
from epochwright.models.boosting import Ensemble, add_scores, fit, softmax, to_bins
from epochwright.operators.cohort import class_weights
from epochwright.settings import TreeSettings

_TREES = "round int, class int, feature array<int>, cut array<int>, value array<double>"


def feature_view(epochs: DataFrame) -> DataFrame:
    """ML7 / FLT18: the epochs without the signal, which is never read."""
    return epochs.drop("signal")


@dataclass
class TreeModel:
    """A fitted ensemble and the stages it was trained on, in label order."""

    trees: Ensemble
    classes: list[int]

    def score(self, epochs: DataFrame) -> DataFrame:
        """ML4 + ML6: ``pred`` and ``proba`` (one value per stage, summing to 1) instead of the features."""
        kept = [c for c in feature_view(epochs).columns if c not in S.FEATURES]
        out = T.StructType(
            [epochs.schema[c] for c in kept]
            + [T.StructField("pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))]
        )
        trees, classes = self.trees, np.array(self.classes)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                values = np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in S.FEATURES], axis=1)
                bins = to_bins(values.astype(float), trees.edges)
                chance = softmax(add_scores(np.tile(trees.prior, (len(bins), 1)), bins, trees))
                proba = np.zeros((part.num_rows, S.N_STAGES))
                proba[:, classes] = chance
                offsets = np.arange(0, proba.size + 1, S.N_STAGES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in kept],
                        pa.array(proba.argmax(axis=1).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(proba.reshape(-1))),
                    ],
                    names=[*kept, "pred", "proba"],
                )

        return epochs.select(*kept, *[F.col(f).cast("double").alias(f) for f in S.FEATURES]).mapInArrow(run, out)

    def save(self, path: str) -> None:
        """SNK9: a row per tree, and the rest as one document."""
        spark, t = SparkSession.active(), self.trees
        rows = [
            (r, k, t.feature[r, k].tolist(), t.cut[r, k].tolist(), t.value[r, k].tolist())
            for r in range(len(t.value))
            for k in range(len(self.classes))
        ]
        spark.createDataFrame(rows, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        rest = {
            "classes": self.classes,
            "prior": t.prior.tolist(),
            "edges": [e.tolist() for e in t.edges],
            "depth": t.depth,
        }
        spark.createDataFrame([(json.dumps(rest),)], "document string").write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeModel":
        rest = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
        rows = spark.read.schema(_TREES).parquet(f"{path}/trees").orderBy("round", "class").collect()
        k, inner = len(rest["classes"]), 2 ** rest["depth"] - 1
        trees = Ensemble(
            [np.array(e) for e in rest["edges"]],
            np.array(rest["prior"]),
            np.array([r["feature"] for r in rows], np.int16).reshape(-1, k, inner),
            np.array([r["cut"] for r in rows], np.uint8).reshape(-1, k, inner),
            np.array([r["value"] for r in rows], float).reshape(-1, k, inner + 1),
        )
        return cls(trees, rest["classes"])


def portable_score(model: TreeModel, epochs: DataFrame) -> DataFrame:
    """AGG18: the same ensemble as column expressions on the feature values, without Python on the workers.

    Written apart from :meth:`TreeModel.score`: trees are node arrays with
    thresholds in place of bins, and are walked by nested aggregates.
    """
    t = model.trees
    # a node without a split looks at a constant beyond the features and goes left
    constant = len(S.FEATURES)
    threshold = t.thresholds()
    feature = np.where(np.isinf(threshold), constant, t.feature)
    threshold = np.where(np.isinf(threshold), 0.0, threshold)
    x = F.array(*[F.col(f).cast("double") for f in S.FEATURES], F.lit(0.0))
    levels = F.sequence(F.lit(1), F.lit(t.depth))
    leaves = t.value.shape[2]

    def raw(k: int) -> Column:
        rows = [
            {"f": f.tolist(), "t": s.tolist(), "v": v.tolist()}
            for f, s, v in zip(feature[:, k], threshold[:, k], t.value[:, k])
        ]
        trees = F.from_json(F.lit(json.dumps(rows)), "array<struct<f: array<int>, t: array<double>, v: array<double>>>")

        def leaf(tree: Column) -> Column:
            down = lambda at, _: 2 * at + 1 + F.when(
                F.get(F.col("_x"), F.get(tree["f"], at)) > F.get(tree["t"], at), 1
            ).otherwise(0)
            return F.aggregate(levels, F.lit(0), down) - (leaves - 1)

        return F.aggregate(trees, F.lit(float(t.prior[k])), lambda total, tree: total + F.get(tree["v"], leaf(tree)))

    kept = [c for c in feature_view(epochs).columns if c not in S.FEATURES]
    by_stage = {c: raw(k) for k, c in enumerate(model.classes)}
    raws = F.array(*[by_stage.get(c, F.lit(None).cast("double")) for c in S.STAGES])
    scored = epochs.select(*kept, x.alias("_x")).withColumn("_raw", raws)
    up = F.transform("_raw", lambda r: F.coalesce(F.exp(r - F.array_max("_raw")), F.lit(0.0)))
    total = F.aggregate("_up", F.lit(0.0), lambda acc, u: acc + u)
    return (
        scored.withColumn("_up", up)
        .withColumn("_total", total)
        .withColumn("proba", F.transform("_up", lambda u: u / F.col("_total")))
        .withColumn("pred", argmax(F.col("proba")).cast("int"))
        .select(*kept, "pred", "proba")
    )


def train_trees(epochs: DataFrame, settings: TreeSettings, balanced: bool = True) -> TreeModel:
    """ML1: one ensemble for all stages, rows weighted by class balance."""
    rows = feature_view(epochs)
    found = class_weights(rows).collect()  # a row per stage
    if not found:
        raise ValueError("no training rows")
    classes = sorted(r["stage"] for r in found)
    counts = {r["stage"]: r["n"] for r in rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {r["stage"]: float(r["weight"]) if balanced else 1.0 for r in found}
    trees = fit(
        rows, S.FEATURES, classes, counts, weights, settings.rounds, settings.learning_rate, settings.max_depth
    )
    return TreeModel(trees, classes)
