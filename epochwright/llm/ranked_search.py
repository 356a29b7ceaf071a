"""Ranked lexical search as a blocked dense matrix product.

Terms are runs of letters, digits and bytes beyond ASCII, with A-Z lowered. The
items' own terms make a compact vocabulary; a document is reduced to its length
and its counts of those terms. Scores are then products of tiles: item weights
(items x terms) times document impacts (terms x documents), in float64. Every
entry is a whole number, and a tile has so few terms that no partial sum reaches
2**53, so each product is exact in any order of summation; tiles are added as
64-bit integers. A tile gives only documents at or above the score that the
item's ``k``-th best so far has, ties included, so ties are settled by doc_id
alone.

Items are taken in passes of bounded vocabulary (``PASS_TERMS``), so what goes
to the tasks is bounded however many items there are; corpus counts come from
all documents. A task returns at most ``k`` rows an item.

Results for odd input: a null text, or one without a term, matches nothing;
items of equal item_id are one item with the terms of all (a null item_id too);
every row of ``docs`` is a document of its own, so repeated rows are all ranked,
ties beyond doc_id (null last) broken by row; other columns are not looked at;
no items or no documents give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochwright.llm.common import map_once
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize

TOP = 10
PASS_TERMS = 500_000  # (item, term) pairs of a pass, besides those of its last item
ITEM_TILE = 256
TERM_TILE = 1_024
_SLICE = 1 << 20
_SALTS = 32
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_BREAKS + _UPPER, b" " * len(_BREAKS) + _UPPER.lower())

# exact: a weight is below 1000 * ln(2**64) < 45,000, an impact at most 1,000,000
assert TERM_TILE * 45_000 * 1_000_000 < 2**53


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about a megabyte of text."""
    data = (text or "").encode().translate(_FOLD)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + _SLICE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _term_lister(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [sorted({t for some in terms(text) for t in some}) for text in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("item_id"), pa.array([[t.decode() for t in x] for x in found], pa.list_(pa.string()))],
            names=["item_id", "terms"],
        )


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, pass): distinct terms of each item, numbered, with the pass that takes it."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed = map_once(rows, _term_lister, "item_id long, terms array<string>", "item-terms")
    whole = materialize(
        listed.select("item_id", F.explode("terms").alias("term"))
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_set("term")).alias("terms")),
        "items",
    )
    numbered = number_rows(whole, [], ["item_id"], {"_before": F.size("terms")}, out="item")
    return numbered.select(
        "item", "item_id", "terms", F.floor(F.col("_before") / PASS_TERMS).cast("int").alias("pass")
    )


def _counter(vocabulary: dict[bytes, int]):
    """doc_id, n and the (term, tf) of the vocabulary in each document."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths, ids, counts = [], [], []
            for text in part.column("text").to_pylist():
                tf: Counter = Counter()
                for some in terms(text):
                    tf.update(some)
                lengths.append(tf.total())
                held = [(vocabulary[t], c) for t, c in tf.items() if t in vocabulary]
                ids.append([i for i, _ in held])
                counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "ids", "tf"],
            )

    return batches


def _best(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The ``k`` best of each item: highest score, then lowest doc_id, those without one last."""
    order = np.lexsort((found["row"], found["doc"], found["no_id"], -found["score"], found["item"]))
    item = found["item"][order]
    first = np.r_[True, item[1:] != item[:-1]]
    starts = np.flatnonzero(first)
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    keep = order[rank < k]
    return {name: values[keep] for name, values in found.items()}


class _ItemTile:
    """Weights of up to ``ITEM_TILE`` items, by term, with the best documents so far."""

    def __init__(self, first: int, held: list[np.ndarray], weights: np.ndarray) -> None:
        self.first, self.size = first, len(held)
        term = np.concatenate(held)
        order = np.argsort(term, kind="stable")
        self.item = np.repeat(np.arange(self.size), [len(h) for h in held])[order]
        self.term = term[order]
        self.begins = np.searchsorted(self.term, np.arange(len(weights) + 1))
        self.weights = weights
        self.floor = np.ones(self.size, dtype=np.int64)  # a score above 0 is asked for
        self.best: dict[str, np.ndarray] | None = None

    def scores(self, present: np.ndarray, column: np.ndarray, place: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Exact scores (items x documents) from the impacts of the terms ``present`` in a tile of documents."""
        total = np.zeros((self.size, docs), dtype=np.int64)
        for begin in range(0, len(present), TERM_TILE):
            some = present[begin : begin + TERM_TILE]
            sizes = self.begins[some + 1] - self.begins[some]
            at = np.repeat(self.begins[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            left = np.zeros((self.size, len(some)))
            left[self.item[at], np.repeat(np.arange(len(some)), sizes)] = np.repeat(self.weights[some], sizes)
            inside = (column >= begin) & (column < begin + len(some))
            right = np.zeros((len(some), docs))
            right[column[inside] - begin, place[inside]] = impact[inside]
            total += (left @ right).astype(np.int64)
        return total

    def keep(self, total: np.ndarray, doc: np.ndarray, no_id: np.ndarray, row: np.ndarray, k: int) -> None:
        item, at = np.nonzero(total >= self.floor[:, None])
        if not len(item):
            return
        found = {"item": item, "score": total[item, at], "doc": doc[at], "no_id": no_id[at], "row": row[at]}
        if self.best is not None:
            found = {name: np.concatenate([self.best[name], values]) for name, values in found.items()}
        self.best = _best(found, k)
        counts = np.bincount(self.best["item"], minlength=self.size)
        last = np.cumsum(counts) - 1
        full = counts == k
        self.floor[full] = self.best["score"][last[full]]


def _scorer(held: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Best documents of a task's rows for every item of the pass."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [
            _ItemTile(first, held[first : first + ITEM_TILE], weights) for first in range(0, len(held), ITEM_TILE)
        ]
        seen = 0
        for part in parts:
            ids, tf = part.column("ids"), part.column("tf")
            term = ids.flatten().to_numpy()
            place = np.repeat(np.arange(part.num_rows), ids.value_lengths().to_numpy())
            n = part.column("n").to_numpy()
            norm = 10 + (90 * n * n_docs) // n_terms
            tf = tf.flatten().to_numpy()
            impact = (1_000_000_000 * tf) // (1_000 * tf + 8 * norm[place])
            present, column = np.unique(term, return_inverse=True)
            doc = part.column("doc_id")
            no_id = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            row = np.arange(seen, seen + part.num_rows)
            seen += part.num_rows
            for tile in tiles:
                tile.keep(tile.scores(present, column, place, impact.astype(np.float64), part.num_rows), doc, no_id, row, k)
        for tile in tiles:
            if tile.best is not None:
                best = tile.best
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(best["item"] + tile.first, pa.int64()),
                        pa.array(best["score"], pa.int64()),
                        pa.array(best["doc"], pa.int64(), mask=best["no_id"]),
                        pa.array(best["row"], pa.int64()),
                    ],
                    names=["at", "score", "doc_id", "row"],
                )

    return batches


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_part"), F.asc("row")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _one_pass(docs: DataFrame, block: list, k: int) -> DataFrame:
    """at, score, doc_id, rank: the best documents for a block of items, numbered by their place in it."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in block for t in item["terms"]}))}
    held = [np.array([vocabulary[t] for t in item["terms"]], dtype=np.int64) for item in block]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_once(
        rows,
        _counter({t.encode(): i for t, i in vocabulary.items()}),
        "doc_id long, n long, ids array<int>, tf array<long>",
        "term-counts",
    )
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms:
        return spark.createDataFrame([], "at long, score long, doc_id long, rank int")
    # no more rows than the pass has terms
    df = dict(counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
    weights = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))],
        dtype=np.float64,
    )
    best = map_once(
        counted.filter(F.size("ids") > 0),
        _scorer(held, weights, n_docs, n_terms, k),
        "at long, score long, doc_id long, row long",
        "task-bests",
    )
    # tasks' rows are merged in two steps, so no group is larger than tasks / _SALTS * k
    parts = best.withColumn("_part", F.xxhash64(F.col("_metadata.file_path")))
    parts = _ranked(parts.withColumn("_salt", F.pmod(F.col("_part"), F.lit(_SALTS))), ["at", "_salt"], k)
    return _ranked(parts.drop("rank"), ["at"], k).select("at", "score", "doc_id", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents with a score above 0 for each item."""
    wanted = materialize(item_terms(items), "items-numbered")
    passes = [row[0] for row in wanted.select("pass").distinct().orderBy("pass").collect()]
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in passes:
        mine = wanted.filter(F.col("pass") == number)
        block = mine.orderBy("item").collect()  # bounded by PASS_TERMS
        first = block[0]["item"]
        best = _one_pass(docs, block, k)
        named = best.join(mine.select((F.col("item") - first).alias("at"), "item_id"), "at")
        found = found.unionByName(
            materialize(named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        )
    return found
