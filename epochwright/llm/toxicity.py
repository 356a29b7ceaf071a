"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Words are weighted by their log odds in toxic against clean labelled texts,
taken at the low end of a confidence interval, so chance companions drop out.
Texts are folded before matching: letter case, look-alike letters of other
alphabets, and digits or signs that stand for letters inside words. One pass of
the automaton finds lexicon words and exception phrases; a word inside an
exception phrase does not count. A logistic function of the summed weights and
of their share of the text's length, fitted on labelled rows that did not shape
the lexicon, gives the score.

Results for odd input: a null text is an empty one and is scored like any text
without a hit; without labels of both kinds every score is 0; repeated rows are
scored alike; a label given twice counts as toxic if either says so; no rows
give no rows; columns other than doc_id and text are never looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import map_once, text_or_empty
from epochwright.session import materialize

# fixed values: look-alikes and the letters they stand for, and signs used for letters
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "idiot proof", "loser bracket",
)

SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 16_000  # labelled rows to learn from, about
MIN_WEIGHT = 1.5  # least log odds, at the low end
MIN_ROWS = 3  # toxic rows a word must be in

_TABLE = str.maketrans({**LOOKALIKES, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **dict.fromkeys(HIDDEN)})
_ODD = re.compile("[" + "".join(LOOKALIKES) + HIDDEN + "ａ-ｚ]")
_MIXED = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])[\w@$]*[0134578@$][\w@$]*")
_NEAR = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]")
_SIGN_TABLE = str.maketrans(SIGNS)


def fold(text: str) -> str:
    """Lower case, look-alikes and signs inside words replaced, invisible characters removed."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_TABLE)
    if _NEAR.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_SIGN_TABLE), text)
    return text


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    means: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scales: np.ndarray = field(default_factory=lambda: np.ones(4))
    coefficients: np.ndarray | None = None


def automaton(model: Model):
    """An automaton over words (with weights) and exception phrases (with None); None if both are empty."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in model.exceptions:
        made.add_word(phrase, (len(phrase), None))
    for word, weight in model.weights.items():
        made.add_word(word, (len(word), weight))
    if not len(made):
        return None
    made.make_automaton()
    return made


def hits(text: str, machine) -> list[tuple[int, int, float]]:
    """(begin, end, weight) in the folded text of each lexicon word that no exception phrase covers."""
    if machine is None:
        return []
    found, covered = [], []
    for last, (length, weight) in machine.iter(text):
        begin, end = last - length + 1, last + 1
        if (begin and text[begin - 1].isalpha()) or (end < len(text) and text[end].isalpha()):
            continue  # part of a longer word
        if weight is None:
            covered.append((begin, end))
        else:
            found.append((begin, end, weight))
    if covered:
        covered.sort()
        begins = [b for b, _ in covered]
        reach = list(accumulate((e for _, e in covered), max))  # of all phrases that begin so early
        found = [h for h in found if h[0] < begins[0] or reach[bisect_right(begins, h[0]) - 1] < h[1]]
    return found


def features(text: str | None, machine) -> tuple[float, float, float, float]:
    folded = fold(text or "")
    found = hits(folded, machine)
    total, words = sum(h[2] for h in found), folded.count(" ") + folded.count("\n") + 1
    return (
        math.log1p(total),
        math.log1p(100 * total / (words + 20)),
        math.log1p(len(found)),
        math.log1p(words) if found else 0.0,
    )


def probability(rows: np.ndarray, model: Model) -> np.ndarray:
    if model.coefficients is None:
        return np.zeros(len(rows))
    x = (rows - model.means) / model.scales
    return 1 / (1 + np.exp(-np.clip(x @ model.coefficients[1:] + model.coefficients[0], -30, 30)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small penalty on all but the constant."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scan(model: Model, score: bool):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model)
        for part in parts:
            rows = np.array([features(t, machine) for t in part.column("text").to_pylist()]).reshape(-1, 4)
            keep = [c for c in part.schema.names if c != "text"]
            made = pa.array(probability(rows, model)) if score else pa.array(rows.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], made], names=[*keep, "score" if score else "features"]
            )

    return batches


def _sample(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(text, toxic, part) of a bounded sample of labelled rows, chosen by hash; part 0 to 9."""
    known = labels.filter(F.col("toxic").isNotNull() & learn_from).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("long")).alias("toxic")
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / max(sizes.get(1, 0), 1)).otherwise(
        SAMPLE_CLEAN / max(sizes.get(0, 0), 1)
    )
    chosen = known.filter(draw(1) < share).select("doc_id", "toxic", F.floor(draw(2) * 10).alias("part"))
    # the sample's size is bounded by the two parameters, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    # one text for each id, however many rows share it
    once = joined.groupBy("doc_id", "toxic", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(once, "toxicity-sample")


def _folder(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        folded = pa.array([fold(t) for t in part.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("toxic"), folded], names=["toxic", "text"])


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Words of labelled rows (text, toxic), as they are once folded, with their weights."""
    rows = map_once(rows.select("toxic", "text"), _folder, "toxic long, text string", "folded-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    words = F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")
    counts = rows.select("toxic", words).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    low = odds - 1.96 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    kept = counts.filter((F.col("bad") >= MIN_ROWS) & (F.length("word") >= 3)).select("word", low.alias("weight"))
    # bounded by the sample: each word is in at least MIN_ROWS of its toxic rows
    return {r["word"]: round(r["weight"], 4) for r in kept.filter(F.col("weight") >= MIN_WEIGHT).collect()}


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from labelled rows (doc_id, toxic) that satisfy ``learn_from``.

    Seven tenths of the sample shape the lexicon, the others the score.
    """
    sample = _sample(docs, labels, learn_from)
    model = Model(lexicon(sample.filter("part < 7")), exceptions)
    rest = map_once(
        sample.filter("part >= 7").select("doc_id", "toxic", "text"),
        _scan(model, False),
        "doc_id long, toxic long, features array<double>",
        "toxicity-features",
    ).collect()  # bounded by the sample: four numbers a row
    y = np.array([r["toxic"] for r in rest], dtype=float)
    if len(rest) and 0 < y.sum() < len(y):
        x = np.array([r["features"] for r in rest])
        model.means, model.scales = x.mean(axis=0), x.std(axis=0) + 1e-6
        model.coefficients = fit_logistic((x - model.means) / model.scales, y)
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from the whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_once(rows, _scan(model, True), "doc_id long, score double", "toxicity-scores")


def _keep_clean(model: Model, threshold: float):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model)
        for part in parts:
            rows = np.array([features(t, machine) for t in part.column("text").to_pylist()]).reshape(-1, 4)
            yield part.filter(pa.array(probability(rows, model) < threshold))

    return batches


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns untouched."""
    return map_once(docs, _keep_clean(model, threshold), docs.schema, "clean-documents")
