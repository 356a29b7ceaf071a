"""Language identification with a bidirectional gated recurrent network over bytes.

Two recurrent layers with piecewise linear gates read windows of bytes from left to right and from right to
left; a softmax over both states labels every position, and a document's
language is the one with the largest mean log probability over all its
positions. The network is trained in numpy by backpropagation through time on
stretches of a bounded sample of labelled rows. Scoring reads whole texts,
window by window, many windows at a time.

Results for odd input: ``und`` with score 0 for a null text or one without a
letter; if no labelled row can be learned from, every text is ``und``; repeated
rows are scored alike; only doc_id, text and lang are looked at, lang never to
predict; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import map_once

UNKNOWN = "und"
SAMPLE_PER_LANG = 400  # labelled rows per language to learn from, about
STRETCH = 1_024  # characters of each, from a place that a hash chooses
WINDOW = 128  # bytes read in one go
TRAIN_WINDOW = 48
HIDDEN = 8
STEPS = 260
BATCH = 192
RATE = 0.02
AT_ONCE = 4_096  # windows scored together


@dataclass
class Network:
    """Weights of both directions: byte table, recurrent matrix, bias of the new state; and the output."""

    langs: list[str]
    table: list[np.ndarray]  # 256 x 3H: update, reset, new
    recur: list[np.ndarray]  # H x 3H
    out: np.ndarray  # 2H x L
    bias: np.ndarray  # L


def _start(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    return Network(
        langs,
        [draw(256, 3 * hidden) * 0.3 for _ in range(2)],
        [draw(hidden, 3 * hidden) / np.float32(np.sqrt(hidden)) * 0.5 for _ in range(2)],
        draw(2 * hidden, len(langs)) * 0.1,
        np.zeros(len(langs), np.float32),
    )


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of three straight lines: many times cheaper than an exponential."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _forward(data: np.ndarray, table: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each byte of ``data`` (T x B), and what the way back needs."""
    hidden = recur.shape[0]
    h = np.zeros((data.shape[1], hidden), np.float32)
    states, kept = np.empty((len(data), data.shape[1], hidden), np.float32), []
    for t, byte in enumerate(data):
        x, u = table[byte], h @ recur
        zr = _gate(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.clip(x[:, 2 * hidden :] + r * u[:, 2 * hidden :], -1, 1)
        kept.append((h, z, r, n, u[:, 2 * hidden :]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(data: np.ndarray, grads: np.ndarray, kept: list, recur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent matrix, back through all steps."""
    hidden = recur.shape[0]
    d_table, d_recur = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(recur)
    carry = np.zeros_like(grads[0])
    for t in range(len(data) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        d = grads[t] + carry
        dn = d * (1 - z) * (np.abs(n) < 1)
        dz = d * (h - n) * (0.25 * ((z > 0) & (z < 1)))
        dr = dn * un * (0.25 * ((r > 0) & (r < 1)))
        pre = np.concatenate([dz, dr, dn], axis=1)
        through = np.concatenate([dz, dr, dn * r], axis=1)
        np.add.at(d_table, data[t], pre)
        d_recur += h.T @ through
        carry = d * z + through @ recur.T
    return d_table, d_recur


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def train(texts: list[str], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 3) -> Network:
    """A network from labelled stretches, languages drawn equally often; Adam with falling rate."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = _start(langs, hidden, rng)
    streams = [
        np.frombuffer(b"\n".join(t.encode() for t, y in zip(texts, labels) if y == lang) + b"\n" * TRAIN_WINDOW, np.uint8)
        for lang in langs
    ]
    params = [*net.table, *net.recur, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        at = [int(rng.integers(0, len(streams[k]) - TRAIN_WINDOW + 1)) for k in y]
        data = np.stack([streams[k][a : a + TRAIN_WINDOW] for k, a in zip(y, at)], axis=1)
        ahead, kept_a = _forward(data, net.table[0], net.recur[0])
        back, kept_b = _forward(data[::-1], net.table[1], net.recur[1])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        d = np.exp(_log_softmax(both @ net.out + net.bias))
        d[:, np.arange(BATCH), y] -= 1
        d /= np.float32(BATCH * TRAIN_WINDOW)
        flat = d.reshape(-1, len(langs))
        d_both = d @ net.out.T
        half = hidden
        ta, ra = _backward(data, d_both[:, :, :half], kept_a, net.recur[0])
        tb, rb = _backward(data[::-1], d_both[::-1, :, half:], kept_b, net.recur[1])
        grads = [ta, tb, ra, rb, both.reshape(-1, 2 * hidden).T @ flat, flat.sum(axis=0)]
        rate = RATE * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, m, v in zip(params, grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _read(data: np.ndarray, table: np.ndarray, recur: np.ndarray) -> np.ndarray:
    """As :func:`_forward` without what training needs: states (T x H x B), windows along the last axis.

    ``table`` (3H x 256) and ``recur`` (3H x H) hold the slope and offset of the gates.
    """
    hidden = recur.shape[1]
    h = np.zeros((hidden, data.shape[1]), np.float32)
    states = np.empty((len(data), hidden, data.shape[1]), np.float32)
    for t, byte in enumerate(data):
        x, u = np.take(table, byte, axis=1), recur @ h
        gates = x[: 2 * hidden]
        gates += u[: 2 * hidden]
        np.clip(gates, 0, 1, out=gates)
        n = u[2 * hidden :]
        n *= gates[hidden:]
        n += x[2 * hidden :]
        np.clip(n, -1, 1, out=n)
        h -= n
        h *= gates[:hidden]
        h += n
        states[t] = h
    return states


def position_scores(net: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probabilities (window, position, language); positions from ``lengths`` on are 0.

    The last window of a text is filled up with spaces, read but not counted.
    """
    hidden = net.recur[0].shape[0]
    slope = np.repeat(np.array([0.25, 0.25, 1.0], np.float32), hidden)
    offset = np.repeat(np.array([0.5, 0.5, 0.0], np.float32), hidden)
    ready = [np.ascontiguousarray((w * slope + b).T) for w, b in zip((*net.table, *net.recur), (offset, offset, 0, 0))]
    data = np.ascontiguousarray(windows.T).astype(np.intp)
    logits = net.out[:hidden].T @ _read(data, ready[0], ready[2])
    logits += net.out[hidden:].T @ _read(data[::-1], ready[1], ready[3])[::-1]
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    logits *= (np.arange(windows.shape[1])[:, None] < lengths)[:, None, :]
    return logits.transpose(2, 0, 1)


def document_scores(net: Network, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean log probability per language of texts that lie end to end in ``data``, text i up to ``ends[i]``."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    per_text = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(ends)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = begins[owner] + nth * WINDOW
    length = np.minimum(WINDOW, ends[owner] - start)
    sums = np.zeros((len(ends), len(net.langs)))
    padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    for k in range(0, len(owner), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        windows = padded[start[part, None] + np.arange(WINDOW)]
        windows = np.where(np.arange(WINDOW) < length[part, None], windows, np.uint8(32))
        scored = position_scores(net, windows, length[part]).sum(axis=1)
        np.add.at(sums, owner[part], scored)
    return sums / np.maximum(sizes, 1)[:, None]


def _predictor(net: Network):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column("text").cast(pa.large_string())
            texts = column if column.null_count == 0 else column.fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            content = texts.buffers()[2]
            data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
            data = data[offsets[0] : offsets[-1]]
            known = np.array(part.column("has_letter").to_pylist(), dtype=bool)
            scores = document_scores(net, data, offsets[1:] - offsets[0])
            chance = np.exp(scores - scores.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array([net.langs[b] if k else UNKNOWN for b, k in zip(best, known)]),
                    pa.array(np.where(known, chance.max(axis=1), 0.0)),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return batches


def sample(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], list[str]]:
    """About ``per_lang`` different labelled rows of each language, chosen by hash, a stretch of each.

    A row is known by its doc_id and text together, so rows that share an id, or
    have none, are drawn one by one, and copies count once. At most twice the
    wanted number of rows is taken, those with the lowest hash.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text"))
    different = F.approx_count_distinct("_row").alias("n")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(different).collect()}
    texts, labels = [], []
    if counts:
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_lang / n)])
        draw = F.xxhash64("_row", F.lit(1))
        place = F.pmod(F.xxhash64("_row", F.lit(2)), F.greatest(F.length("text") - STRETCH, F.lit(1)))
        chosen = rows.filter(draw < share[F.col("lang")] * 2.0**64 - 2.0**63).select(
            "lang", draw.alias("_draw"), F.substring("text", (place + 1).cast("int"), F.lit(STRETCH)).alias("text")
        )
        lowest = chosen.distinct().sort("_draw", "lang", "text").limit(2 * per_lang * len(counts))
        for r in sorted(lowest.collect(), key=lambda r: (r["lang"], r["text"])):
            texts.append(r["text"])
            labels.append(r["lang"])
    return texts, labels


def identify(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows where ``held_out`` is true teach nothing."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "text",
        "lang",
    )
    texts, labels = sample(rows.filter(~F.col("held_out")))
    rows = rows.select(
        "doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    )
    if not texts:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    net = train(texts, labels)
    return map_once(
        rows, _predictor(net), "doc_id long, held_out boolean, lang_pred string, score double", "languages"
    )
