"""Packing token pieces into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences from its start; what remains
(less than a sequence) is one piece. Pieces are counted by length, rounded up
to a few tokens, into a histogram of bounded size. A linear program over
patterns (how many pieces of each length share a sequence) is solved by column
generation: a revised simplex keeps the basis, and a knapsack by dynamic
programming prices new patterns. Solutions are rounded down, and the few pieces
left over are packed first-fit by decreasing length. Then pieces are ranked
within their length, and the sequences of all patterns, spread evenly, take them
in that order: only the histogram meets in one place, never the pieces. So the
order of the pieces, such as a mix of sources, is that of the sequences.

Results for odd input: a null or empty text is the closing id alone; a long
text is tokenized in slices that end where a token must end; repeated rows are
packed once each; no rows give no pieces; other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochwright.llm.common import map_once, row_key
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize

CAPACITY = 2048
GRAIN = 8  # lengths are rounded up to this many tokens when patterns are made
CLOSING_ID = 1
SLICE = 1 << 20  # characters tokenized at a time
_RUN = 1 << 13  # sequences of a pattern made from one row
_RUN_TASKS = 16
GAP = 1e-3  # column generation stops this near to its bound
_WORD_START = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")

PIECES = "doc_id long, row_no long, start long, length long, ids_crc32 long, doc_tokens long"


def slices(text: str) -> Iterator[str]:
    """``text`` in parts of about ``SLICE`` characters, cut before a space between two letters.

    A space before a letter always begins a token of the byte-level vocabulary
    used here, so the parts' tokens are those of the whole.
    """
    begin = 0
    while len(text) - begin > SLICE:
        cut = _WORD_START.search(text, begin + SLICE)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def added_tokens(tokenizer: str) -> dict[str, int]:
    """Tokens a tokenizer's JSON file adds to its vocabulary, and their ids; they are matched inside text."""
    with open(tokenizer, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def _parts(text: str, encode, added: dict[str, int]) -> Iterator[list[int]]:
    """Ids of ``text`` part by part: added tokens are found first, what lies between is sliced and encoded."""
    pattern = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
    for part in re.split(f"({pattern})", text) if added else [text]:
        if part in added:
            yield [added[part]]
        elif part:
            yield from map(encode, slices(part))


def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokenizer(vocabulary: str, pattern: str, added: dict[str, int]):
    made = []

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for part in parts:
            columns = [[] for _ in range(6)]
            for doc, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_no", "text"))):
                start, open_crc, open_length, made = 0, 0, 0, []
                for at, ids in _with_closing(_parts(text or "", encode, added)):
                    while at < len(ids):
                        take = min(CAPACITY - open_length, len(ids) - at)
                        open_crc = zlib.crc32(ids[at : at + take].tobytes(), open_crc)
                        open_length, at = open_length + take, at + take
                        if open_length == CAPACITY:
                            made.append((start, open_length, open_crc))
                            start, open_crc, open_length = start + CAPACITY, 0, 0
                if open_length:
                    made.append((start, open_length, open_crc))
                total = start + open_length
                for begin, length, crc in made:
                    for column, value in zip(columns, (doc, row, begin, length, crc, total)):
                        column.append(value)
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return batches


def _with_closing(parts: Iterator[list[int]]) -> Iterator[tuple[int, np.ndarray]]:
    for ids in parts:
        yield 0, np.array(ids, dtype="<u4")
    yield 0, np.array([CLOSING_ID], dtype="<u4")


def cut_pieces(
    docs: DataFrame, vocabulary: str, pattern: str, added: dict[str, int], row_no: Column | None = None
) -> DataFrame:
    """Full sequences from each document's start and its remainder, with each piece's checksum."""
    row_no = F.monotonically_increasing_id() if row_no is None else row_no
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_no.alias("row_no"), "text")
    return map_once(rows, _tokenizer(vocabulary, pattern, added), PIECES, "token-pieces")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of most value, and that value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 0)
    order = useful[np.argsort(sizes[useful])]
    fits = np.searchsorted(sizes[order], np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        if fits[room]:
            kinds = order[: fits[room]]
            gain = best[room - sizes[kinds]] + values[kinds]
            top = int(np.argmax(gain))
            if gain[top] > best[room]:
                best[room], choice[room] = gain[top], kinds[top]
    pattern, room = np.zeros(len(values)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and how many sequences take each, by column generation.

    Minimizes the number of sequences that hold ``demand`` pieces of ``sizes``.
    The simplex basis has a column per size; work depends on the number of
    sizes, not of pieces.
    """
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    # slightly moved demands have no ties, so no step is empty and none repeats
    demand = demand + 1e-3 * np.random.default_rng(5).random(m)
    amount = demand * np.diag(inverse)
    turn, mark = 0, np.inf
    while True:
        turn += 1
        if turn % (2 * m + 20) == 0:
            if amount.sum() > mark * (1 - GAP):  # hardly better in so many turns
                break
            mark = amount.sum()
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + GAP:  # then no solution is better than this one by more than the gap
            break
        change = (inverse * pattern).sum(axis=1)  # elementwise: no thread pool beside Spark's
        rising = np.flatnonzero(change > 1e-9)
        ratio = np.maximum(amount[rising], 0) / change[rising]
        leave = rising[int(np.argmin(ratio))]
        step = float(ratio.min())
        amount -= step * change
        amount[leave] = step
        row = inverse[leave] / change[leave]
        inverse -= np.outer(change, row)
        inverse[leave] = row
        columns[:, leave] = pattern
    return columns, np.maximum(amount, 0)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: pieces}) with the number of sequences each, covering ``histogram`` exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    columns, amount = solve(left.astype(float), sizes, capacity)
    columns = np.rint(columns).astype(np.int64)
    plan = []
    for k in np.argsort(-amount):
        pattern = columns[:, k]
        used = pattern > 0
        times = min(int(amount[k] + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times:
            left -= times * pattern
            plan.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(used)}, times))
    while left.any():  # a bounded rest: largest first, each pattern as often as it fits
        pattern, room = {}, capacity
        for i in np.flatnonzero(left)[::-1]:
            take = min(int(left[i]), room // int(sizes[i]))
            if take:
                pattern[int(sizes[i])] = take
                room -= take * int(sizes[i])
        times = min(int(left[np.searchsorted(sizes, s)]) // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[np.searchsorted(sizes, s)] -= times * n
        plan.append((pattern, times))
    return plan


def _slots(spark: SparkSession, plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    """(_size, _rank, _pattern, _nth, _slot): the place of each piece, by its rank within its size.

    The sequences of a pattern are spread evenly over the whole order, and the
    pieces of each size are handed out along it. So a sequence takes pieces
    from about the same place of each size's ranking. The driver makes a row
    per some thousand sequences of a pattern.
    """
    runs = [
        (p, begin, min(begin + _RUN, times), times, [s for s, n in sorted(pattern.items(), reverse=True) for _ in range(n)])
        for p, (pattern, times) in enumerate(plan)
        for begin in range(0, times, _RUN)
    ]
    rows = spark.createDataFrame(runs, "_pattern long, begin long, end long, times long, sizes array<long>")
    sequences = rows.repartition(_RUN_TASKS).select(
        "_pattern", "times", "sizes", F.explode(F.sequence("begin", F.col("end") - 1)).alias("_nth")
    )
    slots = sequences.select(
        "_pattern", "_nth", ((F.col("_nth") + 0.5) / F.col("times")).alias("_turn"), F.posexplode("sizes").alias("_slot", "_size")
    )
    return number_rows(slots, ["_size"], ["_turn", "_pattern", "_nth", "_slot"], out="_rank").drop("_turn")


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    added: dict[str, int] | None = None,
    grain: int = GRAIN,
    order: DataFrame | None = None,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    ``vocabulary`` is a rank file of a byte-level tokenizer and ``pattern`` its
    splitting expression; ``added`` has the ids of tokens matched before it. Full
    pieces are sequences by themselves. Pieces are ranked by the position of their
    row in ``order`` (doc_id, row_key, position), by default by doc_id, and
    sequences numbered by their first. Only the pieces' few numbers are joined with it.
    """
    spark = docs.sparkSession
    size = (F.ceil(F.col("length") / grain) * grain).cast("long")
    pieces = cut_pieces(docs, vocabulary, pattern, added or {}, None if order is None else row_key()).withColumn("_size", size)
    ranks = ["doc_id", "row_no", "start"]
    if order is not None:
        known = order.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), F.col("position").alias("_place"))
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_no") == F.col("_key"))
        pieces = materialize(pieces.join(known, same, "left").drop("_doc", "_key"), "ordered-pieces")
        ranks = ["_place", *ranks]
    counts = pieces.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["_size"] // grain: r["n"] for r in counts}
    plan = plan_patterns(histogram, CAPACITY // grain)
    if not plan:
        plan = []
    scaled = [({s * grain: n for s, n in p.items()}, times) for p, times in plan]
    # ranked within each size; a size that a third of the pieces has is spread by ranges
    ranked = number_rows(
        pieces.select("_size", *ranks, "length", "ids_crc32", "doc_tokens"),
        ["_size"],
        ranks,
        out="_rank",
    )
    placed = materialize(ranked.join(_slots(spark, scaled), ["_size", "_rank"]), "placed-pieces")
    sequence = ["_pattern", "_nth"]
    firsts = placed.groupBy(*sequence).agg(F.min(F.struct(*ranks)).alias("_first"))
    numbered = number_rows(firsts, [], ["_first", *sequence], out="sequence_id").drop("_first")
    # at most CAPACITY pieces share a sequence
    before = Window.partitionBy(*sequence).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .join(numbered, sequence)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """:func:`pack` with the 50k byte-level vocabulary."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added, order=order)
