"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents are laid end to end and parted into blocks of equal
size. While a source has blocks left it is due a share of the slots in
proportion to its exact target weight; when one runs out, the others' shares
rise. By slot t all sources together are due t blocks. Block i of a source is
released at the slot in which the source comes to be due more than i - 1 blocks
and must be done by the end of the slot in which it comes to be due i. Earliest
deadline first (then the first source by name) among released blocks meets
every deadline, so no source is ever a whole block ahead of or behind its due.

The schedule is made in many stretches at once. A stretch starts from how many
blocks each source has had; at first that is a guess from what is due. Then
every stretch whose start differs from the end of the one before is made again
from there, until none does: the result is that of one scheduler going through
all slots. As a block is soon done either way, two or three turns suffice.

Nothing is left out: the result is an order of all documents. The driver handles
a few numbers per source and stretch; it is meant for up to thousands of sources.

Results for odd input: a null source is a source of its own; a null or empty
text still counts as one unit of length; repeated rows are all placed; a
document longer than a block takes the slot of its first block and leaves its
other slots empty; sources without a given weight above 0 get the least given
weight; other columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright.llm.common import row_key, text_or_empty
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize, sized

BLOCK_CHARS = 65_536
CHUNK = 256  # slots whose order is kept in one array while a stretch is made
FLATTEN = 0.5  # default target: share of a source to this power
SEED = 11


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, chars) of every source; a null or empty text counts as 1."""
    length = F.greatest(F.length(text_or_empty()), F.lit(1)).cast("long")
    return docs.groupBy("source").agg(F.sum(length).alias("chars"))


def default_weights(sizes: DataFrame, flatten: float = FLATTEN) -> DataFrame:
    """(source, weight): sizes flattened by a power below 1, so small sources are seen more often."""
    return sizes.select("source", F.pow(F.col("chars").cast("double"), F.lit(flatten)).alias("weight"))


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, row_key, source, block (from 0) and place of each row in its source, in hashed order."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.greatest(F.length(text_or_empty()), F.lit(1)).cast("long").alias("chars"),
        F.xxhash64("doc_id", text_or_empty(), F.lit(SEED)).alias("_mixed"),
        row_key().alias("row_key"),
    )
    placed = number_rows(rows, ["source"], ["_mixed", "doc_id", "row_key"], {"_before": F.col("chars")}, out="place")
    return placed.select(
        "doc_id", "row_key", "source", "chars", "place", F.floor(F.col("_before") / block_chars).cast("long").alias("block")
    )


@dataclass
class Due:
    """What sources are due: weights and blocks by source, and the turns between which shares are constant.

    A source is due ``weight`` blocks per unit of turn until it has none left.
    In a piece the slots pass at ``speed``, the sum of the weights that still count.
    """

    names: list[str | None]
    weights: list[float]
    blocks: list[int]
    begins: list[float]
    befores: list[float]  # slot at which the piece begins
    speeds: list[float]

    @classmethod
    def of(cls, rows: list[tuple[str | None, float, int]]) -> "Due":
        ends = sorted({blocks / weight for _, weight, blocks in rows})
        begins, befores, speeds, turn, slot = [], [], [], 0.0, 0.0
        for end in ends:
            speed = sum(w for _, w, b in rows if b / w >= end)
            begins.append(turn)
            befores.append(slot)
            speeds.append(speed)
            turn, slot = end, slot + (end - turn) * speed
        return cls([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], begins, befores, speeds)

    @property
    def slots(self) -> int:
        return sum(self.blocks)

    def guess(self, slot: int) -> list[int]:
        """Blocks each source has had by ``slot``, nearly: whole blocks due, then those begun that are most advanced."""
        p = max(0, bisect_right(self.befores, slot) - 1)
        turn = self.begins[p] + (slot - self.befores[p]) / self.speeds[p]
        due = [min(w * turn, b) for w, b in zip(self.weights, self.blocks)]
        had = [min(math.floor(d + 1e-9), b) for d, b in zip(due, self.blocks)]
        begun = sorted(range(len(due)), key=lambda s: had[s] - due[s])
        for s in begun[: max(0, slot - sum(had))]:
            had[s] += had[s] < self.blocks[s]
        return had

    def pieces(self) -> Column:
        rows = [{"begin": b, "before": o, "speed": s} for b, o, s in zip(self.begins, self.befores, self.speeds)]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<begin: double, before: double, speed: double>>")

    def sources(self) -> Column:
        rows = [{"w": w, "b": b} for w, b in zip(self.weights, self.blocks)]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<w: double, b: bigint>>")


def _slot_at(turn: Column, pieces: Column) -> Column:
    """The slot, with its fraction, at a turn."""
    piece = F.element_at(F.filter(pieces, lambda p: p["begin"] <= turn), -1)
    return piece["before"] + (turn - piece["begin"]) * piece["speed"]


def _slack(slot: Column) -> Column:
    """Far more than doubles can be off, far less than a slot."""
    return 1e-9 + 4e-15 * slot


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _window(source: Column, done: Column, pieces: Column) -> Column:
    """struct<dead, s, rel, done> of the block after ``done`` ones; far in the future if there is none."""
    never = F.lit(2**62)

    def bounds(ends: Column) -> Column:
        release, deadline = ends["release"], ends["deadline"]
        left = done < source["b"]
        return F.struct(
            F.when(left, F.ceil(deadline - _slack(deadline))).otherwise(never).alias("dead"),
            source["s"].alias("s"),
            F.when(left, F.floor(release + _slack(release))).otherwise(never).alias("rel"),
            done.alias("done"),
        )

    ends = F.struct(
        _slot_at(done / source["w"], pieces).alias("release"), _slot_at((done + 1) / source["w"], pieces).alias("deadline")
    )
    return _let(ends, bounds)


def _scheduled(due: Due) -> tuple[Column, Column, Column]:
    """Earliest deadline first over slots ``begin`` to ``end`` - 1 from the counts ``had``.

    The numbered sources, their next blocks at first, and at the end: next blocks, and the blocks taken in order.
    """
    numbered = F.transform(
        due.sources(), lambda x, s: F.struct(x["w"].alias("w"), x["b"].alias("b"), s.alias("s"))
    )
    nexts = F.transform(numbered, lambda x: _window(x, F.get("had", x["s"]), F.col("pieces")))

    def step(state: Column, slot: Column) -> Column:
        def take(chosen: Column) -> Column:
            renewed = F.transform(
                state["next"],
                lambda n: F.when(
                    n["s"] == chosen["s"], _window(F.get("numbered", n["s"]), n["done"] + 1, F.col("pieces"))
                ).otherwise(n),
            )
            return F.struct(renewed.alias("next"), F.concat(state["order"], F.array(chosen)).alias("order"))

        released = F.array_min(F.filter(state["next"], lambda n: n["rel"] <= slot))
        # a guess may have done too much; the schedule itself has a released block in every slot
        return _let(F.coalesce(released, F.array_min(state["next"])), take)

    block = "struct<dead: bigint, s: int, rel: bigint, done: bigint>"
    no_blocks = F.array().cast(f"array<{block}>")

    def chunk(state: Column, begin: Column) -> Column:
        slots = F.sequence(begin, F.least(begin + CHUNK, F.col("end")) - 1)
        inner = F.aggregate(slots, F.struct(state["next"].alias("next"), no_blocks.alias("order")), step)
        return _let(
            inner, lambda i: F.struct(i["next"].alias("next"), F.concat(state["orders"], F.array(i["order"])).alias("orders"))
        )

    begins = F.sequence("begin", F.col("end") - 1, F.lit(CHUNK).cast("long"))
    start = F.struct(F.col("nexts").alias("next"), F.array().cast(f"array<array<{block}>>").alias("orders"))
    return numbered, nexts, F.aggregate(begins, start, chunk)


def stretches(spark: SparkSession, due: Due, todo: list[tuple[int, int, int, list[int]]]) -> DataFrame:
    """(nth, had, after, order) of stretches given as (nth, begin, end, had); one task each."""
    rows = [{"nth": n, "begin": b, "end": e, "had": had} for n, b, e, had in todo]
    given = F.from_json(F.lit(json.dumps(rows)), "array<struct<nth: bigint, begin: bigint, end: bigint, had: array<bigint>>>")
    numbered, nexts, state = _scheduled(due)
    return (
        spark.range(0, len(todo), 1, len(todo))
        .select(F.get(given, F.col("id").cast("int")).alias("_row"))
        .select("_row.*", due.pieces().alias("pieces"))
        .withColumn("numbered", numbered)
        .withColumn("nexts", nexts)
        .withColumn("_state", state)
        .select(
            "nth",
            "begin",
            "had",
            F.transform("_state.next", lambda n: n["done"]).alias("after"),
            F.flatten("_state.orders").alias("order"),
        )
    )


def schedule(spark: SparkSession, due: Due, tasks: int) -> DataFrame:
    """(s, block, slot, release, deadline) of every block, by source number."""
    length = max(CHUNK, -(-due.slots // tasks))
    bounds = [(n, b, min(b + length, due.slots)) for n, b in enumerate(range(0, due.slots, length))]
    had = {n: due.guess(b) for n, b, _ in bounds}
    made, newest = [], {}
    todo = [n for n, _, _ in bounds]
    while todo:
        part = materialize(stretches(spark, due, [(n, b, e, had[n]) for n, b, e in bounds if n in set(todo)]), "stretches")
        newest |= dict.fromkeys(todo, len(made))
        made.append(part)
        after = {r["nth"]: list(r["after"]) for r in part.select("nth", "after").collect()}
        todo = []
        for n, ends in sorted(after.items()):
            if n + 1 in had and had[n + 1] != ends:
                had[n + 1] = ends
                todo.append(n + 1)
    whole = None
    for turn, part in enumerate(made):
        last = [n for n, t in newest.items() if t == turn]
        kept = part.filter(F.col("nth").isin(last)) if len(made) > 1 else part
        whole = kept if whole is None else whole.unionByName(kept)
    return whole.select("begin", F.posexplode("order").alias("_at", "_b")).select(
        F.col("_b.s").alias("s"),
        F.col("_b.done").alias("block"),
        (F.col("begin") + F.col("_at")).alias("slot"),
        F.col("_b.rel").alias("release"),
        F.col("_b.dead").alias("deadline"),
    )


def mix(
    docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS, tasks: int | None = None
) -> DataFrame:
    """doc_id, row_key, source, block, slot, release, deadline and position of every row.

    ``slot`` counts blocks; ``release`` and ``deadline`` bound it. ``position``
    numbers the rows of the mix from 0. ``weights`` (source, weight) defaults to
    :func:`default_weights`.
    """
    spark = docs.sparkSession
    sizes = materialize(source_sizes(docs.select(F.col("source").cast("string").alias("source"), "text")), "sources")
    given = default_weights(sizes) if weights is None else weights
    joined = sizes.join(
        given.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight")),
        F.col("source").eqNullSafe(F.col("_s")),
        "left",
    )
    rows = joined.groupBy("source", "chars").agg(F.max("weight").alias("weight")).collect()  # a row per source
    rows = sorted(rows, key=lambda r: (r["source"] is not None, r["source"] or ""))
    usable = lambda w: w is not None and w > 0 and math.isfinite(w)
    least = min((r["weight"] for r in rows if usable(r["weight"])), default=1.0)
    due = Due.of([(r["source"], r["weight"] if usable(r["weight"]) else least, -(-r["chars"] // block_chars)) for r in rows])
    placed = blocks(docs, block_chars)
    if not rows:
        return placed.select(
            "doc_id", "row_key", "source", "block", *[F.lit(0).cast("long").alias(c) for c in ("slot", "release", "deadline", "position")]
        )
    timed = schedule(spark, due, tasks or 2 * spark.sparkContext.defaultParallelism)
    named = F.from_json(F.lit(json.dumps(due.names)), "array<string>")
    timed = timed.select(F.get(named, F.col("s")).alias("_source"), F.col("block").alias("_block"), "slot", "release", "deadline")
    scheduled = placed.join(
        sized(timed, "slots"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    ).select("doc_id", "row_key", "source", "block", "place", "slot", "release", "deadline")
    return number_rows(scheduled, [], ["slot", "place"], out="position").drop("place")


def order_of(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_key, position): the place of every row in the mix; equal rows share their first.

    It follows from the rows alone, not from files or partitions, so a step
    that reads a written or filtered mix finds the order again.
    """
    order = mix(docs, weights)
    return materialize(order.groupBy("doc_id", "row_key").agg(F.min("position").alias("position")), "mix-order")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``docs``, all rows and columns, ordered by the mix: sorted within ranges of positions."""
    order = order_of(docs, weights).select(
        F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("row_key").alias("_k"), "position"
    )
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"),
        F.col("doc_id").isNull().alias("_n"),
        row_key().alias("_k"),
    )
    return (
        keyed.join(order.withColumnRenamed("position", "_position"), ["_d", "_n", "_k"])
        .repartitionByRange("_position")
        .sortWithinPartitions("_position")
        .select("_row.*")
    )
