"""Near-duplicates at a given Jaccard similarity: SimHash in vantage-point trees, then the shingle sets.

The fingerprint is a SimHash of a text's set of five-word shingles, as wide as
needed: words of 64 bits, each from a mix of the shingle hashes of its own.
Texts at similarity 0.8 differ in about 15 % of the bits (up to 19 % if they are
a few words long), others in half of them, so no 64 bits tell them apart without comparing
nearly all pairs. Instead there are many trees, each by distance over a band of
few bits of its own, in which many near pairs agree. A pair that agrees in the
band shares that tree's shard for certain: the distance is 0 there. There the
two are compared over 128 bits, and texts within ``REACH`` are grouped.

A band has as many bits as it takes to make shards of about ``SHARD_ROWS``
texts, and there are as many trees as it takes to leave out at most ``MISSED`` of
the pairs at the similarity. Both follow from the number of rows (:func:`layout`);
trees grow with about its fourth root. A shard of more than ``CELL_ROWS`` texts
is compared in cells of two blocks, all pairs of it, none left out.

Groups are candidates: texts are linked only if their shingle sets are similar
enough (:func:`epochwright.llm.minhash.verified`). Odd input as in ``minhash``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm import minhash
from epochwright.llm.common import drop_rows, map_once, row_key
from epochwright.llm.simhash import LEAST, Trees, components, grow, route
from epochwright.session import materialize, sized

AGREE = 0.82  # share of bits in which texts at similarity 0.8 agree, less than the 0.85 of long texts
REACH = 32  # differing bits of 128 up to which texts are candidates
MISSED = 0.002  # share of the pairs at the similarity that no tree may bring together
BAND = 16  # bits of a band, at most
SAMPLE_ROWS = 32_768  # texts the trees are fitted on, at most about
SHARD_ROWS = 2_048
CELL_ROWS = 8_192
_MOST_WORDS = 64
_PART = 255  # shingles counted at a time, so that counts fit a byte
_SHARD_BITS = 32
_random = np.random.default_rng(minhash.SEED)
_MASKS = _random.integers(0, 2**63, _MOST_WORDS, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**63, (2, _MOST_WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def layout(rows: int, shard_rows: int = SHARD_ROWS) -> tuple[int, int, int]:
    """(bits of a band, trees, words of a fingerprint) for so many rows."""
    bits = min(BAND, math.ceil(math.log2(max(2.0, rows / shard_rows))) + 1)
    trees = math.ceil(math.log(MISSED) / math.log(1 - AGREE**bits))
    return bits, trees, max(2, math.ceil(trees * BAND / 64))


def wide_fingerprint(text: str | None, words: int, shingle: int = minhash.SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half of the text's distinct shingles."""
    hashes = np.array([xxhash.xxh64_intdigest(s, minhash.SEED) for s in minhash.shingles(text, shingle)], dtype=np.uint64)
    counts = np.zeros(words * 64, np.int64)
    for begin in range(0, len(hashes), _PART):
        mixed = (hashes[begin : begin + _PART, None] ^ _MASKS[:words]) * _FACTORS[0, :words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[1, :words]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def _signer(words: int, shingle: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [wide_fingerprint(t, words, shingle).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "row_key", "node")], pa.array(made, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "node", "words"],
            )

    return batches


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, words)


def grow_trees(prints: DataFrame, rows: int, bits: int, trees: int, words: int, shard_rows: int = SHARD_ROWS) -> list[Trees]:
    """One tree per band, all fitted on one bounded sample."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    drawn = F.xxhash64("node") < share * 2.0**64 - 2.0**63
    chosen = prints.filter(drawn | F.lit(share >= 1)).select("words").toArrow().column("words").combine_chunks()
    sample = _matrix(chosen, words)
    size = max(LEAST, int(shard_rows * share))
    per_word = 64 // BAND
    band = lambda t: ((1 << bits) - 1) << (BAND * (t % per_word))
    return [grow(sample[:, t // per_word], size, REACH, t, [band(t)]) for t in range(trees)]


def _sharder(trees: list[Trees], words: int):
    per_word = 64 // BAND

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, points = part.column("id").to_numpy(), _matrix(part.column("words"), words)
            for t, tree in enumerate(trees):
                first = points[:, t // per_word]
                second = points[:, (t // per_word + 1) % words]
                rows, leaves = route(first, tree)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((t << _SHARD_BITS) + leaves),
                        pa.array(ids[rows]),
                        pa.array(first[rows].view(np.int64)),
                        pa.array(second[rows].view(np.int64)),
                    ],
                    names=["shard", "id", "first", "second"],
                )

    return batches


def groups(first: np.ndarray, second: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The number of each point's group: points linked by steps of at most ``reach`` differing bits.

    Each point is compared with those that have no group yet, so a crowd of
    near points costs one step and no list of pairs is made.
    """
    label = np.empty(len(first), np.int64)
    left, a, b, group, todo = np.arange(len(first)), first, second, -1, []
    while len(left):
        if todo:
            at = todo.pop()
        else:
            at, group = left[0], group + 1
            label[at] = group
            left, a, b = left[1:], a[1:], b[1:]
        near = np.bitwise_count(a ^ first[at]) + np.bitwise_count(b ^ second[at]) <= reach
        if near.any():
            found = left[near]
            label[found] = group
            todo.extend(found.tolist())
            left, a, b = left[~near], a[~near], b[~near]
    return label


def _cell_groups(table: pa.Table) -> pa.Table:
    ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
    first, second = (table.column(c).to_numpy()[at].view(np.uint64) for c in ("first", "second"))
    label = groups(first, second)
    order = np.argsort(label, kind="stable")
    sizes = np.bincount(label)
    keys, nodes, reps, counts = [], [], [], []
    for members in np.split(ids[order], np.cumsum(sizes)[:-1]):
        if len(members) > 1:
            # named by its members, so a group that several trees find is one
            key = xxhash.xxh64_intdigest(members.tobytes()) - 2**63
            keys.append(np.full(len(members), key, np.int64))
            nodes.append(members)
            reps.append(np.full(len(members), members[0]))
            counts.append(np.full(len(members), len(members), np.int64))
    whole = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]))
    return pa.table({"key": whole(keys), "id": whole(nodes), "rep_id": whole(reps), "n": whole(counts)})


def members(prints: DataFrame, trees: list[Trees], words: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, node, rep, n): groups of candidates among ``prints`` (id, node, words), as of ``minhash.key_members``."""
    # routing again is cheaper than writing every text once per tree
    routed = prints.select("id", "words").mapInArrow(_sharder(trees, words), "shard long, id long, first long, second long")
    large = routed.groupBy("shard").count().filter(F.col("count") > cell_rows)
    blocks = materialize(large.select("shard", F.ceil(F.col("count") / cell_rows).alias("blocks")), "large-shards")
    own = F.pmod(F.xxhash64("shard", "id"), F.col("blocks"))
    cells = (
        routed.join(blocks, "shard", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "first", "second")
    )
    found = cells.groupBy("shard", "i", "j").applyInArrow(_cell_groups, "key long, id long, rep_id long, n long")
    found = materialize(found.distinct(), "candidate-groups")
    names = sized(prints.select("id", "node"), "names")
    return materialize(
        found.join(names, "id").join(names.select(F.col("id").alias("rep_id"), F.col("node").alias("rep")), "rep_id").select(
            "key", "node", "rep", "n"
        ),
        "key-members",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = minhash.SHINGLE, similarity: float = minhash.SIMILARITY, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """doc_id, component_id, row_key and kept for every row of ``docs``.

    ``kept`` marks the rows with the smallest doc_id of each component.
    """
    count = docs.count()
    bits, number, words = layout(count, shard_rows)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), minhash.node_of().alias("node"), "text"
    )
    made = map_once(
        rows, _signer(words, shingle), "doc_id long, row_key long, node string, words array<long>", "wide-fingerprints"
    )
    prints = made.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("words").alias("words"))
    prints = materialize(prints.withColumn("id", F.monotonically_increasing_id()), "nodes")
    trees = grow_trees(prints, count, bits, number, words, shard_rows)
    labels = components(minhash.verified(docs, members(prints, trees, words), shingle, similarity))
    return minhash.decided(made, prints.select("node", "low"), labels)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all its columns untouched."""
    return drop_rows(docs, materialize(near_duplicates(docs), "near-decisions"))
