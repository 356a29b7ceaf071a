"""SimHash near-duplicates, found with vantage-point trees over Hamming distance.

Each distinct fingerprint is sorted into shards by forests of vantage-point
trees, exact pairs are looked for inside shards, and links are joined to
components. Two fingerprints with at most ``radius`` differing bits agree in at
least one of ``radius + 1`` bands of bits. So one tree per band measures
distance over its band only: there the pair's distance is 0, the triangle
bound prunes to one side, and a fingerprint goes to exactly one shard. Where a
band cannot split a shard any more (many fingerprints agree in it), the tree
goes on with distances over all bits, and fingerprints within ``radius`` of a
boundary are put on both sides, so every pair meets in some shard.

The first trees are fitted on a bounded sample, so with more fingerprints their
shards hold more. Shards that hold too many are divided again, each by a small
tree of its own, level by level, until all are small. A shard that its tree
cannot divide (fingerprints crowded within a few bits) is not compared: each of
its fingerprints is filed under itself and under its 64 neighbours at one bit.
Two within two bits share such a place, and all at one place are within two.

Shards are searched by the same rule down to small blocks, which are compared
in one vector operation. A shard yields a forest of links, not all its pairs.

Results for odd input: a null text is an empty one; texts without a word have
fingerprint 0 and are linked like others; ``component_id`` ignores null doc_ids
unless a component has no other; repeated rows share a component; no rows give
no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import drop_rows, map_once, row_key
from epochwright.session import materialize

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
SAMPLE_ROWS = 65_536  # fingerprints the trees are fitted on, at most about
SHARD_ROWS = 4_096  # fingerprints a shard should hold
CROWDED = 4  # times that number, from which on a shard is divided again
LEAST = 16  # sampled fingerprints a leaf should hold, so that its true size is near the expected
FANOUT = 64  # leaves of a tree that divides one shard again, at most about
BLOCK = 256  # fingerprints compared in one step
_PIECE = 1 << 20
_SPACES = re.compile(rb"[\x20\x09-\x0d]")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; repeats count."""
    data = (text or "").encode().lower()
    counts, total, carry, begin = np.zeros(BITS, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while begin < len(data):
        end = begin + _PIECE
        if end < len(data):  # move on to white space, so no word is cut
            space = _SPACES.search(data, end)
            end = space.start() if space else len(data)
        words = carry + data[begin:end].split()
        runs = zip(*[words[i:] for i in range(shingle)])
        hashes = [digest(b" ".join(run), SEED) for run in runs]
        if hashes:
            counts += _bit_counts(hashes)
            total += len(hashes)
        carry, begin = (words[-(shingle - 1) :] if shingle > 1 else []), end
    if not total and carry:
        counts, total = _bit_counts([digest(b" ".join(carry), SEED)]), 1
    set_bits = np.flatnonzero(counts * 2 > total)
    return int(sum(1 << int(b) for b in set_bits))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t) for t in batch.column("text").to_pylist()]
        signed = np.array(values, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(signed)],
            names=["doc_id", "row_key", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) of every row; ``fp`` holds the 64 bits as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return map_once(rows, _fingerprints, "doc_id long, row_key long, fp long", "fingerprints")


def bands(radius: int) -> list[int]:
    """``radius + 1`` masks that part the bits: a pair within ``radius`` agrees in one of them."""
    edges = np.linspace(0, BITS, radius + 2).astype(int)
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


@dataclass
class Trees:
    """Nodes of all trees in arrays; a negative child -1 - s is shard s. ``reach`` is the overlap."""

    roots: list[int]
    vantage: np.ndarray
    mask: np.ndarray
    bound: np.ndarray
    reach: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bands: list[int]  # of each shard

    @property
    def shards(self) -> int:
        return len(self.bands)


def _split(points: np.ndarray, mask: np.uint64, vantages: np.ndarray) -> tuple | None:
    """The vantage point and boundary that part ``points`` most evenly by distance under ``mask``."""
    best = None
    for v in vantages:
        d = np.bitwise_count((points ^ v) & mask)
        for bound in {int(np.median(d)), int(np.median(d)) + 1}:
            below = int((d < bound).sum())
            even = min(below, len(points) - below)
            if even and (best is None or even > best[0]):
                best = (even, v, bound, d)
    return best


def grow(
    sample: np.ndarray, shard_size: int, radius: int = RADIUS, seed: int = 7, masks: list[int] | None = None
) -> Trees:
    """Trees over a sample, one per mask (default: all bands).

    A node is split until it holds ``shard_size`` sample points or all are equal.
    """
    rng = np.random.default_rng(seed)
    nodes, roots, owners = [], [], []
    masks = bands(radius) if masks is None else masks
    for band in masks:
        at = len(roots)
        roots.append(None)
        todo = [(np.unique(sample), True, None, None)]
        while todo:
            points, in_band, parent, side = todo.pop()
            split, mask, reach = None, np.uint64(band), 0
            if len(points) > shard_size:
                vantages = rng.choice(points, min(6, len(points)), replace=False)
                if in_band:
                    split = _split(points, mask, vantages)
                if split is None or split[0] < len(points) // 8:
                    mask, reach, in_band = np.uint64(2**BITS - 1), radius, False
                    split = _split(points, mask, vantages)
                    if split is not None and int((split[3] < split[2] + reach).sum()) > 0.9 * len(points):
                        split = None  # nearly all would be on both sides
            if split is None:
                child = -1 - len(owners)
                owners.append(at)
            else:
                _, v, bound, d = split
                child = len(nodes)
                nodes.append([v, mask, bound, reach, None, None])
                todo.append((points[d < bound + reach], in_band, child, 4))
                todo.append((points[d >= bound], in_band, child, 5))
            if parent is None:
                roots[at] = child
            else:
                nodes[parent][side] = child
    column = lambda i, kind: np.array([n[i] for n in nodes], dtype=kind)
    return Trees(
        roots, column(0, np.uint64), column(1, np.uint64), column(2, np.int64), column(3, np.int64),
        column(4, np.int64), column(5, np.int64), owners,
    )


def route(points: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for every shard a point belongs to.

    The near side takes points below the boundary and ``reach`` beyond it, the
    far side those from the boundary on. By the triangle inequality a pair
    within ``reach`` then shares a side.
    """
    rows, shards = [], []
    for root in trees.roots:
        who, node = np.arange(len(points)), np.full(len(points), root, dtype=np.int64)
        while len(who):
            done = node < 0
            rows.append(who[done])
            shards.append(-1 - node[done])
            who, node = who[~done], node[~done]
            d = np.bitwise_count((points[who] ^ trees.vantage[node]) & trees.mask[node]).astype(np.int64)
            near, far = d < trees.bound[node] + trees.reach[node], d >= trees.bound[node]
            who, node = np.concatenate([who[near], who[far]]), np.concatenate([trees.near[node][near], trees.far[node][far]])
    return np.concatenate(rows), np.concatenate(shards)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of distinct ``points`` the index of its component's representative, found exactly."""
    parent = np.arange(len(points))
    todo = [(np.arange(len(points)), 0)]
    while todo:
        at, depth = todo.pop()
        here = points[at]
        if len(at) > BLOCK:
            best = None
            for turn in range(6):
                d = np.bitwise_count(here ^ here[((depth + turn) * 7919 + 1) % len(at)])
                bound = max(int(np.median(d)), 1)
                near, far = d < bound + radius, d >= bound
                most = max(int(near.sum()), int(far.sum()))
                if best is None or most < best[0]:
                    best = (most, near, far)
                if most < 0.8 * len(at):
                    break
            if best[0] < 0.95 * len(at):
                todo += [(at[best[1]], depth + 1), (at[best[2]], depth + 1)]
                continue
        for begin in range(0, len(at), BLOCK):
            block = here[begin : begin + BLOCK]
            a, b = np.nonzero(np.bitwise_count(block[:, None] ^ here[None, begin:]) <= radius)
            keep = a < b
            for i, j in zip(at[begin + a[keep]], at[begin + b[keep]]):
                x, y = _find(parent, i), _find(parent, j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return np.array([_find(parent, i) for i in range(len(points))], dtype=np.int64)


def _sharder(trees: Trees):
    owner = np.array(trees.bands, dtype=np.int32)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = part.column("fp").to_numpy().view(np.uint64)
            rows, shards = route(points, trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[shards]), pa.array(shards), pa.array(points[rows].view(np.int64))],
                names=["band", "shard", "fp"],
            )

    return batches


_TREE = "band int, shard long, root long, " + ", ".join(
    f"{name} array<long>" for name in ("vantage", "mask", "bound", "reach", "near", "far")
)


def _tree_of_shard(shard_rows: int):
    """Grows the tree of one crowded shard from its sample, as a row of arrays."""

    def grown(table: pa.Table) -> pa.Table:
        band, n = table.column("band")[0].as_py(), table.column("n")[0].as_py()
        points = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        tree = grow(points, max(LEAST, len(points) * shard_rows // n), masks=[bands(RADIUS)[band]])
        row = {"band": pa.array([band], pa.int32()), "shard": table.column("shard")[:1], "root": [tree.roots[0]]}
        for name in ("vantage", "mask", "bound", "reach", "near", "far"):
            row[name] = pa.array([getattr(tree, name).astype(np.int64).tolist()], pa.list_(pa.int64()))
        return pa.table(row)

    return grown


def _divided(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Routes packs of fingerprints of one shard, each beside that shard's tree."""
    for part in parts:
        for row in part.to_pylist():
            sides = [np.array(row[k], dtype=np.int64) for k in ("vantage", "mask", "bound", "reach", "near", "far")]
            tree = Trees([row["root"]], sides[0].view(np.uint64), sides[1].view(np.uint64), *sides[2:], [])
            points = np.array(row["fps"], dtype=np.int64)
            rows, leaves = route(points.view(np.uint64), tree)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), row["band"], np.int32)),
                    pa.array(np.full(len(rows), row["shard"], np.int64)),
                    pa.array(leaves),
                    pa.array(points[rows]),
                    pa.array(np.full(len(rows), row["n"], np.int64)),
                ],
                names=["band", "shard", "leaf", "fp", "came"],
            )


def _draw(number: int, share):
    """True for about ``share`` of the fingerprints; a lost task draws the same again."""
    return F.xxhash64("fp", F.lit(number)) < (share * 2.0**64 - 2.0**63)


def divide(routed: DataFrame, sizes: DataFrame, shard_rows: int, level: int) -> DataFrame:
    """(band, shard, fp, came) of the shards in ``sizes``, each divided by a tree of its own.

    ``came`` is the number of fingerprints of the shard divided. Its sample is
    bounded by ``FANOUT`` leaves of ``LEAST``; its fingerprints are dealt into
    packs of about ``shard_rows``, so no task meets a whole shard.
    """
    rows = routed.drop("came").join(sizes, "shard")
    chosen = rows.filter(_draw(level, F.lit(1.0 * FANOUT * LEAST) / F.col("n"))).select("band", "shard", "n", "fp")
    grown = chosen.groupBy("shard").applyInArrow(_tree_of_shard(shard_rows), _TREE)
    grown = materialize(grown, "shard-trees")
    packs = (
        rows.withColumn("pack", F.pmod(F.xxhash64("fp", F.lit(-level)), F.ceil(F.col("n") / shard_rows)))
        .groupBy("shard", "pack", "n")
        .agg(F.collect_list("fp").alias("fps"))
    )
    kind = "band int, shard long, leaf long, fp long, came long"
    parts = packs.join(grown, "shard").mapInArrow(_divided, kind)
    # a hash names the new shard; should two names meet, more is compared, nothing lost
    return parts.select("band", F.xxhash64("shard", "leaf", F.lit(level)).alias("shard"), "fp", "came")


def shards(
    prints: DataFrame, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS
) -> tuple[DataFrame, DataFrame]:
    """((shard, fp), (fp)): shards of at most ``CROWDED * shard_rows``, and what no tree could divide.

    Each pair within the radius meets in a shard or is among the second.
    Every level at least halves a shard, or takes it as not to be divided.
    """
    share = min(1.0, sample_rows / max(1, prints.count()))
    chosen = prints.filter(_draw(1, F.lit(share)) | F.lit(share >= 1)).select("fp").collect()
    sample = np.array([r.fp for r in chosen], dtype=np.int64).view(np.uint64)
    trees = grow(sample, max(LEAST, int(shard_rows * share)))
    routed = prints.select("fp").mapInArrow(_sharder(trees), "band int, shard long, fp long")
    routed = routed.withColumn("came", F.lit(None).cast("long"))
    small, crowds, level = [], [], 1
    while True:
        routed = materialize(routed, "shards")
        sizes = materialize(routed.groupBy("shard").agg(F.count("fp").alias("n"), F.max("came").alias("came")), "sizes")
        much = F.col("n") > CROWDED * shard_rows
        if sizes.filter(much).isEmpty():
            small.append(routed.select("shard", "fp"))
            break
        halved = F.col("n") <= F.coalesce(F.col("came"), F.col("n") * 2) / 2
        small.append(routed.join(sizes.filter(~much).select("shard"), "shard").select("shard", "fp"))
        crowds.append(routed.join(sizes.filter(much & ~halved).select("shard"), "shard").select("fp"))
        level += 1
        routed = divide(routed, sizes.filter(much & halved).select("shard", "n"), shard_rows, level)
    crowd = crowds[0] if crowds else routed.select("fp").limit(0)
    for more in crowds[1:]:
        crowd = crowd.unionByName(more)
    whole = small[0]
    for more in small[1:]:
        whole = whole.unionByName(more)
    return whole, crowd.distinct()


def crowd_links(crowd: DataFrame) -> DataFrame:
    """(a, b): links that connect all within two bits, by places at one bit; a place holds at most 65."""
    around = F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")
    places = crowd.select("fp", F.explode(around).alias("place"))
    met = places.groupBy("place").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return pairs.filter("a <> b").distinct()


def _shard_links(table: pa.Table) -> pa.Table:
    points = np.unique(table.column("fp").to_numpy()).view(np.uint64)
    roots = linked(points)
    moved = np.flatnonzero(roots != np.arange(len(points)))
    return pa.table({"a": points[moved].view(np.int64), "b": points[roots[moved]].view(np.int64)})


def links(prints: DataFrame, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a set of links between distinct fingerprints that connects all within the radius.

    The first trees are fitted on a bounded sample (about ``sample_rows``
    fingerprints); every fingerprint is then routed and compared.
    """
    whole, crowd = shards(prints, sample_rows, shard_rows)
    found = whole.groupBy("shard").applyInArrow(_shard_links, "a long, b long")
    return found.unionByName(crowd_links(crowd))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by min-label hooking and pointer jumping.

    Each round every node takes the smallest label among its neighbours'
    labels and then its label's label; rounds grow with the logarithm of the
    longest chain. A round's result is written, so lineage stays short and a
    lost executor costs one round.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    state = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        # smallest label next door, offered to the node and to the root it hangs on
        offers = both.join(state.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b")
        best = offers.groupBy("a").agg(F.min("theirs").alias("offer"))
        mine = state.join(best, "a").select("a", "label", F.least("label", "offer").alias("low"))
        hooks = mine.select("a", "low").unionByName(mine.select(F.col("label").alias("a"), "low"))
        hooked = hooks.groupBy("a").agg(F.min("low").alias("label"))
        up = hooked.select(F.col("a").alias("label"), F.col("label").alias("above"))
        fresh = materialize(
            hooked.join(up, "label").select("a", F.least("label", "above").alias("label")), "labels"
        )
        if fresh.join(state.withColumnRenamed("label", "was"), "a").filter("label <> was").isEmpty():
            return fresh.select(F.col("a").alias("node"), F.col("label").alias("component"))
        state = fresh


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, row_key and kept for every row of ``docs``.

    ``kept`` marks the rows with the smallest doc_id of each component.
    """
    made = fingerprints(docs)
    lowest = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    labels = components(links(lowest))
    named = labels.join(lowest.withColumnRenamed("fp", "node"), "node")
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    linked_prints = named.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    answers = materialize(
        lowest.join(linked_prints, "fp", "left").select(
            F.col("fp").alias("_fp"), F.coalesce("component_id", "low").alias("component_id")
        ),
        "print-components",
    )
    return made.join(answers, F.col("fp") == F.col("_fp")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "row_key",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all its columns untouched."""
    return drop_rows(docs, materialize(near_duplicates(docs), "near-decisions"))
