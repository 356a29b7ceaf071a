"""Near-duplicates by exact Jaccard similarity of word shingles, found with MinHash bands.

A text's shingles are its runs of five words, lower-cased. Each distinct text
gets ``BANDS`` keys, every key from ``BAND_ROWS`` minimum hashes; texts at
similarity s share a key with probability 1 - (1 - s**5)**16 (0.998 at 0.8).
Texts that share a key are candidates, and are linked only if the shingle sets
themselves are similar enough. Links are joined to components.

Nothing that shares a key goes without a comparison, however large the group:

* In a key's group of up to ``ALL_PAIRS`` texts all pairs are compared.
* In a larger one all texts are first compared with the group's representative.
  Those near it are in one component already. Those that are not are compared
  with each other and with the near ones: blocks of the group meet in cells,
  where one product of shingle incidence matrices gives all similarities of two
  blocks, and a cell returns a forest of links instead of its pairs. Jaccard
  distance is a metric, so texts so near the representative that none of the
  others can be within reach need no second comparison.

So a group of copies with small changes costs one comparison a text, and only
texts spread around the threshold are compared with all of their group.

Results for odd input: a null text is an empty one; texts without a word are
equal; a text of fewer words than a shingle is one shingle; ``component_id``
ignores null doc_ids unless a component has no other; repeated rows share a
component; no rows give no rows; columns other than doc_id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import drop_rows, map_once, row_key, text_or_empty
from epochwright.llm.simhash import components
from epochwright.session import materialize, sized

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
BAND_ROWS = 5
ALL_PAIRS = 16  # texts of a key's group up to which pairs are compared one by one
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 20  # of a block, about
_COLUMNS = 4_096  # shingles multiplied at a time
SEED = 42
_PART = 4_096  # shingles hashed at a time
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)}
    return {b" ".join(run) for run in zip(*[words[i:] for i in range(shingle)])}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def band_keys(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A signed 64-bit key per band."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, shingle)], dtype=np.uint64)
    lowest = np.full(len(_FACTORS), 2**64 - 1, dtype=np.uint64)
    for begin in range(0, len(hashes), _PART):
        mixed = (hashes[None, begin : begin + _PART] ^ _MASKS[:, None]) * _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[::-1, None]
        np.minimum(lowest, mixed.min(axis=1), out=lowest)
    rows = lowest.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _signer(shingle: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = [band_keys(t, shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "row_key", "node")], pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "node", "keys"],
            )

    return batches


def _verifier(shingle: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for part in parts:
            a, found = part.column("a").to_pylist(), []
            for i in range(len(a)):
                if a[i] != last:
                    last, seen = a[i], shingles(part.column("text_a")[i].as_py(), shingle)
                found.append(jaccard(seen, shingles(part.column("text_b")[i].as_py(), shingle)))
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(found, pa.float64())], names=["a", "b", "s"]
            )

    return batches


def _hasher(shingle: int):
    """The sorted hashes of each text's shingles."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [
                np.sort(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(t, shingle)], dtype=np.uint64)).view(np.int64)
                for t in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "hashes"]
            )

    return batches


def node_of() -> Column:
    """Identifies a text: two 64-bit hashes and its length."""
    text = text_or_empty()
    return F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)), F.octet_length(text).cast("string"))


def key_members(signed: DataFrame) -> DataFrame:
    """(key, node, rep, n): the texts of each shared key with its representative and their number."""
    rows = signed.select("node", F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("node", "key").alias("o"), "node"))["node"].alias("rep"), F.count(F.lit(1)).alias("n")
    )
    groups = materialize(groups.filter("n > 1"), "shared-keys")
    return materialize(rows.join(groups, "key"), "key-members")


def candidates(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: each text with its representative, and all pairs of small groups."""
    star = members.filter("node <> rep").select(
        F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")
    )
    small = members.filter((F.col("n") > 2) & (F.col("n") <= ALL_PAIRS)).select("key", "node")
    every = (
        small.withColumnRenamed("node", "a")
        .join(small.withColumnRenamed("node", "b"), "key")
        .filter("a < b")
        .select("a", "b")
    )
    return materialize(star.unionByName(every).distinct(), "candidate-pairs")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the texts that ``nodes`` names, each once."""
    texts = docs.select(node_of().alias("node"), text_or_empty().alias("text"))
    texts = texts.join(sized(nodes.distinct(), "nodes-needed"), "node", "left_semi")
    return materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")


def similarities(texts: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, s): the exact similarity of each pair."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return map_once(sides.select("a", "b", "text_a", "text_b"), _verifier(shingle), "a string, b string, s double", "similarities")


def undecided(members: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(key, node, far): of large groups the texts far from the representative, and the near ones they might be near to.

    A text at similarity s to the representative and one at t are at least
    |s - t| apart, so near ones with s above the largest t + (1 - similarity) are out of reach.
    """
    large = members.filter((F.col("n") > ALL_PAIRS) & (F.col("node") != F.col("rep"))).select(
        "key", "node", F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")
    )
    rated = materialize(large.join(known, ["a", "b"]).select("key", "node", "s"), "rated-members")
    reach = rated.filter(F.col("s") < similarity).groupBy("key").agg((F.max("s") + (1 - similarity) + 1e-9).alias("reach"))
    return rated.join(sized(reach, "group-reach"), "key").filter("s <= reach").select(
        "key", "node", (F.col("s") < similarity).alias("far")
    )


def _cell_links(similarity: float):
    def of_cell(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        hashes = [np.asarray(h, dtype=np.int64) for h in table.column("hashes").to_pylist()]
        far = np.array(table.column("far").to_pylist(), dtype=bool)
        left = np.array(table.column("left").to_pylist(), dtype=bool)
        right = np.array(table.column("right").to_pylist(), dtype=bool)
        sizes = np.array([len(h) for h in hashes])
        owner = np.repeat(np.arange(len(hashes)), sizes)
        _, column, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = often > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], place[column[keep]]
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        common = np.zeros((len(x), len(y)), dtype=np.float32)
        for begin in range(0, int(shared.sum()), _COLUMNS):
            here = (column >= begin) & (column < begin + _COLUMNS)
            held = np.zeros((len(hashes), min(_COLUMNS, int(shared.sum()) - begin)), dtype=np.float32)
            held[owner[here], column[here] - begin] = 1
            common += held[x] @ held[y].T
        # the quotient in doubles, as for single pairs
        common = common.astype(float)
        near = common / (sizes[x][:, None] + sizes[y][None, :] - common) >= similarity
        near &= (far[x][:, None] | far[y][None, :]) & (x[:, None] != y[None, :])
        parent, out = list(range(len(nodes))), []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(near)):
            a, b = root(int(x[i])), root(int(y[j]))
            if a != b:
                parent[b] = a
                out.append((nodes[x[i]], nodes[y[j]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.string()), "b": pa.array([b for _, b in out], pa.string())})

    return of_cell


def block_links(
    texts: DataFrame, members: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(a, b): links of :func:`undecided` texts, from all pairs of which one is far from the representative."""
    names = sized(members.select("node").distinct(), "undecided-nodes")
    hashed = map_once(texts.join(names, "node", "left_semi"), _hasher(shingle), "node string, hashes array<long>", "shingle-hashes")
    lengths = hashed.select("node", F.size("hashes").cast("long").alias("size"))
    counts = members.join(lengths, "node").groupBy("key").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / block_texts), F.ceil(F.sum("size") / block_shingles), F.lit(1).cast("long")
        ).alias("blocks")
    )
    block = F.pmod(F.xxhash64("key", "node"), F.col("blocks"))
    placed = members.join(sized(counts, "group-blocks"), "key").select("key", "node", "far", "blocks", block.alias("own"))
    cells = placed.select(
        "key", "node", "far", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select(
        "node",
        "far",
        F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("cell"),
        (F.col("own") <= F.col("other")).alias("left"),
        (F.col("own") >= F.col("other")).alias("right"),
    )
    return cells.join(hashed, "node").groupBy("cell").applyInArrow(_cell_links(similarity), "a string, b string")


def verified(docs: DataFrame, members: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect all texts which share a key and are at least so similar."""
    pairs = candidates(members)
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    known = similarities(texts, pairs, shingle)
    open_members = materialize(undecided(members, known, similarity), "undecided")
    return known.filter(F.col("s") >= similarity).select("a", "b").unionByName(
        block_links(texts, open_members, shingle, similarity)
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id, row_key and kept for every row of ``docs``.

    ``kept`` marks the rows with the smallest doc_id of each component.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), node_of().alias("node"), "text"
    )
    made = map_once(rows, _signer(shingle), "doc_id long, row_key long, node string, keys array<long>", "minhash-keys")
    lowest = materialize(
        made.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys")), "nodes"
    )
    members = key_members(lowest.select("node", "keys"))
    return decided(made, lowest, components(verified(docs, members, shingle, similarity)))


def decided(made: DataFrame, lowest: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, component_id, row_key and kept of the rows in ``made`` (with ``node``), by the components of their texts.

    ``lowest`` holds the smallest doc_id (``low``) of each text.
    """
    named = labels.join(lowest.select("node", "low"), "node")
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = materialize(named.join(smallest, "component").select(F.col("node").alias("_node"), "component_id"), "linked")
    answers = materialize(
        lowest.select("node", "low").join(linked, F.col("node") == F.col("_node"), "left").select(
            F.col("node").alias("_of"), F.coalesce("component_id", "low").alias("component_id")
        ),
        "node-components",
    )
    return made.join(answers, F.col("node") == F.col("_of")).select(
        "doc_id",
        "component_id",
        "row_key",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all its columns untouched."""
    return drop_rows(docs, materialize(near_duplicates(docs), "near-decisions"))
