"""Exact duplicates by content-defined chunk recipes.

A text, with every run of white space made one space, is cut where a rolling
hash of its last 32 bytes ends in zeros, so equal stretches give equal chunks
wherever they stand. A chunk gets a short identifier; the chunk dictionary
verifies that an identifier stands for one SHA-256 only. Texts are then
compared by their ordered lists of identifiers, a few bytes per kilobyte of
text, and no text is moved between machines.

Results for odd input: a null text is an empty one, and all empty texts are
equal; rows that repeat doc_id and text are copies of each other, of which one
stays; a null doc_id sorts after all others; columns other than doc_id and text
are not looked at; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import drop_rows, map_once, row_key
from epochwright.session import materialize

SPACE = re.compile(rb"[\x20\x09-\x0d]+")
MIN_CHUNK, MAX_CHUNK = 512, 8192
MASK_BITS = 11  # a cut every 2 KB or so
PIECE = 1 << 20  # bytes hashed at a time
_WINDOW = 32

RECIPES = (
    "doc_id long, row_key long, row_no long, text_sha256 string, "
    "recipe binary, strong binary, lengths array<int>"
)


def _gear() -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.frombuffer(b"".join(hashlib.md5(bytes([b])).digest()[:4] for b in range(256)), dtype="<u4")


GEAR = _gear()


def cut_points(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``; they depend on nearby bytes only, but for the length bounds."""
    candidates = []
    for begin in range(0, len(data), PIECE):
        low = max(0, begin - _WINDOW)
        h = GEAR[np.frombuffer(data, dtype=np.uint8, count=min(len(data), begin + PIECE) - low, offset=low)]
        step = 1
        while step < _WINDOW:  # sum of the last 2 * step bytes' numbers, each shifted by its distance
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint32(step)
            h = h + shifted
            step *= 2
        at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + low + 1
        candidates.append(at[at > begin])
    at, ends, last = (np.concatenate(candidates) if candidates else np.zeros(0, np.int64)), [], 0
    while len(data) - last > MIN_CHUNK:
        i = np.searchsorted(at, last + MIN_CHUNK)
        end = min(int(at[i]) if i < len(at) else len(data), last + MAX_CHUNK, len(data))
        ends.append(end)
        last = end
    if last < len(data):
        ends.append(len(data))
    return np.array(ends, dtype=np.int64)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas, recipes, strongs, lengths = [], [], [], []
        for text in batch.column("text").to_pylist():
            data = SPACE.sub(b" ", (text or "").encode())
            shas.append(hashlib.sha256(data).hexdigest())
            short, strong, sizes, last = [], [], [], 0
            for end in cut_points(data):
                chunk = data[last:end]
                short.append(xxhash.xxh64_digest(chunk))
                strong.append(hashlib.sha256(chunk).digest())
                sizes.append(end - last)
                last = end
            recipes.append(b"".join(short))
            strongs.append(b"".join(strong))
            lengths.append(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_key"),
                batch.column("row_no"),
                pa.array(shas),
                pa.array(recipes, pa.binary()),
                pa.array(strongs, pa.binary()),
                pa.array(lengths, pa.list_(pa.int32())),
            ],
            names=["doc_id", "row_key", "row_no", "text_sha256", "recipe", "strong", "lengths"],
        )


def recipes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its digest and its chunks' identifiers (short, strong) and lengths."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key().alias("row_key"),
        F.monotonically_increasing_id().alias("row_no"),
        "text",
    )
    return map_once(rows, _recipes, RECIPES, "recipes")


def chunk_dictionary(made: DataFrame) -> DataFrame:
    """Every distinct chunk: short identifier, how often it occurs, its length, whether it is verified."""
    n = F.size("lengths")
    each = made.filter(n > 0).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct(
                    F.substring("recipe", i * 8 + 1, 8).alias("short"),
                    F.substring("strong", i * 32 + 1, 32).alias("strong"),
                    F.get("lengths", i).alias("length"),
                ),
            )
        ).alias("c")
    )
    exact = each.groupBy("c.short", "c.strong", "c.length").agg(F.count(F.lit(1)).alias("n"))
    return exact.groupBy("short").agg(
        F.sum("n").alias("n"), F.max("length").alias("length"), (F.count(F.lit(1)) == 1).alias("verified")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks, row_key for every row of ``docs``.

    Lists of short identifiers are compared if the dictionary verifies them
    all, else lists of SHA-256 digests: the result is the same.
    """
    made = recipes(docs)
    doubtful = chunk_dictionary(made).filter(~F.col("verified")).isEmpty()
    made = made.withColumn("_list", F.col("recipe" if doubtful else "strong"))
    # the first row by (doc_id, row_no); a null doc_id comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("_keep")
    # written, so that the join's sides are shuffled apart and a hot group's rows can be split
    groups = materialize(
        made.groupBy(F.col("_list").alias("_of")).agg(first, F.count(F.lit(1)).alias("group_size")), "recipe-groups"
    )
    return made.join(groups, F.col("_list") == F.col("_of")).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_keep.row_no") == F.col("row_no")).alias("kept"),
        "text_sha256",
        F.size("lengths").cast("long").alias("n_chunks"),
        "row_key",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns untouched."""
    decisions = materialize(exact_duplicates(docs), "exact-decisions")
    return drop_rows(docs, decisions)
