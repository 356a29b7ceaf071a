"""Shuffled shards by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets by a seeded hash; there
are as many buckets as keep each within ``BUCKET_BYTES`` and ``BUCKET_ROWS`` on
average, so a task holds one bucket in memory. Pass two shuffles each bucket
with Fisher and Yates' algorithm, its draws hashed from seed, bucket and step,
and writes it. Buckets follow one another; the whole sequence is a uniformly
random permutation, and it is cut into shards whose counts differ by one at
most. Records cross one exchange.

Same rows, seed and bucket sizes give the same order, whatever the partitions
and however often a task was run again. Rows that repeat one id and text over
``HEAVY`` times are dealt to buckets by their place in the input as well, so
they too are spread; therefore ``docs`` must be read from files, where a task
that is run again sees the same rows in the same order.

Results for odd input: a null text has no bytes and stays null; a null doc_id
is a value like any other; repeated rows are all placed; all columns pass
through untouched; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import text_or_empty
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize

SHARDS = 16
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 2_048
HEAVY = 256
SEED = 7


def record_bytes() -> Column:
    """UTF-8 bytes of the text and one more."""
    return (F.octet_length(text_or_empty()) + 1).cast("long")


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def heavy_keys(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(_heavy): keys that more than ``HEAVY`` rows share."""
    keys = docs.select(_key(seed).alias("_heavy"))
    return keys.groupBy("_heavy").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > HEAVY).select("_heavy")


def scatter(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass one: _record, _key and _bucket of every row."""
    keyed = docs.select(F.struct(*docs.columns).alias("_record"), "doc_id", "text").select(
        "_record", _key(seed).alias("_key"), F.monotonically_increasing_id().alias("_at")
    )
    heavy = materialize(heavy_keys(docs, seed), "heavy-keys")
    marked = keyed.join(heavy, F.col("_key") == F.col("_heavy"), "left")
    spread = F.when(F.col("_heavy").isNotNull(), F.xxhash64("_key", "_at")).otherwise(F.col("_key"))
    return marked.select("_record", "_key", F.pmod(spread, F.lit(buckets)).cast("long").alias("_bucket"))


def fisher_yates(size: Column, bucket: Column, seed: int = SEED) -> Column:
    """A random order of 0 to ``size`` - 1: step i puts i in place j <= i and what was there at the end."""
    step = F.sequence(F.lit(0), size - 1)

    def put(order, i):
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        swapped = F.concat(
            F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, i - j - 1), F.array(F.get(order, j))
        )
        return F.when(j < i, swapped).otherwise(F.concat(order, F.array(i)))

    return F.aggregate(step, F.array().cast("array<int>"), put)


def shuffle_buckets(scattered: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass two: _bucket, _place (from 0 in the bucket) and _record."""
    # one bucket to a task, as far as hashing spreads them
    whole = (
        scattered.repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.collect_list("_key").alias("_keys"), F.collect_list("_record").alias("_records"))
    )
    # as collected, the order depends on which task's rows arrived first
    steady = F.sort_array(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    ordered = whole.select(
        "_bucket", "_records", steady.alias("_steady"), fisher_yates(F.size("_keys"), F.col("_bucket"), seed).alias("_order")
    )
    return ordered.select(
        "_bucket",
        F.posexplode(F.transform("_order", lambda i: F.get("_records", F.get("_steady", i)["i"]))).alias("_place", "_record"),
    )


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact beyond 2**53."""
    return F.call_function("div", a, b)


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """record (all columns of a row of ``docs``), shard (from 0) and slot (from 0 in the shard)."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_bytes()), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes), -(-rows // bucket_rows))
    shuffled = materialize(shuffle_buckets(scatter(docs, buckets, seed), buckets, seed), "shuffled-buckets")
    counts = shuffled.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    begins = number_rows(counts, [], ["_bucket"], {"_base": F.col("_rows")}, out="_nth")
    begins = materialize(begins.select(F.col("_bucket").alias("_b"), "_base"), "bucket-begins")
    placed = shuffled.join(begins, F.col("_bucket") == F.col("_b")).select(
        "_record", (F.col("_base") + F.col("_place")).cast("long").alias("_position")
    )
    n, of = F.lit(max(rows, 1)).cast("long"), F.lit(shards).cast("long")
    shard = _div(F.col("_position") * of, n)
    return placed.select("_record", "_position", shard.alias("_shard")).select(
        F.col("_record").alias("record"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_position") - _div(F.col("_shard") * n + of - 1, of)).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write :func:`sharded` below ``path``, a folder a shard; a file holds stretches of slots in order."""
    sharded(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
