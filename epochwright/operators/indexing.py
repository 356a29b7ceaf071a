"""Numbering and prefix sums that never put a whole group into one task.

``row_number() over (partition by key)`` sends every row of a key to one task.
Here a key may hold a third of the table, so both operators work on bounded
chunks of a group and add per-chunk offsets afterwards.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwright.session import materialize, sized

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits
_BLOCK_BITS = 16  # positions per block: 65,536


def row_index(
    df: DataFrame, keys: list[str], order_by: list[str], out: str = "idx"
) -> DataFrame:
    """Dense 0-based position of each row within ``keys``, in ``order_by`` order.

    One range shuffle on (keys, order) spreads a hot key over many partitions.
    The sorted rows are written once with their position; first position and
    row count of each (key, partition) chunk then give the offset to add.
    ``order_by`` must order the rows of a key totally.
    """
    sort = [*keys, *order_by]
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "row-index").withColumn(
        "_part", F.shiftright("_at", _POSITION_BITS)
    )
    chunks = placed.groupBy(*keys, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = chunks.select(
        *[F.col(key).alias(f"_key_{key}") for key in keys],
        F.col("_part").alias("_key__part"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    # null-safe, so rows with a null key are numbered too instead of lost
    shifts = sized(shifts, "row-index-shifts")
    same_chunk = reduce(
        and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in [*keys, "_part"]]
    )
    return placed.join(shifts, same_chunk).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(out)
    )


def running_total(
    df: DataFrame, keys: list[str], position: str, value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of ``keys`` (exclusive prefix sum).

    ``position`` is an integer, unique within ``keys``; fixed ranges of it bound
    the rows any one task sorts, however many rows the key has.
    """
    block = [*keys, "_block"]
    inside = (
        Window.partitionBy(*block)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # written once: the rows are needed for the block totals and again for the join
    ranged = materialize(
        df.withColumn("_block", F.shiftright(F.col(position).cast("long"), _BLOCK_BITS))
        .withColumn("_value", value.cast("long"))
        .withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0))),
        "running-total",
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*block)
        .agg(F.sum("_value").alias("_total"))
        .select(*block, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(sized(offsets, "running-total-offsets"), block)
        .withColumn(out, F.col(out) + F.col("_offset"))
        .select(*df.columns, out)
    )


def number_rows(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    sums: dict[str, Column] | None = None,
    out: str = "idx",
) -> DataFrame:
    """Position and exclusive prefix sums of each row within ``keys``, in ``order_by`` order.

    ``sums`` maps an output column to the value it adds up (cast to bigint, null
    counts as 0). One range shuffle and one write of the rows; count and sums
    inside a (key, partition) chunk come from one window, and the chunks'
    offsets from a table of their totals. ``df`` should carry only narrow
    columns; ``order_by`` must order the rows of a key totally. ``keys`` may be
    empty: then the whole table is numbered.
    """
    sums = sums or {}
    sort = [*keys, *order_by]
    values = [F.coalesce(value.cast("long"), F.lit(0)).alias(f"_v_{name}") for name, value in sums.items()]
    placed = materialize(
        df.select(*df.columns, *values)
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()),
        "number-rows",
    ).withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    chunk = [*keys, "_part"]
    inside = Window.partitionBy(*chunk).orderBy("_at")
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = totals.select(
        *[F.col(c).alias(f"_key_{c}") for c in chunk],
        *[
            F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name, column in [(out, "_rows"), *[(name, f"_t_{name}") for name in sums]]
        ],
    )
    same_chunk = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in chunk])
    numbered = placed.select(
        *df.columns,
        "_part",
        (F.row_number().over(inside) - 1).cast("long").alias(f"_i_{out}"),
        *[F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)).alias(f"_i_{name}") for name in sums],
    )
    return numbered.join(sized(offsets, "number-rows-offsets"), same_chunk).select(
        *df.columns, *[(F.col(f"_i_{name}") + F.col(f"_o_{name}")).alias(name) for name in [out, *sums]]
    )
