"""Ordered work over long sequences without one task per sequence.

A window over a whole sequence puts the longest one into a single task.  Here
rows are cut into ranges of (group, order) with about equally many rows each,
whatever the values of the order column; ranges are processed in parallel and
only one summary row per group and range travels along a sequence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.operators.cluster import materialise

#: rows of a range
BLOCK = 100_000


def range_starts(rows: DataFrame, keys: Sequence[str], block: int = BLOCK) -> list[tuple]:
    """Where the ranges begin, one tuple of ``keys`` for each but the first, in order.

    Only the keys are read and dealt out; a range has about ``block`` rows, so
    the driver gets one row for each ``block`` of the table.
    """
    placed = rows.select(*keys)
    parts = -(-placed.count() // block)
    if parts < 2:
        return []
    dealt = placed.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    starts = dealt.groupBy("_part").agg(F.min(F.struct(*keys)).alias("start")).orderBy("start").collect()
    return [tuple(r.start) for r in starts[1:]]


def range_of(rows: DataFrame, keys: Sequence[str], starts: Sequence[tuple]) -> Column:
    """The number of the range a row is in, found by bisection."""
    if not starts:
        return F.lit(0)
    columns = [
        F.lit([s[i] for s in starts]).cast(f"array<{rows.schema[k].dataType.simpleString()}>") if None not in [s[i] for s in starts]
        else F.array(*[F.lit(s[i]).cast(rows.schema[k].dataType) for s in starts])
        for i, k in enumerate(keys)
    ]
    mine = F.struct(*keys)
    steps = [1 << i for i in range(len(starts).bit_length() - 1, -1, -1)]

    def reached(at: Column, step: Column) -> Column:
        start = F.struct(*[F.get(c, at + step - 1).alias(k) for c, k in zip(columns, keys)])
        return at + F.when((at + step <= len(starts)) & (start <= mine), step).otherwise(0)

    return F.aggregate(F.lit(steps), F.lit(0), reached)


def carry_forward(
    rows: DataFrame,
    group: Sequence[str],
    order: str,
    last: Mapping[str, Column],
    total: Mapping[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add, per row, the latest non-NULL value and the running total so far.

    ``last`` and ``total`` map new column names to expressions; both include
    the current row.  ``rows`` are read three times.
    """
    total = total or {}
    keys = [*group, order]
    keyed = rows.withColumn("_block", range_of(rows, keys, range_starts(rows, keys, block)))
    names = [*last, *total]
    summary = keyed.groupBy(*group, "_block").agg(
        *[F.max_by(e, F.when(e.isNotNull(), F.col(order))).alias(n) for n, e in last.items()],
        *[F.sum(e).alias(n) for n, e in total.items()],
    )
    before = (
        Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    entering = summary.select(
        *group,
        "_block",
        *[F.last(n, True).over(before).alias(f"_in_{n}") for n in last],
        *[F.sum(n).over(before).alias(f"_in_{n}") for n in total],
    )
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = keyed.select(
        "*",
        *[F.last(e, True).over(inside).alias(f"_at_{n}") for n, e in last.items()],
        *[F.sum(e).over(inside).alias(f"_at_{n}") for n, e in total.items()],
    )
    joined = local.join(entering, [*group, "_block"], "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(f"_at_{n}", f"_in_{n}").alias(n) for n in last],
        *[
            (F.coalesce(f"_at_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0))).alias(n)
            for n in total
        ],
    )


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``nth``, the 1-based position of each row in its group.

    Rows are range-partitioned by group *and* order, so that one huge group
    spans many partitions; positions inside a partition are offset by the
    counts of the partitions before it.  The partition numbers are fixed by
    writing the sorted rows.
    """
    keys = [*group, *order]
    placed = materialise(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_here"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        placed.withColumn("_in_part", F.row_number().over(inside))
        .join(offsets, [*group, "_part"])
        .select(*rows.columns, (F.col("_in_part") + F.col("_before")).alias("nth"))
    )
