"""Distinct counts that can be kept with the findings and merged later.

A sketch per key and slice (a day, a scan, a repository) is some kilobytes
whatever it counts; merging slices reads no finding again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: 2^14 registers
PRECISION = 14


def relative_error(precision: int = PRECISION) -> float:
    """Standard error of an estimate as a share of the count."""
    return 1.04 / 2 ** (precision / 2)


def sketch_counts(rows: DataFrame, counted: str, by: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """One row (*by, sketch) per group: the distinct non-null ``counted``; combined before the shuffle."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(counted).cast("string"), F.lit(precision)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of slices united per ``by``: what is in several slices counts once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, name: str = "n") -> DataFrame:
    """The counts of sketches, in place of them."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
