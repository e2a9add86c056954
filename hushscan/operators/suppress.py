"""Inline suppression as tables: markers, their union per line, and the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hushscan.functions.markers import parse_markers
from hushscan.operators.detect import DEFAULT
from hushscan.options import Options


def markers(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    options: Options = DEFAULT,
) -> DataFrame:
    """(source_id, line, all_kinds, kinds): everything targeting a line, united."""
    found = (
        texts.where(F.contains(F.col(text), F.lit(options.marker_prefix)))
        .select(
            F.col(source_id).cast("string").alias("source_id"),
            parse_markers(F.col(text), options.marker_prefix).alias("m"),
        )
        .select("source_id", F.explode_outer("m").alias("m"))
        .where(F.col("m").isNotNull())
        .select("source_id", "m.line", "m.all_kinds", "m.kinds")
    )
    named = found.select(
        "source_id", "line", "all_kinds", F.explode_outer("kinds").alias("kind")
    )
    # collect_set merges before the shuffle, so repeated markers on a line cost nothing
    return named.groupBy("source_id", "line").agg(
        F.bool_or("all_kinds").alias("all_kinds"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
    )


def _covered(findings: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    f, m = findings.alias("f"), marks.alias("m")
    return f.join(
        m,
        (F.col("f.source_id") == F.col("m.source_id"))
        & (F.col("f.line") == F.col("m.line"))
        & (F.col("m.all_kinds") | F.array_contains(F.col("m.kinds"), F.col("f.kind"))),
        how,
    )


def apply_markers(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings not covered by a marker on their first line."""
    return _covered(findings, marks, "left_anti")


def suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings a marker covers."""
    return _covered(findings, marks, "left_semi")
