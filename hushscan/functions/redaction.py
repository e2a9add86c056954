"""Redaction as Column expressions (never a placeholder, marker or custom-rule filter)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hushscan.functions import patterns as P
from hushscan.functions.folds import bind, chunked, cut, running
from hushscan.functions.spans import detect_spans


def replace_spans(text: Column, spans: Column, mask: str = P.DEFAULT_MASK) -> Column:
    """Text with every (merged, ordered) span replaced by ``mask``."""

    def rebuild(chunks: Column) -> Column:
        pieces = running(
            spans,
            F.lit(0),
            lambda at, s: s["start"] - s["neg"],
            lambda at, s: F.array(cut(chunks, at, s["start"]), F.lit(mask)),
            "string",
            lambda at: F.array(cut(chunks, at, F.length(text))),
        )
        return F.array_join(pieces, "")

    return bind(chunked(text), rebuild)


def redact(
    text: Column,
    threshold: float = P.DEFAULT_ENTROPY_THRESHOLD,
    mask: str = P.DEFAULT_MASK,
) -> Column:
    """Struct ``(text, redacted)``; NULL and clean texts pass through unchanged."""
    return bind(
        detect_spans(text, threshold),
        lambda spans: F.struct(
            F.when(F.size(spans) > 0, replace_spans(text, spans, mask))
            .otherwise(text)
            .alias("text"),
            F.coalesce(F.size(spans) > 0, F.lit(False)).alias("redacted"),
        ),
    )


def scrub_values(values: Sequence[str], min_length: int = 6, min_line: int = 12) -> list[str]:
    """Literals to hide for known values, longest first."""
    wanted: set[str] = set()
    for value in values:
        if len(value) >= min_length:
            wanted.add(value)
        if "\n" in value:
            wanted.update(s for s in map(str.strip, value.splitlines()) if len(s) >= min_line)
    return sorted(wanted, key=lambda v: (-len(v), v))


def scrub(text: Column, values: Sequence[str], mask: str = P.DEFAULT_MASK) -> Column:
    """Replace every occurrence of known literal values."""
    literals = scrub_values(values)
    if not literals:
        return text
    return F.aggregate(
        F.array(*[F.lit(v) for v in literals]),
        text,
        lambda out, v: F.replace(out, v, F.lit(mask)),
    )
