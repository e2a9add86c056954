"""Detection over a table of texts: one narrow pass, findings out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hushscan.functions import redaction, spans as S
from hushscan.functions.folds import bind
from hushscan.functions.markers import parse_markers
from hushscan.functions.memo import memoised
from hushscan.options import Options

DEFAULT = Options()


@memoised
def scan_column(text: str, options: Options, extra: str | None = None) -> Column:
    """Struct ``(spans, inline_ignored)`` for the text column named ``text``.

    built-in spans -> merge -> placeholder filter; custom spans -> placeholder
    filter; both located, then inline markers applied inside the row.  ``extra``
    names a column of further custom spans.
    """
    body = F.col(text)
    found = S.detect_spans(body, options.entropy_threshold)
    if options.rules:
        found = F.concat(found, S.custom_spans(body, options.rules))
    if extra is not None:
        found = F.concat(found, F.col(extra))
    if options.apply_placeholders:
        found = F.filter(found, lambda s: ~S.is_placeholder(s["value"]))
    located = S.locate_spans(body, found)
    if not options.apply_markers:
        return F.struct(located.alias("spans"), F.lit(0).alias("inline_ignored"))

    def suppress(view: Column) -> Column:
        def hidden(s: Column) -> Column:
            return F.exists(
                view["markers"],
                lambda m: (m["line"] == s["line"])
                & (m["all_kinds"] | F.array_contains(m["kinds"], s["kind"])),
            )

        kept = F.when(
            F.size(view["markers"]) > 0, F.filter(view["spans"], lambda s: ~hidden(s))
        ).otherwise(view["spans"])
        return bind(
            kept,
            lambda k: F.struct(
                k.alias("spans"), (F.size(view["spans"]) - F.size(k)).alias("inline_ignored")
            ),
        )

    markers = parse_markers(body, options.marker_prefix)
    return bind(
        located,
        lambda s: bind(
            F.struct(
                s.alias("spans"),
                F.when(F.size(s) > 0, markers).alias("markers"),
            ),
            suppress,
        ),
    )


@memoised
def redact_column(text: str, options: Options) -> Column:
    return redaction.redact(F.col(text), options.entropy_threshold, options.mask)


def finding_id(file: Column, kind: Column, value: Column) -> Column:
    """Fingerprint of a finding; the value cannot be read back from it."""
    return F.sha2(F.concat_ws(":", file.cast("string"), kind, value), 256)


def scan_texts(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    options: Options = DEFAULT,
    keep: Sequence[str] = (),
    extra: str | None = None,
) -> DataFrame:
    """One row per text: ``source_id``, kept columns, ``spans``, ``inline_ignored``."""
    scanned = texts.select(
        F.col(source_id).cast("string").alias("source_id"),
        *keep,
        scan_column(text, options, extra).alias("scan"),
    )
    return scanned.select("source_id", *keep, "scan.spans", "scan.inline_ignored")


def explode_findings(scanned: DataFrame, keep: Sequence[str] = (), first_line: str | None = None) -> DataFrame:
    """One row per finding.

    ``first_line`` names a kept column with the line number at which each text
    starts in its file (default: all start at line 1).

    ``explode_outer`` with a filter behind it, not ``explode``: the latter makes
    the optimizer copy the whole detection expression into an inferred filter.
    """
    rows = scanned.select("source_id", *keep, F.explode_outer("spans").alias("f")).where(
        F.col("f").isNotNull()
    )
    line, end_line = F.col("f.line"), F.col("f.end_line")
    if first_line is not None:
        shift = F.coalesce(F.col(first_line), F.lit(1)).cast("int") - 1
        line, end_line = line + shift, end_line + shift
    return rows.select(
        "source_id",
        *keep,
        F.col("f.start").alias("start"),
        F.col("f.end").alias("end"),
        line.alias("line"),
        F.col("f.column").alias("column"),
        end_line.alias("end_line"),
        F.col("f.end_column").alias("end_column"),
        F.col("f.kind").alias("kind"),
        F.col("f.value").alias("value"),
        F.col("f.custom").alias("custom"),
        finding_id(F.col("source_id"), F.col("f.kind"), F.col("f.value")).alias("finding_id"),
    )


def detect(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    options: Options = DEFAULT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """texts -> findings, values included (internal; see ``public``)."""
    return explode_findings(scan_texts(texts, source_id, text, options, keep), keep)


def public(findings: DataFrame) -> DataFrame:
    """What may leave the engine: every column but the credential itself."""
    secret = [c for c in ("value", "core", "needle") if c in findings.columns]
    return findings.drop(*secret)
