"""Structured Streaming: redaction, findings, first-seen, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hushscan.operators.detect import DEFAULT, detect, public, redact_column
from hushscan.operators.redact import redact_texts
from hushscan.options import Options


def redact_stream(
    lines: DataFrame, text: str = "text", options: Options = DEFAULT, flag: str = "was_redacted"
) -> DataFrame:
    """Every complete line redacted before it is emitted; stateless, append mode."""
    return redact_texts(lines, text, options, flag)


def findings_stream(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    options: Options = DEFAULT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Detection on each micro-batch; the same plan as in batch, values dropped."""
    return public(detect(texts, source_id, text, options, keep))


def first_seen_stream(findings: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First row per fingerprint within the watermark; state older than it is dropped."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["finding_id"])


def alerts(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    ts: str = "ts",
    options: Options = DEFAULT,
) -> DataFrame:
    """One value-free row per text that had something redacted; none when muted."""
    rows = texts.select(
        F.col(ts).alias("ts"),
        F.col(source_id).cast("string").alias("source_id"),
        redact_column(text, options)["redacted"].alias("redacted"),
    )
    return rows.where(F.col("redacted") & F.lit(options.enabled and options.notify)).select(
        "ts", "source_id", F.lit("potential secret detected and redacted").alias("message")
    )


def alert_counts(
    findings: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str | None = None
) -> DataFrame:
    """Findings per kind and tumbling window; ``delay`` sets the watermark of a stream."""
    rows = findings.withWatermark(ts, delay) if delay else findings
    return (
        rows.groupBy(F.window(ts, window).alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("findings"))
        .select(F.col("w.start").alias("window_start"), "kind", "findings")
    )


def quarantine(texts: DataFrame, text: str = "text", options: Options = DEFAULT) -> DataFrame:
    """Redact, and mark rows that could not be examined instead of passing them silently.

    ``quarantined`` is true for a text that is not valid UTF-8; it is withheld.
    """
    valid = F.is_valid_utf8(F.col(text))
    out = redact_texts(texts.withColumn("_valid", valid), text, options)
    return out.withColumn(
        text, F.when(F.coalesce("_valid", F.lit(True)), F.col(text))
    ).withColumn("quarantined", ~F.coalesce("_valid", F.lit(True))).drop("_valid")
