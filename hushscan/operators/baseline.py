"""Accepted-finding baselines: new, accepted and resolved findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushscan.functions import patterns as P
from hushscan.operators.detect import finding_id


def to_baseline(findings: DataFrame) -> DataFrame:
    """Rows a baseline stores: never the value."""
    return findings.select(
        F.col("finding_id").alias("id"),
        F.col("source_id").alias("file"),
        "kind",
        "line",
    )


def _former_ids(findings: DataFrame) -> DataFrame:
    """(finding_id, former_id): under which fingerprints reclassified findings may be stored."""
    old = [finding_id(F.col("source_id"), F.lit(kind), F.col("value")) for kind in P.FORMER_KINDS]
    changed = findings.where(F.col("kind").isin(*P.RECLASSIFIED_KINDS))
    return changed.select("finding_id", F.explode(F.array(*old)).alias("former_id"))


def _accepted_ids(findings: DataFrame, baseline: DataFrame, legacy: bool) -> DataFrame:
    """Current fingerprints that the baseline holds, directly or under a former one.

    Only the few reclassified findings take part in the former-id join.
    """
    known = baseline.select(F.col("id").alias("_known")).where("id is not null").distinct()
    if not legacy:
        return known
    former = _former_ids(findings).join(known, F.col("former_id") == F.col("_known"), "left_semi")
    return known.unionByName(former.select(F.col("finding_id").alias("_known"))).distinct()


def new_findings(findings: DataFrame, baseline: DataFrame, legacy: bool = True) -> DataFrame:
    """Findings whose current or former id is not in the baseline.

    One equi anti-join of all findings: Spark broadcasts a baseline it measures
    as small and sort-merges a large one, splitting skewed fingerprints.
    """
    known = _accepted_ids(findings, baseline, legacy)
    return findings.join(known, F.col("finding_id") == F.col("_known"), "left_anti")


def accepted_findings(findings: DataFrame, baseline: DataFrame, legacy: bool = True) -> DataFrame:
    """Findings the baseline already holds, under their current or a former id."""
    known = _accepted_ids(findings, baseline, legacy)
    return findings.join(known, F.col("finding_id") == F.col("_known"), "left_semi")


def resolved(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """Baseline entries that no current finding corresponds to any more."""
    own = findings.select(F.col("finding_id").alias("_id"))
    ids = own.unionByName(_former_ids(findings).select(F.col("former_id").alias("_id"))).distinct()
    return baseline.join(ids, F.col("id") == F.col("_id"), "left_anti")


def keep_baseline(baseline: DataFrame, table: str, path: str, buckets: int = 200) -> None:
    """Write a baseline as a table bucketed by fingerprint; entries without one are left out.

    Scans compared with it later shuffle their findings only, and not even
    those where they are kept in as many buckets by ``finding_id``.
    """
    rows = baseline.where("id is not null").dropDuplicates(["id"])
    rows.write.bucketBy(buckets, "id").sortBy("id").mode("overwrite").option("path", path).saveAsTable(table)


def new_against_kept(findings: DataFrame, table: str, legacy: bool = True) -> DataFrame:
    """``new_findings`` against a kept baseline, whose rows are never shuffled.

    Former fingerprints are looked up by a join of their own, since a union
    with them would lose the buckets.
    """
    spark: SparkSession = findings.sparkSession
    known = spark.table(table).select("id")
    new = findings.join(known, F.col("finding_id") == F.col("id"), "left_anti")
    if not legacy:
        return new
    former = _former_ids(findings).join(known, F.col("former_id") == F.col("id"), "left_semi")
    stored = former.select(F.col("finding_id").alias("_stored")).distinct()
    return new.join(stored, F.col("finding_id") == F.col("_stored"), "left_anti")
