"""First appearance and commit count of findings, kept up to date by a stream.

A batch leaves one row for each (scope, file, kind, fingerprint, commit), in a
part named by the batch, so a batch that is run again replaces its own part.
Reading folds all parts as the batch operator would fold all findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from hushscan.operators.cluster import delete
from hushscan.operators.history import first_seen

_BEST = ("line", "rank", "hunk", "first_line", "start")


def _folded(findings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The earliest row of every commit; no credential is kept."""
    held = [c for c in _BEST if c in findings.columns]
    tie = "hunk" if "hunk" in held else "first_line"
    order = F.struct("rank", (-F.col(tie)).alias("t"), (-F.col("start")).alias("s"))
    best = findings.groupBy(*scope, "source_id", "kind", "finding_id", "commit").agg(F.max_by(F.struct(*held), order).alias("b"))
    return best.select(*scope, "source_id", "kind", "finding_id", "commit", "b.*")


def _parts(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(last batch of the newest whole base, folders to read by batch), from finished folders only."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "batch": {}}
    for status in system.listStatus(place) if system.exists(place) else ():
        kind, _, number = status.getPath().getName().partition("-")
        whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if kind in found and system.exists(whole):
            found[kind][int(number)] = status.getPath().toString()
    last = max(found["base"], default=-1)
    read = {n: p for n, p in found["batch"].items() if n > last}
    if last >= 0:
        read[last] = found["base"][last]
    return last, read


def record(findings: DataFrame, batch: int, path: str, scope: Sequence[str] = ()) -> None:
    """Add a batch of findings to the table at ``path``; running it again changes nothing.

    A batch that a compaction already holds is left out.
    """
    last, _ = _parts(findings.sparkSession, path)
    if batch > last:
        _folded(findings, scope).write.mode("overwrite").parquet(f"{path}/batch-{batch}")


def record_stream(findings: DataFrame, path: str, scope: Sequence[str] = ()) -> DataStreamWriter:
    """A writer that records every micro-batch; start it with a checkpoint of its own."""
    return findings.writeStream.foreachBatch(lambda rows, batch: record(rows, batch, path, scope))


def compact(spark: SparkSession, path: str, scope: Sequence[str] = ()) -> None:
    """Fold all parts into one, so that reading does not grow with the number of batches.

    For the pauses between batches.  The parts go only after the new base is
    whole; an interrupted run leaves a table that reads the same.
    """
    last, parts = _parts(spark, path)
    newest = max(parts, default=-1)
    if newest > last:
        rows = spark.read.parquet(*parts.values())
        _folded(rows, scope).write.mode("overwrite").parquet(f"{path}/base-{newest}")
    for folder in parts.values():
        if not folder.endswith(f"/base-{newest}"):
            delete(spark, folder)


def first_commits(spark: SparkSession, path: str, scope: Sequence[str] = ()) -> DataFrame | None:
    """Oldest appearance and number of other commits, as ``history.first_seen``; None before the first batch."""
    _, parts = _parts(spark, path)
    return first_seen(spark.read.parquet(*parts.values()), tuple(scope)) if parts else None
