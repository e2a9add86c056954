"""Materialisation and size checks for plans that need them."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

#: largest side that is ever shipped whole to every executor
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder every node can reach: the one the cluster names.

    Only a local session, where all work is on one machine, may do without;
    it gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hushscan-"))
    return context.getCheckpointDir()


#: what ``release`` has to let go: (session, path) of tables, (session, frame) of held results
_TABLES: list[tuple[SparkSession, str]] = []
_HELD: list[tuple[SparkSession, DataFrame]] = []


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, removed by ``release`` or at the end of the process."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    Used where a plan needs an expensive, small result more than once: the work
    is done once, a lost executor costs no recompute, and the file sizes tell
    the optimizer what it may broadcast.  Only for results without credentials.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep a result that holds credentials or raw texts inside the executors.

    Nothing is written to the shared folder; what a lost executor held is
    computed again.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append((df.sparkSession, held))
    return held


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables and held results of a session (default: of all).

    For the end of a job: results that were not written yet cannot be read
    any more.
    """
    for kept, let_go in ((_HELD, lambda s, held: held.unpersist()), (_TABLES, delete)):
        for entry in list(kept):
            session, what = entry
            if spark is None or session is spark:
                kept.remove(entry)
                if session.sparkContext._jsc is not None:
                    let_go(session, what)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone before its process
        release()


def never_broadcast(df: DataFrame) -> DataFrame:
    """Joins of ``df`` shuffle both sides.

    For sides that an explode or a Python step made larger than the input: the
    optimizer still takes them for as small as the files, and would have the
    driver collect them.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, *columns: str) -> DataFrame:
    """Broadcast ``df`` only after measuring it; otherwise Spark shuffles the join.

    ``columns`` are all its columns of variable width.  ``df`` is counted here
    and read again later, so it should be materialised or held.
    """
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns]
    width = sum(widths, F.lit(16 + 8 * len(df.columns)))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return never_broadcast(df)
