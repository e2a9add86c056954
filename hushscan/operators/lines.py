"""Reassembling lines from text that arrives in fragments (batch)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from hushscan.operators.ordered import BLOCK, carry_forward

#: an unterminated line longer than this is released as it stands
MAX_BUFFERED = 65_536


def reassemble(
    chunks: DataFrame,
    stream_id: str = "stream_id",
    seq: str = "seq",
    fragment: str = "fragment",
    flush: str | None = None,
    cap: int = MAX_BUFFERED,
    block: int = BLOCK,
) -> DataFrame:
    """(stream_id, part, ord, line) in write order: the lines as they would be released.

    A line ends at ``\\n``, at a fragment whose ``flush`` flag is set, or when
    more than ``cap`` characters are waiting after a write.  Line numbers come
    from running totals over blocks of writes, so a stream holding most of the
    data is cut up like any other; each line is then put together on its own.
    """
    flushed = F.col(flush) if flush else F.lit(False)
    pieces = F.split(F.coalesce(fragment, F.lit("")), "\n", -1)
    writes = chunks.select(
        F.col(stream_id).alias("stream_id"),
        F.col(seq).cast("long").alias("seq"),
        pieces.alias("pieces"),
        F.coalesce(flushed, F.lit(False)).alias("flushed"),
    )
    ends = F.size("pieces") - 1 + F.col("flushed").cast("int")
    numbered = carry_forward(
        writes.withColumn("ends", ends.cast("long")), ["stream_id"], "seq", {}, {"ended": F.col("ends")}, block
    )
    parts = numbered.select(
        "stream_id",
        "seq",
        (F.col("ended") - F.col("ends")).alias("base"),
        F.size("pieces").alias("n"),
        F.posexplode("pieces").alias("at", "piece"),
    ).select(
        "stream_id",
        (F.col("base") + F.col("at")).alias("part"),
        "seq",
        "at",
        F.when(F.col("at") < F.col("n") - 1, F.concat("piece", F.lit("\n"))).otherwise(F.col("piece")).alias("piece"),
    )
    parts = parts.where(F.col("piece") != "")
    sizes = parts.groupBy("stream_id", "part").agg(F.sum(F.length("piece")).alias("chars"))
    long_ones = sizes.where(F.col("chars") > cap).select("stream_id", "part")
    short = parts.join(long_ones, ["stream_id", "part"], "left_anti").withColumn("ord", F.lit(0).cast("long"))
    cuts = _cut_long(parts.join(long_ones, ["stream_id", "part"], "left_semi"), cap)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", "piece")))
    return (
        short.unionByName(cuts)
        .groupBy("stream_id", "part", "ord")
        .agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("line"))
    )


def _cut_long(parts: DataFrame, cap: int) -> DataFrame:
    """Number the releases inside over-long lines.

    A release depends on the previous one, so this walks each such line in
    order; it streams through a sorted partition and holds one counter.
    """

    def walk(batches: Iterator) -> Iterator:
        here, waiting, number = None, 0, 0
        for batch in batches:
            numbers = []
            for stream, part, size, closes in zip(
                batch["stream_id"], batch["part"], batch["size"], batch["closes"]
            ):
                if (stream, part) != here:
                    here, waiting, number = (stream, part), 0, 0
                numbers.append(number)
                waiting += size
                # a piece that ends the line is released by its newline, not the cap
                if waiting > cap and not closes:
                    waiting, number = 0, number + 1
            batch["ord"] = numbers
            yield batch[["stream_id", "part", "seq", "at", "ord"]]

    kind = parts.schema["stream_id"].dataType.simpleString()
    lengths = parts.select(
        "stream_id", "part", "seq", "at", F.length("piece").alias("size"),
        F.endswith("piece", F.lit("\n")).alias("closes"),
    )
    numbered = (
        lengths.repartition("stream_id", "part")
        .sortWithinPartitions("stream_id", "part", "seq", "at")
        .mapInPandas(walk, f"stream_id {kind}, part long, seq long, at int, ord long")
    )
    return parts.join(numbered, ["stream_id", "part", "seq", "at"])
