"""Mix sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time [0, 1].  The integral of
the schedule is the source's weight; the weights share out the wanted words,
limited to ``epochs`` passes over a source.  Within a source the documents
stand in a fixed pseudo-random order.  The words before a document in that
order, pass after pass, are the cumulative demand at which it is used up;
inverting the integrated schedule there gives its position in training time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.llm.common import WORD


@dataclass(frozen=True)
class Curriculum:
    """``weights`` go to the sources by code point (null last), repeating.

    ``shapes`` go with the weights: knots (time, height) of a piecewise linear
    schedule from time 0 to 1.  A shape is scaled so that its integral is the
    weight, so it moves words in time without changing how many are used.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    shapes: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
        ((0.0, 1.5), (1.0, 0.5)),
    )
    share: float = 1.5
    epochs: int = 2


def integrate(shape) -> list[tuple[float, float, float, float, float]]:
    """Segments (start, width, height at start, height at end, demand before), demand summing to 1."""
    pieces, total = [], 0.0
    for (t0, h0), (t1, h1) in zip(shape, shape[1:]):
        pieces.append((t0, t1 - t0, h0, h1, total))
        total += (h0 + h1) / 2 * (t1 - t0)
    return [(t, w, h0 / total, h1 / total, before / total) for t, w, h0, h1, before in pieces]


def invert(shape, demand: Column) -> Column:
    """The time at which the integrated ``shape`` reaches ``demand`` (0 to 1).

    Inside a segment the demand is a parabola; the root is written so that it
    stays exact where the parabola is a line.
    """
    time = None
    for start, width, h0, h1, before in integrate(shape):
        rest = demand - F.lit(before)
        bend = F.lit(2 * (h1 - h0) / width)
        root = F.lit(start) + F.lit(2.0) * rest / (F.lit(h0) + F.sqrt(F.lit(h0 * h0) + bend * rest))
        time = root if time is None else F.when(demand > F.lit(before), root).otherwise(time)
    if time is None:
        raise ValueError("a schedule needs two knots")
    return time


def sized(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """(source, size) rows -> one row per source with its size, class and target.

    A source is full at ``epochs`` times its size.  Taking the sources by full
    size over weight, each one is full if the words left, shared by the
    weights left, would overfill it; the first that is not fixes the words per
    weight of all that follow.  This is the fixed point of resharing.
    """
    by_source = sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    weighed = by_source.select(
        "source", "key", "source_size",
        ((F.row_number().over(place) - 1) % len(plan.shapes)).alias("shape"),
        F.get(weights, (F.row_number().over(place) - 1) % len(plan.weights)).alias("weight"),
        (F.col("source_size") * plan.epochs).alias("full"),
    )
    fill = F.col("full") / F.col("weight")
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(plan.share)) - (
        F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    )
    leveled = weighed.withColumn("fill", fill).select(
        "*",
        (left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("level"),
        F.row_number().over(order).alias("rank"),
    )
    first = F.min(F.when(F.col("level") < F.col("fill"), F.struct("rank", "level"))).over(everything)["level"]
    full = F.col("full").cast("double")
    return leveled.select(
        "key", "source_size", "shape", F.least(full, F.coalesce(first * F.col("weight"), full)).alias("target")
    )


def curriculum(docs: DataFrame, plan: Curriculum = Curriculum(), *, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with what the mix takes of it, range-sorted by position.

    Columns: ``keep``, doc_id, size, source_size, target, taken, uses
    (array of epoch, words, position) and position (that of the first use, or
    null).  A source's last document may be taken in part, so that the words
    taken are the target to the word.  Other columns of ``docs``, whatever
    their names, are not carried unless named in ``keep``.

    Null source: a source of its own, after all others.  Null or blank text:
    size 0, nothing taken.  Empty table: no rows.  Repeated rows are taken as
    so many documents; ties in the order can only be between equal rows.
    Running sums go over buckets of a source, so no source is one task's work.
    """
    return _allotted(docs, plan, doc_id, source, text, keep).sort(F.col("position").asc_nulls_last(), "doc_id")


def _allotted(docs: DataFrame, plan: Curriculum, doc_id: str, source: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("key")
    rows = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.col(doc_id).alias("doc_id"), key, sized(docs, text).alias("size"), _place(doc_id, text).alias("place"),
    ).withColumn("bucket", F.substring("place", 1, 3))
    buckets = (
        docs.select(F.col(source).alias("source"), key, sized(docs, text).alias("size"), F.substring(_place(doc_id, text), 1, 3).alias("bucket"))
        .groupBy("source", "key", "bucket")
        .agg(F.sum("size").alias("words"))
    )
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = buckets.select("key", "bucket", (F.sum("words").over(earlier) - F.col("words")).alias("before"))
    goal = targets(buckets.select("source", "key", F.col("words").alias("size")), plan)
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size"))
        .join(before.join(goal, "key"), ["key", "bucket"])
        .withColumn("ahead", F.col("ahead") + F.col("before"))
        .withColumn("budget", F.floor("target").cast("long"))
    )

    def use(epoch: int) -> Column:
        start = F.col("source_size") * F.lit(epoch) + F.col("ahead")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - start))
        demand = (start + words / F.lit(2.0)) / F.greatest(F.col("target"), F.lit(1.0))
        position = F.lit(None).cast("double")
        for kind, shape in enumerate(plan.shapes):
            position = F.when(F.col("shape") == kind, invert(shape, demand)).otherwise(position)
        return F.struct(
            F.lit(epoch + 1).alias("epoch"),
            words.alias("words"),
            F.when(words > 0, position).alias("position"),
        )

    return counted.withColumn("every", F.array(*[use(e) for e in range(plan.epochs)])).select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        "doc_id", "size", "source_size", "target",
        F.aggregate("every", F.lit(0).cast("long"), lambda n, u: n + u["words"]).alias("taken"),
        F.filter("every", lambda u: u["words"] > 0).alias("uses"),
        F.get("every", F.lit(0))["position"].alias("position"),
    )


def training_rows(docs: DataFrame, plan: Curriculum = Curriculum(), *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: one row of ``docs`` per use, with all its columns, in training order.

    A use that takes only part of a document carries its first words, up to
    where the next one would start.  Documents the mix leaves out are gone.
    """
    kept = tuple(docs.columns)
    mixed = _allotted(docs, plan, doc_id, source, text, kept)
    mixed = mixed.toDF(*[f"c{i}" for i in range(len(kept))], *[f"m_{c}" for c in mixed.columns[len(kept):]])
    used = mixed.select("*", F.explode("m_uses").alias("u"))
    at = kept.index(text)
    words = F.regexp_extract_all(F.col(f"c{at}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("u.words").cast("int")), "")
    body = F.when(F.col("u.words") < F.col("m_size"), part).otherwise(F.col(f"c{at}"))
    columns = [(body if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept)]
    return used.sort("u.position", "m_doc_id").select(*columns)


def _place(doc_id: str, text: str) -> Column:
    """A fixed pseudo-random order of rows; equal only for equal id and text."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest).cast("binary"))
