"""Near-duplicate documents by min-max hashing.

A signature keeps both the least and the greatest value of a shingle set under
each permutation, so one hash evaluation gives two of its entries.  Entries
are banded; documents that agree in a band are candidates, and links are
confirmed on the full sets.

No band bucket is ever multiplied out.  Each bucket has a pivot, the member
that shares most buckets with others (the original, among edited copies), and
every member is compared with it.  Two members that link with their pivot are
joined through it.  For a member x that does not, write r for what it lacks of
the pivot's set P and a for what it adds.  x and y then link only if they share
c of these differences with

    (den + num) c >= (num a_x + den r_x) + (num a_y + den r_y) - (den - num) |P|

for a threshold num/den, and the right side is positive.  Differences that no
other member has cannot be shared, which rules out nearly all such members by
counting; the rest meet in an equi-join on the rarest of the differences, of which
they have to share one, and are then counted exactly.

Members less than half similar to their pivot have too many differences for
that.  They, and those members near it that may link with one of them, go on
with a pivot of their own in each bucket, round after round while the rounds
at least halve what is left.  What then remains meets in an equi-join on the
rarest shingles of the whole sets.  No member is dropped in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hushscan.llm.common import Scratch, components
from hushscan.llm.shingles import set_id, shingle_set

_MISSED = 1e-5


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; linked when den * common >= num * united."""

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 24
    seed: int = 7

    @property
    def rows(self) -> int:
        """Entries per band: as many as still miss a pair at the threshold less than once in 100,000."""
        t, rows = self.num / self.den, 1
        while (1 - t ** (rows + 1)) ** self.bands <= _MISSED:
            rows += 1
        return rows

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        n = -(-self.bands // 2) * self.rows
        return random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, np.uint64)


def signature(hashes: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of a set under each permutation of 64-bit numbers."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(hashes), 2048):
        values = hashes[at : at + 2048, None] * multipliers + offsets
        values ^= values >> np.uint64(29)
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int, rows: int) -> list[int]:
    """Even bands take least values, odd ones greatest values, of the same permutations."""
    keys = []
    for band in range(bands):
        part = (high if band & 1 else low)[band // 2 * rows : (band // 2 + 1) * rows]
        keys.append(xxhash.xxh3_64_intdigest(part.tobytes(), seed=band) - (1 << 63))
    return keys


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when their shingle sets are similar enough; null, empty and
    blank texts have no set and link with nothing.  ``component_id`` is the
    smallest id reachable by links.  Documents with equal sets are one class
    and are compared once.  Rows with a null id link with nothing and are kept
    (component null); rows that repeat an id are one document where that id
    is the smallest of a class.  Other columns are not read.
    """
    return _labelled(docs, similarity, doc_id, text).drop("digest")


def _labelled(docs: DataFrame, similarity: Similarity, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with the digest of each row's text."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.write(_signed(rows, similarity))
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    links = _links(rows, linkable, similarity, scratch)
    labels = components(links, scratch)
    named = classes.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    named = scratch.write(named)  # so that the join below can split a set with many copies
    joined = linkable.join(named, "set_id").select("doc_id", "n_shingles", "component_id", "digest")
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").selectExpr("doc_id", "n_shingles", "doc_id AS component_id", "digest")
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _signed(rows: DataFrame, similarity: Similarity) -> DataFrame:
    multipliers, offsets = similarity.permutations()
    size, bands, depth = similarity.words, similarity.bands, similarity.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), size) for t in batch.column("text"))
            found = [(len(s), set_id(s), band_keys(*signature(s, multipliers, offsets), bands, depth) if len(s) else []) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_shingles", "set_id", "bands"],
            )

    return rows.withColumn("digest", F.md5("text")).mapInArrow(run, "doc_id long, digest string, n_shingles long, set_id binary, bands array<long>")


def _links(rows: DataFrame, linkable: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between classes, by their smallest ids, that connect all that links connect."""
    first = linkable.groupBy("set_id").agg(F.min(F.struct("doc_id", "bands")).alias("f"))
    banded = first.select(F.col("f.doc_id").alias("node"), "set_id", F.explode("f.bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    texts = rows.where("text IS NOT NULL")
    buckets, found = scratch.write(banded.join(shared, "band")), []
    while True:
        links, left = _round(buckets, texts, similarity, scratch)
        before, after = buckets.count(), left.count()
        scratch.drop(buckets)
        buckets = left
        found.append(links)
        if 2 * after > before or not after:
            break
    if after:
        found.append(_on_rarest(buckets, texts, similarity, scratch))
    return reduce(DataFrame.unionByName, found)


def _round(buckets: DataFrame, texts: DataFrame, similarity: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links through and beside one pivot a bucket, and the buckets of those that may have others."""
    weight = buckets.groupBy("node", "set_id").agg(F.sum("members").alias("weight"))
    pivots = (
        buckets.join(weight, ["node", "set_id"])
        .groupBy("band")
        .agg(F.max(F.struct("weight", (-F.col("node")).alias("n"), "set_id")).alias("p"))
        .select("band", (-F.col("p.n")).alias("pivot"), F.col("p.set_id").alias("pivot_set"))
    )
    dealt = buckets.join(pivots, "band").where("set_id <> pivot_set").select("band", "node", "set_id", "pivot", "pivot_set")
    pairs = dealt.select("node", "set_id", "pivot", "pivot_set").distinct()
    seen = scratch.write(_compared(_with_texts(pairs, texts), similarity))
    through = seen.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = through.unionByName(_beside_pivots(seen.where("near"), similarity, scratch))
    going = seen.where("open").select("node", "set_id", "pivot", "pivot_set", "near").distinct()
    going = scratch.write(dealt.join(going, ["node", "set_id", "pivot", "pivot_set"]).select("band", "node", "set_id", "near"))
    sizes = going.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.every("near").alias("all_near"))
    left = scratch.write(going.drop("near").join(sizes.where("members > 1 AND NOT all_near").drop("all_near"), "band"))
    scratch.drop(going)
    return links, left


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return (
        pairs.join(texts.withColumnRenamed("doc_id", "node"), "node")
        .join(texts.toDF("pivot", "pivot_text"), "pivot")
        .select("node", "set_id", "text", "pivot", "pivot_set", "pivot_text")
    )


def _on_rarest(buckets: DataFrame, texts: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """All links between the members of ``buckets``, compared if they share one of their rarest shingles."""
    words, num, den = similarity.words, similarity.num, similarity.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own, text in zip(*(batch.column(c) for c in range(3))):
                hashes = shingle_set(text.as_py(), words)
                if set_id(hashes) != own.as_py():
                    continue  # another row that repeats the id
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node.as_py()], pa.int64()), pa.array([own.as_py()], pa.binary()),
                     pa.array([len(hashes)], pa.int64()), pa.array([hashes.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["node", "set_id", "size", "elements"],
                )

    members = buckets.select("node", "set_id").distinct().join(texts.withColumnRenamed("doc_id", "node"), "node")
    sets = members.select("node", "set_id", "text").mapInArrow(run, "node long, set_id binary, size long, elements array<long>")
    elements = scratch.write(sets.dropDuplicates(["set_id"]).select("node", "set_id", "size", F.explode("elements").alias("e")))
    common = elements.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("set_id")
    kept = elements.join(common, "e").withColumn("shareable", F.count(F.lit(1)).over(own))
    # a link shares at least this many shingles, so one of the rarest that stay when all but one of them are set aside
    least = F.ceil(F.col("size") * num / den)
    first = kept.withColumn("at", F.row_number().over(own.orderBy("n", "e"))).where(F.col("at") <= F.col("shareable") - least + 1)
    first = scratch.write(first.select("e", "node", "set_id", "size"))
    scratch.drop(elements)
    x = first.toDF("e", "node", "set_id", "size")
    y = first.toDF("e", "pivot", "pivot_set", "other")
    alike = F.least("size", "other") * den >= F.greatest("size", "other") * num
    met = x.join(y, "e").where(alike & (F.col("set_id") < F.col("pivot_set"))).select("node", "set_id", "pivot", "pivot_set").distinct()
    seen = _compared(_with_texts(met, texts), similarity)
    return scratch.write(seen.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))


_SEEN = "node long, pivot long, set_id binary, pivot_set binary, linked boolean, near boolean, open boolean, size long, added long, lost long, differences array<long>"


def _compared(pairs: DataFrame, similarity: Similarity) -> DataFrame:
    """Exact comparisons of members with pivots.

    Pairs at least half similar are ``near`` and carry their differences.
    What is not near is ``open``, and so is a member that may link with such
    a one: Jaccard distance is a metric, so its similarity is below 1.5 less
    the threshold.
    """
    words, num, den = similarity.words, similarity.num, similarity.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_hashes, pivot_id = None, None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                node, own, text, at, other, other_text = (batch.column(c)[i].as_py() for c in range(6))
                if (at, other_text) != pivot:
                    pivot, pivot_hashes = (at, other_text), shingle_set(other_text, words)
                    pivot_id = set_id(pivot_hashes)
                hashes = shingle_set(text, words)
                if pivot_id != other or set_id(hashes) != own:
                    continue  # another row that repeats the id
                common = len(np.intersect1d(hashes, pivot_hashes, assume_unique=True))
                united = len(hashes) + len(pivot_hashes) - common
                near = 2 * common >= united
                differ = np.setxor1d(hashes, pivot_hashes, assume_unique=True).astype(np.int64) if near else []
                out.append((node, at, own, other, den * common >= num * united, near,
                            not near or 2 * den * common < (3 * den - 2 * num) * united, len(pivot_hashes),
                            len(hashes) - common, len(pivot_hashes) - common, differ))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = [f.split()[0] for f in _SEEN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return pairs.mapInArrow(run, _SEEN)


def _beside_pivots(seen: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """Links of members that their pivot does not link, with other members of the pivot."""
    num, den = similarity.num, similarity.den
    group = ["pivot", "pivot_set"]
    apart = seen.where("NOT linked").select(*group).distinct()
    cost = (F.col("added") * num + F.col("lost") * den).alias("cost")
    members = seen.join(apart, group, "left_semi").select(*group, "node", "set_id", "linked", "size", cost, "differences")
    elements = members.select(*group, "node", "set_id", "linked", "size", "cost", F.explode("differences").alias("e"))
    common = elements.groupBy(*group, "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = scratch.write(elements.join(common, [*group, "e"]))
    share, slack = num + den, F.col("size") * (den - num)
    able = kept.groupBy(*group, "node", "set_id", "linked", "size", "cost").agg(F.count(F.lit(1)).alias("shareable"))
    # the least number of differences a member has to share with any other to link with it
    least = F.when(F.col("linked"), F.floor(F.col("cost") / share) + 1).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("cost") - slack) / share))
    )
    able = able.withColumn("least", least).where("shareable >= least")
    sides = kept.join(able.select(*group, "node", "set_id", "shareable", "least"), [*group, "node", "set_id"])
    # who shares that many shares one of the rarest, left when all but one of them are set aside
    rarest = F.row_number().over(Window.partitionBy(*group, "node", "set_id").orderBy("n", "e"))
    first = scratch.write(sides.withColumn("at", rarest).where("at <= shareable - least + 1"))
    x = first.where("NOT linked").select(*group, "e", F.col("node").alias("a"), F.col("set_id").alias("set_a"), F.col("cost").alias("cost_a"), F.col("shareable").alias("can_a"), "size")
    y = first.select(*group, "e", F.col("node").alias("b"), F.col("set_id").alias("set_b"), F.col("cost").alias("cost_b"), F.col("shareable").alias("can_b"), "linked")
    needed = F.col("cost_a") + F.col("cost_b") - slack
    met = x.join(y, [*group, "e"]).where(
        ((F.col("set_a") < F.col("set_b")) | (F.col("linked") & (F.col("set_a") != F.col("set_b"))))
        & (F.least("can_a", "can_b") * share >= needed)
    )
    met = met.select(*group, "a", "b", "set_a", "set_b", needed.alias("needed")).distinct()
    whole = kept.groupBy(*group, "set_id").agg(F.collect_set("e").alias("all"))
    ones = whole.select(*group, F.col("set_id").alias("set_a"), F.col("all").alias("all_a"))
    others = whole.select(*group, F.col("set_id").alias("set_b"), F.col("all").alias("all_b"))
    checked = met.join(ones, [*group, "set_a"]).join(others, [*group, "set_b"])
    return checked.where(F.size(F.array_intersect("all_a", "all_b")) * share >= F.col("needed")).select("a", "b")


def deduplicate(docs: DataFrame, similarity: Similarity = Similarity(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the first of their component; all columns stay.

    Rows of one id are told apart by their text: one that is a copy of an
    earlier document goes, another text of the same id stays.  See
    ``near_duplicates`` for null, empty and repeated rows.
    """
    gone = _labelled(docs, similarity, doc_id, text).where("NOT kept").select("doc_id", "digest").distinct()
    same = (docs[doc_id].cast("long") == gone["doc_id"]) & (F.md5(docs[text]) == gone["digest"])
    return docs.join(gone, same, "left_anti")
