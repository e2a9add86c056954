"""Ignore lists of any length: patterns are rows, and paths meet them in one equi-join.

Every pattern has one key that all its matches share: the whole pattern where it
has no wildcard, else its longest piece of plain text, which stands at the
front, at the end or inside.  A path offers its pieces of the lengths that occur
as keys, so the plan is the same for two patterns and for a million.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hushscan.functions.paths import base_name, glob_to_regex
from hushscan.operators.cluster import broadcast_if_small, materialise
from hushscan.operators.search import gram_filter, passes

#: keys inside a path are no longer than this
INNER = 12
_WILD = re.compile(r"(?s)\*|\?|\[(?:!.|[^!])[^\]]*\]")
_INDEX = "how string, key string, regex string"


def index_row(pattern: str) -> tuple[str, str, str | None]:
    """(how, key, regex) of a glob; no regex where the key alone decides."""
    wild = _WILD.findall(pattern)
    if not wild:
        return "whole", pattern, None
    head, *inner, tail = _WILD.split(pattern)
    if wild == ["*"] and not (head and tail):
        if head:
            return "head", head, None
        if tail:
            return "tail", tail, None
    regex = glob_to_regex(pattern)
    middle = max(inner, key=len, default="")[:INNER]
    if max(len(head), len(tail)) >= len(middle):
        if len(head) > len(tail):
            return "head", head, regex
        return ("tail", tail, regex) if tail else ("any", "", regex)
    return "inner", middle, regex


def index_patterns(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Distinct rows (how, key, regex) of an ignore list; null and empty patterns match nothing."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index_row(p) for p in batch.column("p").to_pylist()]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["how", "key", "regex"])

    given = patterns.select(F.col(column).alias("p")).where("p <> ''").distinct()
    return given.mapInArrow(parse, _INDEX)


def _pieces(how: str, starts: Column, lengths: list[int]) -> Column:
    """(how, key) of the pieces of a path of the given lengths."""
    path, base, sizes = F.col("path"), F.col("base"), F.array(*map(F.lit, lengths)).cast("array<int>")

    def cut(text: Column, at) -> Column:
        fitting = F.filter(sizes, lambda n: n <= F.length(text))
        return F.transform(fitting, lambda n: F.substring(text, at(text, n), n))

    if how == "head":
        keys = F.concat(cut(path, lambda t, n: F.lit(1)), cut(base, lambda t, n: F.lit(1)))
    elif how == "tail":
        # the end of the last part is the end of the path
        keys = cut(path, lambda t, n: F.length(t) - n + 1)
    else:
        keys = F.flatten(F.transform(starts, lambda at: F.transform(
            F.filter(sizes, lambda n: n <= F.length(path) - at + 1), lambda n: F.substring(path, at, n)
        )))
    return F.transform(F.array_distinct(keys), lambda key: F.struct(F.lit(how).alias("how"), key.alias("key")))


def _known_keys(rows: DataFrame, offers: Column, keyed: DataFrame) -> DataFrame:
    """(path, base, hash): the pieces of each path that may be a key, by a Bloom filter of all keys."""
    bitmap, _ = gram_filter(keyed.select(F.lit(0).alias("tier"), F.xxhash64("how", "key").alias("gram")))
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            hashes = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ok = passes(shared.value, hashes)
            owner = pa.array(owner[ok])
            yield pa.RecordBatch.from_arrays(
                [batch.column("path").take(owner), batch.column("base").take(owner), pa.array(hashes[ok])],
                names=["path", "base", "hash"],
            )

    hashes = F.transform(offers, lambda o: F.xxhash64(o["how"], o["key"])).alias("hashes")
    return rows.select("path", "base", hashes).mapInArrow(kept, "path string, base string, hash bigint")


def _has_key() -> Column:
    """The path has the key where its pattern says."""
    path, base, key, how = F.col("path"), F.col("base"), F.col("key"), F.col("how")
    return (
        F.when(how == "whole", (path == key) | (base == key))
        .when(how == "head", F.startswith(path, key) | F.startswith(base, key))
        .when(how == "tail", F.endswith(path, key))
        .otherwise(F.contains(path, key))
    )


def matched_paths(paths: DataFrame, patterns: DataFrame, path: str = "path", column: str = "pattern") -> DataFrame:
    """The distinct paths that a pattern matches, whole or by their last part.

    The driver gets the distinct lengths of keys that fit a path (no more than
    the longest path has characters) and a Bloom filter of the keys, 64 MB at
    most; patterns and paths stay rows, and only pieces that pass the filter
    leave the scan.  They meet the keys by hash, which the key itself confirms.
    The index is broadcast only after it was measured; where it is not, a key that very
    many paths offer is split by adaptive execution, since it is one key of few
    patterns.  Patterns without any plain text have nothing to be looked up by
    and are tried on each path, as one array.
    """
    index = materialise(index_patterns(patterns, column))
    wanted = materialise(paths.select(F.col(path).alias("path")).where("path is not null").distinct())
    longest = wanted.agg(F.max(F.length("path"))).first()[0] or 0
    keyed = index.where("how <> 'any'")
    fitting = keyed.where(F.length("key") <= longest)
    lengths: dict[str, list[int]] = {}
    for how, n in fitting.select("how", F.length("key")).distinct().collect():
        lengths.setdefault(how, []).append(n)
    starts = F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))
    rows = wanted.select("path", base_name(F.col("path")).alias("base"))
    whole = F.array_distinct(F.array("path", "base"))
    offers = [F.transform(whole, lambda key: F.struct(F.lit("whole").alias("how"), key.alias("key")))]
    offers += [_pieces(how, starts, sorted(lengths[how])) for how in ("head", "tail", "inner") if how in lengths]
    # explode_outer, since the optimizer copies the expression into a filter below a plain explode
    offered = _known_keys(rows, F.concat(*offers), fitting)
    keys = fitting.withColumn("hash", F.xxhash64("how", "key"))
    met = offered.join(broadcast_if_small(keys, "how", "key", "regex"), "hash")
    verified = F.col("regex").isNull() | F.rlike("path", F.col("regex")) | F.rlike("base", F.col("regex"))
    by_key = met.where(_has_key() & verified).select("path")
    loose = index.where("how = 'any'").agg(F.collect_list("regex").alias("loose"))
    tried = rows.join(F.broadcast(loose)).where(
        F.exists("loose", lambda regex: F.rlike(F.col("path"), regex) | F.rlike(F.col("base"), regex))
    )
    return by_key.unionByName(tried.select("path")).distinct()


def without_matched(paths: DataFrame, patterns: DataFrame, path: str = "path", column: str = "pattern") -> DataFrame:
    """The rows of ``paths`` that no pattern matches; a null path is matched by none."""
    gone = matched_paths(paths, patterns, path, column).select(F.col("path").alias("_gone"))
    return paths.join(gone, F.col(path) == F.col("_gone"), "left_anti")
