"""Periodic runs of words: repetitions inside a text, found by descending LCP.

Suffixes of the word sequence are united in the order of decreasing longest
common prefixes (a Kruskal pass with union-find).  Every class keeps its
positions in order; two positions i < j that become neighbours when their
classes meet at prefix length l, with distance d = j - i small against l, show
that the words from i on repeat with period d for exactly d + l words.  The
first and the second period of any run become neighbours in just this way, so
all runs are found, each at its own first word.

A text is one row and is worked on whole in one task; texts without a repeated
window of the least possible prefix, nearly all of them, end after one sort.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


@dataclass(frozen=True)
class Repetition:
    """A run has at least ``least`` words and ``times`` whole periods."""

    times: int = 4
    least: int = 6

    def __post_init__(self):
        if self.times < 2 or self.least < 2:
            raise ValueError("a run has two periods and two words at least")

    def prefix(self) -> int:
        """The least common prefix of the two suffixes that seed a run."""
        return min(max(self.least - d, (self.times - 1) * d) for d in range(1, self.least + 1))


def numbered(words: Sequence) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def find_runs(ids: np.ndarray, rule: Repetition = Repetition()) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a number sequence, by start and period."""
    shortest = rule.prefix()
    if not _repeats(ids, shortest):
        return []
    found: dict[tuple[int, int], int] = {}
    for at, apart, common in _neighbours(ids, shortest, rule.times - 1):
        length = apart + common
        # only the first word of a run counts, and only its smallest period
        if length >= rule.least and (at == 0 or ids[at - 1] != ids[at + apart - 1]):
            found[at, length] = min(apart, found.get((at, length), apart))
    return sorted((at, length, period) for (at, length), period in found.items())


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Whether any ``size`` neighbouring words may stand twice in the text (by hash, never wrongly no)."""
    windows = len(ids) - size + 1
    if windows < 2:
        return False
    mixed = np.zeros(windows, np.uint64)
    words = ids.astype(np.uint64) + np.uint64(1)
    for i in range(size):
        mixed = (mixed + words[i : i + windows]) * _STEP
        mixed ^= mixed >> _SHIFT
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the next, by doubling."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32) + 1]
    while ranks[-1].max() < n:
        rank, step = ranks[-1].astype(np.int64), 1 << (len(ranks) - 1)
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:]
        ranks.append(np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int32) + 1)
    order = np.argsort(ranks[-1], kind="stable")
    one, two = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        inside = np.flatnonzero(np.maximum(one, two) + (1 << level) <= n)
        same = inside[ranks[level][one[inside]] == ranks[level][two[inside]]]
        for part in (one, two, common):
            part[same] += 1 << level
        # positions at the end stay there: nothing is left to compare
        one, two = np.minimum(one, n - 1 + (one >= n)), np.minimum(two, n - 1 + (two >= n))
    return order, common


def _neighbours(ids: np.ndarray, shortest: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(position, distance, common prefix) of newly adjacent positions at most prefix / times apart."""
    order, common = _suffixes(ids)
    edges = np.flatnonzero(common >= shortest)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(of: int) -> int:
        top = of
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[of] != top:
            parent[of], of = top, parent[of]
        return top

    for edge, reach in zip(edges.tolist(), common[edges].tolist()):
        a, b = root(edge), root(edge + 1)
        large, small = (places.pop(r, None) or [int(order[r])] for r in (a, b))
        if len(large) < len(small):
            large, small = small, large
        most = reach // times
        spots = [bisect_left(large, x) for x in small]
        for k, (x, spot) in enumerate(zip(small, spots)):
            if spot and (k == 0 or spots[k - 1] < spot) and x - large[spot - 1] <= most:
                yield large[spot - 1], x - large[spot - 1], reach
            if spot < len(large) and (k + 1 == len(spots) or spots[k + 1] > spot) and large[spot] - x <= most:
                yield x, large[spot] - x, reach
        if 16 * len(small) < len(large):
            for x, spot in zip(reversed(small), reversed(spots)):
                large.insert(spot, x)
        else:
            large = sorted(large + small)
        parent[b] = a
        places[a] = large


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def periodic_runs(texts: DataFrame, rule: Repetition = Repetition(), *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per text: ``keep``, n_words, runs (array of start, length, period), collapsed.

    Words stand between ASCII white space and are numbered from 0.  A run is a
    stretch of words with a smallest period that holds ``rule`` and that no
    neighbouring word extends; runs may overlap.  ``collapsed`` is the text
    without the words behind the first period of a run, joined by one space.
    Null and empty texts have no words, no runs and an empty collapsed text.
    Rows that repeat are worked on each; other columns are not read.
    """
    clash = {"n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"kept columns would be overwritten: {sorted(clash)}")
    rows = texts.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for said in batch.column("said"):
                words = (said.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = find_runs(numbered(words), rule) if words else []
                if found:
                    words_left = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                else:
                    words_left = words
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(words_left).decode("utf-8", "surrogatepass"))
            made = [pa.array(sizes, pa.int64()), pa.array(runs, _RUN), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"]
            )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    made = rows.mapInArrow(run, ", ".join([*fields, f"n_words bigint, runs array<{RUN}>, collapsed string"]))
    return made.toDF(*keep, "n_words", "runs", "collapsed")


def strongest(runs: str = "runs") -> Column:
    """The run of greatest exact length / period; ties: smallest start, then smallest period."""

    def better(best: Column, run: Column) -> Column:
        mine, other = run["length"] * best["period"], best["length"] * run["period"]
        first = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (mine > other) | ((mine == other) & first), run).otherwise(best)

    return F.aggregate(F.col(runs), F.lit(None).cast(RUN), better)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``periodic_runs`` as one row of numbers and digests a text."""
    best = strongest()
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents end in a loop of their own words.

    With h = crc32 of the decimal id and g = floor(h / 10): if h ends in 0 and
    the text has n > 0 words, each word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n == 0, F.lit("")).otherwise(
            F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")
        )

    chosen = (h % 10 == 0) & F.col(text).isNotNull()
    once = F.transform(F.array(words), loop)[0]
    return docs.select(F.col(doc_id).alias("doc_id"), F.when(chosen, once).otherwise(F.col(text)).alias("text"))
