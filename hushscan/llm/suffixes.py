"""Substring dedup by grouping windows at minimiser anchors by hashes.

A radix sort of suffixes, from the most significant digit to the threshold,
would find the repeated windows but shuffle many times the text (some 26 bytes
a byte).  No suffix is ordered here and no digit refined; equal windows meet by
hash instead.

The passes run over anchors: each window of ``threshold`` bytes is represented
by the one of its short byte strings (of ``digit`` bytes) with the least hash,
leftmost first.  That choice depends on the window's bytes alone, so equal windows have
their anchor at the same place, and neighbouring windows share anchors: about
one byte in forty is one.  Equality is that of 64-bit hashes.

Each pass groups runs of neighbouring windows by a string that all windows of
a run contain, drops groups of one, and splits a group into kinds by all the
bytes a run spans.  Runs of one kind are repeats as a whole: all but the first are settled, and
the first goes on only if its group has another kind.

* first pass: runs of windows with one anchor, grouped by the anchor;
* second pass: runs of up to eight windows, grouped by the bytes they share;
* last pass: single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hushscan.llm.common import Scratch

#: windows looked at together; a longer text is cut into blocks of windows
_BLOCK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_LAST_ID = (1 << 63) - 1
#: a text is known by its id and, if the id is null or on several rows, a digest
_KEY = ["doc", "text_id"]
#: a place packs the first window of a run, how many more it has, and how far
#: after the first window its anchor lies
_MORE, _OFFSET = 25, 18
_MOST = 127
#: windows a run has in the passes after the first
_RUNS = (8, 1)


@dataclass(frozen=True)
class Depth:
    """Repeats of at least ``threshold`` bytes."""

    threshold: int = 100

    @property
    def digit(self) -> int:
        """Bytes of an anchor: short, but so long that a run has at most 128 windows."""
        return max(min(16, -(-self.threshold // 2)), self.threshold - _MOST)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at each place, by doubling."""
    hashes, step, factor = _TABLE[data], 1, _STEP
    while 2 * step <= width:
        hashes = hashes[:-step] * np.uint64(factor) + hashes[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    if step < width:
        over = width - step
        hashes = hashes[: len(hashes) - over] * np.uint64(_STEP) + hashes[over:]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values if step == width else np.minimum(values[: len(values) - (width - step)], values[width - step :])


def segments(data: np.ndarray, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window, anchor, anchor hash."""
    found = []
    windows = len(data) - depth.threshold + 1
    for at in range(0, max(windows, 0), _BLOCK):
        part = data[at : at + _BLOCK + depth.threshold - 1]
        hashes = gram_hashes(part, depth.digit)
        keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(keyed, depth.threshold - depth.digit + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        anchor = (least[first] & _PLACE).astype(np.int64)
        found.append((first + at, last + at, anchor + at, hashes[anchor]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 32 | (last - first) << _MORE | (anchor - first) << _OFFSET


_RUN_ROWS = pa.schema([("shared", pa.int64()), ("spanned", pa.int64()), ("doc", pa.int64()), ("text_id", pa.binary()), ("place", pa.int64())])
_RUN_DDL = "shared long, spanned long, doc long, text_id binary, place long"


def _sparse(rows: DataFrame, depth: Depth) -> DataFrame:
    """Runs of windows with one anchor, as (shared, spanned, doc, text_id, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for doc, text_id, text in zip(*(batch.column(c).to_pylist() if c in _KEY else batch.column(c) for c in (*_KEY, "text"))):
                data = (text.as_py() or "").encode("utf-8")
                first, last, anchor, hashed = segments(np.frombuffer(data, np.uint8), depth)
                if not len(first):
                    continue
                shape = ((anchor - first) << 10 | (last - first)).tolist()
                ends = (last + depth.threshold).tolist()
                spanned = [xxhash.xxh3_64_intdigest(data[a:b], s) for a, b, s in zip(first.tolist(), ends, shape)]
                place, text_ids = packed(first, last, anchor), np.repeat(np.array([text_id], object), len(first))
                parts.append((hashed.view(np.int64), np.array(spanned, np.uint64).view(np.int64), np.full(len(first), doc), text_ids, place))
                held += len(first)
                if held >= 100_000:
                    yield _columns(parts)
                    parts, held = [], 0
            if parts:
                yield _columns(parts)

    return rows.mapInArrow(run, _RUN_DDL)


def _columns(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), _RUN_ROWS)], schema=_RUN_ROWS)


def _split(texts: DataFrame, depth: Depth, most: int) -> DataFrame:
    """The runs listed in ``places`` of each text, cut into runs of up to ``most`` windows.

    Cuts lie at fixed distances from the anchor, so equal windows fall into
    runs of equal position; ``shared`` is what a whole run there would share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, digest = depth.threshold, xxhash.xxh3_64_intdigest
        for batch in batches:
            for doc, text_id, text, places in zip(*(batch.column(c) for c in (*_KEY, "text", "places"))):
                data, shared, spanned, out = (text.as_py() or "").encode("utf-8"), [], [], []
                for place in places.as_py():
                    offset = place >> _OFFSET & _MOST
                    anchor = (place >> 32) + offset
                    least = offset - (place >> _MORE & _MOST)
                    while least <= offset:  # distances from window to anchor
                        step = least // most
                        high = min(offset, step * most + most - 1)
                        common = data[anchor - step * most : anchor - (step * most + most - 1) + size]
                        first = anchor - high
                        shared.append(digest(common, step << 1))
                        spanned.append(digest(data[first : anchor - least + size], high << 8 | least | 1 << 20))
                        out.append(first << 32 | (high - least) << _MORE | high << _OFFSET)
                        least = high + 1
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(shared, np.uint64).view(np.int64)), pa.array(np.array(spanned, np.uint64).view(np.int64)),
                         pa.array(np.full(len(out), doc.as_py())), pa.array([text_id.as_py()] * len(out), pa.binary()), pa.array(np.array(out, np.int64))],
                        schema=_RUN_ROWS,
                    )

    return texts.mapInArrow(run, _RUN_DDL)


def _in_groups(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The runs whose group has another member."""
    again = runs.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shared")
    again = scratch.write(again, settle=True)
    kept = scratch.write(runs.join(again, "shared"), settle=True)
    scratch.drop(again)
    return kept


def _settle(runs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(repeats, first runs of groups with several kinds), both (doc, text_id, place)."""
    kinds = runs.groupBy("shared", "spanned").agg(F.min(F.struct(*_KEY, "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = scratch.write(kinds, settle=True)
    later = runs.join(kinds.where("n > 1"), ["shared", "spanned"]).where("struct(doc, text_id, place) <> first").select(*_KEY, "place")
    later = scratch.write(later, settle=True)
    # written, so that the join after it can split a group of very many kinds
    mixed = scratch.write(kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shared"))
    heads = scratch.write(kinds.join(mixed, "shared").select("first.doc", "first.text_id", "first.place"), settle=True)
    scratch.drop(mixed)
    scratch.drop(kinds)
    return later, heads


def repeats(rows: DataFrame, depth: Depth, scratch: Scratch) -> DataFrame:
    """Runs of repeated windows (doc, text_id, place) of rows (doc, text_id, text): all but each string's first place.

    Rows with one key hold one text, and list its places only once.
    """
    runs = _in_groups(_sparse(rows, depth), scratch)
    found, heads = _settle(runs, scratch)
    scratch.drop(runs)
    for most in _RUNS:
        listed = heads.groupBy(*_KEY).agg(F.collect_set("place").alias("places"))
        split = scratch.write(_split(rows.join(listed, _KEY), depth, most), settle=True)
        scratch.drop(heads)
        runs = _in_groups(split, scratch)
        scratch.drop(split)
        later, heads = _settle(runs, scratch)
        scratch.drop(runs)
        found = found.unionByName(later)
    return found


def covered(data: bytes, places: list[int] | None, depth: Depth) -> np.ndarray:
    """Which bytes the runs of windows cover."""
    edges = np.zeros(len(data) + 1, np.int64)
    if places:
        runs = np.array(places, np.int64)
        first = runs >> 32
        np.add.at(edges, first, 1)
        np.add.at(edges, first + (runs >> _MORE & _MOST) + depth.threshold, -1)
    return np.cumsum(edges)[:-1] > 0


def _with_places(docs: DataFrame, depth: Depth, doc_id: str, text: str) -> DataFrame:
    """``docs`` under plain names c0, c1, ... with the list of repeated runs of each row."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    said = F.col(f"c{docs.columns.index(text)}")
    keyed = _keyed(plain, F.col(f"c{docs.columns.index(doc_id)}").cast("long"), said, scratch)
    found = repeats(keyed.select(*_KEY, said.alias("text")), depth, scratch)
    listed = found.groupBy(*_KEY).agg(F.collect_set("place").alias("places"))
    return keyed.join(listed, _KEY, "left").drop(*_KEY)


def _keyed(plain: DataFrame, doc: Column, said: Column, scratch: Scratch) -> DataFrame:
    """``plain`` with a key that is the same for equal ids and texts only.

    The digest is empty where an id stands on one row.  Null ids come last, so
    their digests follow a byte that sorts behind that of other rows.
    """
    ids = plain.select(doc.alias("again")).where("again IS NOT NULL")
    again = scratch.write(ids.groupBy("again").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again"))
    digest = F.unhex(F.sha2(F.coalesce(said, F.lit("")), 256))
    text_id = F.when(F.col("doc").isNull(), F.concat(F.expr("X'01'"), digest))
    text_id = text_id.when(F.col("again").isNotNull(), F.concat(F.expr("X'00'"), digest)).otherwise(F.expr("X''"))
    told = plain.withColumn("doc", doc).join(again, F.col("doc") == F.col("again"), "left")
    return told.withColumn("text_id", text_id).withColumn("doc", F.coalesce("doc", F.lit(_LAST_ID))).drop("again")


def duplicate_bytes(docs: DataFrame, depth: Depth = Depth(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text is removed if a string of ``threshold`` bytes
    covers it that also starts earlier: in a smaller id, or earlier in the
    same text.  Strings are judged on the input and never cross documents.
    Null text counts as empty; texts shorter than the threshold stay whole.
    Null ids come last.  Rows that repeat an id and a text are one document;
    rows that repeat an id with another text come in a fixed order.  Other
    columns are not read.
    """
    marked = _with_places(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), depth, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for text, places in zip(batch.column("c1"), batch.column("places")):
                data = (text.as_py() or "").encode("utf-8")
                gone = covered(data, places.as_py(), depth)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("c0")]
                + [pa.array([o[i] for o in out], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string()])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, depth: Depth = Depth(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all rows and columns stay.

    Only whole characters go: one that is removed in part stays.
    """
    marked = _with_places(docs, depth, doc_id, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for said, places in zip(batch.column(f"c{at}"), batch.column("places")):
                said, places = said.as_py(), places.as_py()
                texts.append(cut(said, covered(said.encode("utf-8"), places, depth)) if said and places else said)
            columns = [batch.column(f"c{i}") for i in range(len(docs_columns))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(docs_columns))])

    docs_columns = list(docs.columns)
    schema = ", ".join(f"c{i} {marked.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(docs_columns)))
    return marked.mapInArrow(run, schema).toDF(*docs_columns)


def cut(text: str, gone: np.ndarray) -> str:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    stays = np.maximum.reduceat(~gone, starts) if len(starts) else ~gone
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    return data[np.repeat(stays, sizes)].tobytes().decode("utf-8")
