"""Document fingerprints: SimHash over weighted word terms, and who is near whom.

The terms of a text are its words and pairs of neighbouring words.  Every
distinct term votes with a weight that grows with the logarithm of its count,
for or against each of 128 bits; the sign of the sum is the bit.  Fingerprints
within a Hamming radius are found in permuted block tables: the bits are cut
into blocks, every table moves some blocks to the front as its key, and two
fingerprints that differ in at most ``radius`` bits agree on the key of at
least one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hushscan.llm.common import Memo, Scratch
from hushscan.operators.cluster import broadcast_if_small

BITS = 128
#: fingerprints of one cell that are compared as a matrix (32 MB of differences)
TILE = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_VOTERS = 8192
_PRINT = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])
_hashes = Memo(xxhash.xxh3_64_intdigest)


@dataclass(frozen=True)
class Near:
    """Fingerprints within ``radius`` bits; ``blocks`` (at least radius + 1) sets the tables.

    There is a table for every choice of blocks - radius blocks.  More blocks
    make longer keys, so smaller buckets, but more tables.
    """

    radius: int = 3
    blocks: int = 4

    def __post_init__(self):
        if not 0 <= self.radius < self.blocks <= BITS:
            raise ValueError("0 <= radius < blocks <= 128")

    def masks(self) -> np.ndarray:
        """(tables, 2) words: the bits each table's key is made of."""
        edges = [round(i * BITS / self.blocks) for i in range(self.blocks + 1)]
        out = []
        for chosen in combinations(range(self.blocks), self.blocks - self.radius):
            bits = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
            out.append((bits >> 64, bits & (1 << 64) - 1))
        return np.array(out, np.uint64)


# --- fingerprints -----------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _STEP
    x ^= x >> _SHIFT
    x *= _MIX
    return x ^ (x >> _SHIFT)


def print_of(text: str | None) -> tuple[int, int]:
    """The fingerprint of one text as two signed words; zero without any word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0, 0
    single = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    terms = np.concatenate((single, _mixed(single[:-1] * _STEP + single[1:])))
    terms.sort()
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    counts = np.diff(first, append=len(terms))
    # whole numbers, so that sums do not depend on their order
    weights = np.rint(16 + 16 * np.log2(counts)).astype(np.float32)
    codes = np.empty((len(first), 2), np.uint64)
    codes[:, 0] = _mixed(terms[first])
    codes[:, 1] = _mixed(terms[first] ^ _OTHER)
    votes = np.zeros(BITS)
    for at in range(0, len(first), _VOTERS):
        bits = np.unpackbits(codes[at : at + _VOTERS].view(np.uint8), axis=1)
        votes += weights[at : at + _VOTERS] @ bits.astype(np.float32)
    words = np.packbits(votes * 2 > weights.sum(dtype=np.float64)).view(">i8")
    return int(words[0]), int(words[1])


def _as_column(prints: list[tuple[int, int]]) -> pa.Array:
    pairs = np.array(prints, np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(_PRINT))


def fingerprints(texts: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row with the fingerprint of its text, struct<hi:bigint,lo:bigint>, as column ``name``.

    A column of that name is replaced.  Null and empty texts, and texts of
    white space, have the fingerprint 0; equal texts have equal fingerprints
    everywhere, whatever the order and number of rows.
    """
    rows = texts.drop(name) if name != text else texts.withColumnRenamed(text, f"{text}_")
    at = rows.columns.index(text if name != text else f"{text}_")
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _as_column([print_of(t.as_py()) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "print"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]
    out = plain.mapInArrow(run, ", ".join([*fields, "print struct<hi:bigint,lo:bigint>"])).toDF(*rows.columns, name)
    return out if name != text else out.drop(f"{text}_")


def as_hex(fingerprint: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    word = lambda part: F.lower(F.lpad(F.hex(F.col(fingerprint)[part]), 16, "0"))
    return F.concat(word("hi"), word("lo"))


def likeness(a: str, b: str) -> Column:
    """The share of equal bits of two fingerprint columns."""
    differ = lambda part: F.bit_count(F.col(a)[part].bitwiseXOR(F.col(b)[part]))
    return F.lit(1.0) - (differ("hi") + differ("lo")) / F.lit(float(BITS))


# --- near fingerprints -------------------------------------------------------------


def near_counts(classes: DataFrame, near: Near = Near()) -> DataFrame:
    """(hi, lo, size) of distinct fingerprints -> (hi, lo, others): rows of other fingerprints within the radius.

    Exact.  Only buckets of two or more leave the tables; a bucket of more
    than ``TILE`` fingerprints is cut into tiles by a hash, and every pair of
    tiles is a task of its own.  A pair that shares several buckets counts in
    the first of its tables.  Fingerprints with nothing near are not in the result.
    """
    masks = [[int(w) for w in row] for row in near.masks().view(np.int64)]
    keyed = lambda m: F.struct(
        F.col("hi").bitwiseAND(F.lit(m[0])).alias("a"), F.col("lo").bitwiseAND(F.lit(m[1])).alias("b")
    )
    buckets = classes.select("hi", "lo", "size", F.posexplode(F.array(*map(keyed, masks))).alias("at", "key"))
    buckets = buckets.select("hi", "lo", "size", "at", "key.a", "key.b")
    shared = buckets.groupBy("at", "a", "b").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("members") / TILE)).cast("int")
    dealt = buckets.join(shared, ["at", "a", "b"]).select(
        "hi", "lo", "size", "at", "a", "b", tiles.alias("tiles"), F.pmod(F.xxhash64("hi", "lo"), tiles).cast("int").alias("own")
    )
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "hi", "lo", "size", "at", "a", "b", "own",
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
    )
    cell = ["at", "a", "b", "low", "high"]
    found = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        _compare(near), "hi bigint, lo bigint, others bigint"
    )
    return found.groupBy("hi", "lo").agg(F.sum("others").alias("others"))


def _compare(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = near.masks()
        waiting = None
        for batch in batches:
            now = np.column_stack([batch.column(n).to_numpy() for n in ("at", "a", "b", "low", "high", "own", "hi", "lo", "size")])
            if waiting is not None:
                now = np.concatenate((waiting, now))
            if not len(now):
                continue
            ends = np.flatnonzero((now[1:, :5] != now[:-1, :5]).any(axis=1)) + 1
            # the last cell may go on in the next batch
            parts = np.split(now, ends)
            waiting = parts.pop()
            yield from _counted(parts, masks, near.radius)
        if waiting is not None:
            yield from _counted([waiting], masks, near.radius)

    return run


def _counted(cells: list[np.ndarray], masks: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    out = [found for rows in cells if (found := _links(rows, masks, radius)) is not None]
    if out:
        rows = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["hi", "lo", "others"])


def _links(rows: np.ndarray, masks: np.ndarray, radius: int) -> np.ndarray | None:
    """One cell: two tiles against each other, or a tile against itself."""
    at, low, high, own = rows[0, 0], rows[0, 3], rows[0, 4], rows[:, 5]
    one, two = (rows, rows) if low == high else (rows[own == low], rows[own == high])
    a, b = one[:, 6:8].view(np.uint64), two[:, 6:8].view(np.uint64)
    far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    i, j = np.nonzero(far <= radius)
    differ = a[i] ^ b[j]
    wanted = (differ != 0).any(axis=1)
    for earlier in masks[:at]:
        wanted &= (differ & earlier != 0).any(axis=1)
    i, j = i[wanted], j[wanted]
    if not len(i):
        return None
    out = []
    # a tile against itself already holds every pair in both orders
    for mine, theirs, p, q in ((one, two, i, j), (two, one, j, i))[: 1 if low == high else 2]:
        counts = np.zeros(len(mine), np.int64)
        np.add.at(counts, p, theirs[q, 8])
        linked = counts > 0
        out.append(np.column_stack((mine[linked, 6:8], counts[linked])))
    return np.concatenate(out)


def with_near(rows: DataFrame, near: Near = Near(), *, fingerprint: str = "fingerprint", doc_id: str = "doc_id") -> DataFrame:
    """Rows with ``class_id`` and ``n_near``.

    The class is the smallest id with the same fingerprint; ``n_near`` counts
    all other rows within the radius, those of the class included.  Columns
    of these names are replaced.  ``rows`` is read twice, so it should be a table.
    """
    print_ = F.col(fingerprint)
    classes = rows.groupBy(print_["hi"].alias("hi"), print_["lo"].alias("lo")).agg(
        F.count(F.lit(1)).alias("size"), F.min(doc_id).alias("class_id")
    )
    scratch = Scratch(rows.sparkSession)
    classes = scratch.write(classes)
    others = near_counts(classes.select("hi", "lo", "size"), near)
    side = scratch.write(classes.join(others, ["hi", "lo"], "left").select(
        F.struct("hi", "lo").alias("_print"), "class_id",
        (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"),
    ))
    scratch.drop(classes)
    plain = rows.drop("class_id", "n_near")
    joined = plain.join(broadcast_if_small(side), F.col(fingerprint) == F.col("_print"))
    return joined.drop("_print")


# --- edited documents -----------------------------------------------------------------

_EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint struct<hi:bigint,lo:bigint>, "
    "edited struct<hi:bigint,lo:bigint>, following struct<hi:bigint,lo:bigint>"
)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_prints(docs: DataFrame, buckets: int = 0, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and of the document that follows it.

    Documents follow each other by descending id, a null id counting as the
    smallest number; rows of one id follow by a hash of their text.  After the
    last comes the first.  One shuffle brings neighbours together: ids are cut
    into ``buckets`` ranges (default: twice the shuffle partitions) at their
    quantiles, an id that fills several ranges is cut by the hash, and the
    first row of a range travels to the range before as well.  Rows that agree
    in id and text share a range.  Each task walks over its texts, holding two.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds, repeated = _bounds(rows.select(place.alias("place")), buckets)
    tie = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    rows = rows.withColumns({"place": place, "tie": tie}).withColumn("bucket", _bucket(bounds))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("place", "tie")).alias("head")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], _EDITED)
    before = [heads[(i + 1) % len(heads)].bucket for i in range(len(heads))]
    known = spark.createDataFrame(
        [(h.bucket, h.head.place, h.head.tie, to) for h, to in zip(heads, before)],
        "bucket int, head_place bigint, head_tie bigint, before int",
    )
    is_head = (F.col("place") == F.col("head_place")) & (F.col("tie") == F.col("head_tie"))
    stay, go = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    sent = rows.join(F.broadcast(known), "bucket").withColumn(
        "to", F.explode(F.when(is_head, F.array(stay, go)).otherwise(F.array(stay)))
    )
    sent = sent.select("to.bucket", "to.guest", "place", "doc_id", "text").repartition("bucket")
    in_order = sent.sortWithinPartitions("bucket", "guest", F.col("place").desc(), F.xxhash64("text").desc())
    return in_order.select("bucket", "guest", "doc_id", "text").mapInArrow(_walk, _EDITED)


def _bounds(places: DataFrame, buckets: int) -> tuple[list[tuple[int, int]], bool]:
    """Lower ends (place, tie) of all ranges but the first, and whether a place fills several."""
    shares = [i / buckets for i in range(1, buckets)]
    found = places.agg(F.percentile_approx("place", shares, 20 * buckets)).first()[0] if shares else None
    out, repeated = [], False
    for place in sorted(set(found or ())):
        times = found.count(place)
        out.append((place, -(1 << 63)))
        if times > 1:
            repeated = True
            out += [(place, -(1 << 63) + (i << 64) // times) for i in range(1, times)]
            if place < (1 << 63) - 1:
                out.append((place + 1, -(1 << 63)))
    return sorted(set(out)), repeated


def _bucket(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds a row's (place, tie) has reached, by bisection."""
    if not bounds:
        return F.lit(0)
    places, ties = F.lit([b[0] for b in bounds]).cast("array<bigint>"), F.lit([b[1] for b in bounds]).cast("array<bigint>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def reached(at: Column, step: Column) -> Column:
        place, tie = F.get(places, at + step - 1), F.get(ties, at + step - 1)
        past = (place < F.col("place")) | ((place == F.col("place")) & (tie <= F.col("tie")))
        return at + F.when((at + step <= len(bounds)) & past, step).otherwise(0)

    return F.aggregate(F.lit(steps), F.lit(0), reached)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, out = None, []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n) for n in ("bucket", "guest", "doc_id", "text")))

    for bucket, guest, doc_id, text in rows():
        bucket, guest, doc_id, text = bucket.as_py(), guest.as_py(), doc_id.as_py(), text.as_py()
        mine = print_of(text)
        if last is not None and last[0] == bucket and not last[1]:
            _, _, of, said, print_ = last
            changed = edit(said, text)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((of, len(said), digest, print_, print_of(changed), mine))
        last = (bucket, guest, doc_id, text, mine)
        if len(out) >= 2048:
            yield _edited_batch(out)
            out = []
    if out:
        yield _edited_batch(out)


def _edited_batch(out: list[tuple]) -> pa.RecordBatch:
    of, size, digest, *prints = zip(*out)
    columns = [pa.array(of, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), *map(_as_column, prints)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited", "following"])


def documents_near(docs: DataFrame, near: Near = Near(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprints, likeness to its edited text and to the next document, class and near rows.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, class_id, n_near; see ``edited_prints`` for the
    order of documents and ``with_near`` for the last two.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(edited_prints(docs, doc_id=doc_id, text=text))
    return with_near(prints, near).select(
        "doc_id", "n_chars", "edited_sha256",
        as_hex("fingerprint").alias("fingerprint"), as_hex("edited").alias("edited_fingerprint"),
        likeness("fingerprint", "edited").alias("near_edited"), likeness("fingerprint", "following").alias("near_next"),
        "class_id", "n_near",
    )
