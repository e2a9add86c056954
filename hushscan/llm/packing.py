"""Token ids packed into fixed-width rows by best-fit decreasing.

Each scan task tokenises its texts and packs them in buffers of a bounded
number of tokens, so nothing is shuffled.  Documents longer than a row are cut
into full rows and a rest.  Of the rows with room for the next longest piece,
the fullest is taken; a segment tree over the room left finds it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: the tokenizer file is a parameter; this is where the box has one
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACKED = (
    "shard int, buffer int, row int, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<bigint>, doc_starts array<int>"
)


@dataclass(frozen=True)
class Layout:
    """``width`` ids a row; ``end_id`` closes each document, ``pad_id`` fills rows.

    ``buffer_tokens`` bounds what a task packs together.  Ids and positions
    are little-endian integers of ``kind``.
    """

    width: int = 2048
    end_id: int | None = 50256
    pad_id: int = 0
    buffer_tokens: int = 4_000_000
    kind: str = "<u2"


class Tokeniser:
    """A rank-file tokenizer; whole texts go through it in one call."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.coding.encode_to_numpy(text, disallowed_special=())


class Room:
    """Rows by the room they have left: a segment tree over 0..width."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``, and that room."""
        count, node = self.count, least + self.size
        if not count[node]:
            while node & 1 or not count[node + 1]:  # up to a subtree on the right that has a row
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return row, room


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; pieces by falling length, ties by number."""
    room, rows = Room(width), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[piece])
        row, left = found or (len(rows), width)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if left > lengths[piece]:
            room.put(left - lengths[piece], row)
    return rows


def pack_documents(docs: DataFrame, layout: Layout = Layout(), *, ranks: str = RANKS, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of all documents, one row per packed sequence.

    ``ids`` and ``position_ids`` are one row of the id matrix, padded to the
    width (padding has position 0); ``cu_seqlens`` are the cumulative segment
    lengths from 0; positions start again at 0 with each segment.  Segment i
    holds ids of ``doc_ids[i]`` from its id number ``doc_starts[i]`` on, so
    documents can be put together again.  (shard, buffer, row) names a row.

    Null and empty texts have no segment.  Null ids stay null; rows that
    repeat an id are packed like others.  Other columns are not read.
    """
    import public_tokenizers

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
    shared = docs.sparkSession.sparkContext.broadcast((table, pattern or public_tokenizers.PATTERN))
    key = uuid.uuid4().hex
    highest = max([*table.values(), layout.end_id or 0, layout.pad_id])
    if max(highest, layout.width - 1) > np.iinfo(layout.kind).max:
        raise ValueError("ids do not fit the layout's integers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coding = TaskContext.get().partitionId(), tokeniser(key, shared)
        buffer, pieces, held = 0, [], 0
        for batch in batches:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                said = said.as_py()
                if not said:
                    continue
                ids = coding.encode(said).astype(layout.kind)
                if layout.end_id is not None:
                    ids = np.append(ids, np.array([layout.end_id], layout.kind))
                for start in range(0, len(ids), layout.width):
                    pieces.append((doc, start, ids[start : start + layout.width]))
                held += len(ids)
                if held >= layout.buffer_tokens:
                    yield from _flush(shard, buffer, pieces, layout)
                    buffer, pieces, held = buffer + 1, [], 0
        if pieces:
            yield from _flush(shard, buffer, pieces, layout)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, PACKED)


#: the last job's tokenizer; a Python worker serves many tasks
_LAST: list = []


def tokeniser(key: str, shared) -> Tokeniser:
    if _LAST[:1] != [key]:
        _LAST[:] = [key, Tokeniser(*shared.value)]
    return _LAST[1]


def _flush(shard: int, buffer: int, pieces: list, layout: Layout) -> Iterator[pa.RecordBatch]:
    rows = best_fit([len(p[2]) for p in pieces], layout.width)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        out: dict[str, list] = {f.split()[0]: [] for f in PACKED.split(", ")}
        for i, row in enumerate(part):
            ids = np.full(layout.width, layout.pad_id, layout.kind)
            positions = np.zeros(layout.width, layout.kind)
            ends = np.cumsum([0] + [len(pieces[p][2]) for p in row])
            for p, start, end in zip(row, ends, ends[1:]):
                ids[start:end] = pieces[p][2]
                positions[start:end] = np.arange(end - start)
            values = (shard, buffer, at + i, int(ends[-1]), ids.tobytes(), positions.tobytes(), ends.tolist(),
                      [pieces[p][0] for p in row], [pieces[p][1] for p in row])
            for column, value in zip(out.values(), values):
                column.append(value)
        kinds = [pa.int32()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], names=list(out))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; id matrices are its binary columns, row by row."""
    packed.write.mode("errorifexists").parquet(path)


def unpack_documents(packed: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Segments of packed rows: doc_id, start, ids (array) — the inverse of packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], layout.kind).astype(np.int32)
                ends = row["cu_seqlens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_starts"], pa.int32()),
                     pa.array([ids[a:b] for a, b in zip(ends, ends[1:])], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "ids"],
                )

    return packed.select("ids", "cu_seqlens", "doc_ids", "doc_starts").mapInArrow(run, "doc_id long, start int, ids array<int>")
