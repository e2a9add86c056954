"""SentencePiece encoding and decoding by streaming Viterbi.

With a unigram vocabulary a text becomes the pieces with the greatest sum of
scores.  With a merge vocabulary scores order the merges, and the only
segmentation merging can produce is the one whose neighbouring pieces all stay
apart when they are merged alone; every position then has exactly one piece
that can end there, and the same search over backpointers finds it.  Either
way the search keeps only the part of its lattice that is still open: as soon
as the backpointers of all positions that a later piece can start from meet at
one boundary, the ids before it are final and leave the window.  No piece of the vocabularies
in use goes on after a space that follows something else, so paths always
meet where a word begins; words are therefore looked up in a bounded memo.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hushscan.llm.common import Memo
from hushscan.llm.trie import APART, Trie, characters

#: the tokenizer file is a parameter; this is where the box has one
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: stands for a literal U+2581 of a text; no valid text holds a lone surrogate
_LITERAL = "\ud800"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MEMO_LENGTH = 48
_NEVER = float("-inf")
_NOTHING: dict = {}


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; small, so tasks get it whole."""

    def __init__(self, pieces: list[str], scores: list[float], special: Iterable[int], byte_ids: list[int], unknown: int, merges: bool):
        self.merges, self.pieces, self.byte_ids, self.unknown = merges, pieces, byte_ids, unknown
        special = set(special) | set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and p}
        self.scores = list(scores)
        # a piece that merging its own characters does not give is never an output
        merged = {p: self.merge(p) for p in self.ids} if merges else {}
        #: the pieces by their characters: char -> (id of the piece that ends here or -1, what may follow)
        given = {p: i if not merges or merged[p][0] == [p] else -1 for p, i in self.ids.items()}
        self.tree, self.flat = self.grown(given), Trie(given)
        self.halves = {p: last for p, (parts, last) in merged.items() if parts == [p] and last}
        self.pairs = Memo(self.stay_apart, 1_000_000)
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min((scores[i] for i in self.ids.values()), default=0.0) - 10
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.code, self.kind = ("H", np.uint16) if len(pieces) <= 1 << 16 else ("I", np.uint32)
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        dropped = special - set(byte_ids)
        self.surface = [
            bytes([byte_of[i]]) if i in byte_of else b"" if i in dropped else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        by_name = {p: i for i, p in enumerate(pieces) if model.is_byte(i)}
        byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)] if by_name else []
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        if spec.model_type not in (spec.UNIGRAM, spec.BPE):
            raise ValueError("only unigram and merge vocabularies are known here")
        scores = [model.get_score(i) for i in ids]
        return cls(pieces, scores, special, byte_ids, model.unk_id(), spec.model_type == spec.BPE)

    @staticmethod
    def grown(pieces: dict[str, int]) -> dict:
        tree: dict = {}
        for text in sorted(pieces):  # a beginning comes before what goes on from it
            node = tree
            for char in text[:-1]:
                piece, below = node.setdefault(char, (-1, _NOTHING))
                if below is _NOTHING:
                    node[char] = piece, (below := {})
                node = below
            node[text[-1]] = pieces[text], node.get(text[-1], (-1, _NOTHING))[1]
        return tree

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first, and the last merge."""
        parts, ids, scores, last = list(text), self.ids, self.scores, None
        while True:
            found = [(-scores[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not found:
                return parts, last
            _, i = min(found)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stay_apart(self, pair: int) -> bool:
        """Does merging leave these two neighbouring pieces alone?

        Goes back in time, undoing the latest merge on either side of the
        border.  What then faces each other stood side by side until that
        merge, so it must not merge with a better score; on equal scores the
        left place goes first.
        """
        left, right = (self.pieces[i] for i in divmod(pair, len(self.pieces)))
        ids, scores, halves = self.ids, self.scores, self.halves
        if left + right in ids:
            return False
        while True:
            undo_left, undo_right = halves.get(left), halves.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or undo_left is not None and scores[ids[left]] < scores[ids[right]]:
                made, left = scores[ids[left]], undo_left[1]
                joined = ids.get(left + right)
                if joined is not None and scores[joined] > made:
                    return False
            else:
                made, right = scores[ids[right]], undo_right[0]
                joined = ids.get(left + right)
                if joined is not None and scores[joined] >= made:
                    return False

    def fallback(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in (SPACE if char == _LITERAL else char).encode()]

    def relax(self, window: str, best: list, origin: list, by: list, first: int, last: int) -> None:
        """Extend the paths that end at positions first..last-1 by every piece that fits the window.

        ``origin`` and ``by`` say where the best path's last piece begins and
        which piece it is (-1: a character that no piece is).
        """
        scores, merges, pairs, many = self.scores, self.merges, self.pairs, len(self.pieces)
        for start in range(first, last):
            here, before, end, next_chars = best[start], by[start], start, self.tree
            behind = before * many
            for char in window[start : start + self.longest]:
                found = next_chars.get(char)
                if found is None:
                    break
                end += 1
                piece, next_chars = found
                if piece < 0:
                    continue
                if merges:
                    if by[end] is None and (before < 0 or pairs[behind + piece]):
                        origin[end], by[end] = start, piece
                elif here + scores[piece] > best[end]:
                    best[end], origin[end], by[end] = here + scores[piece], start, piece
            if by[start + 1] is None and window[start] not in self.tree:
                best[start + 1], origin[start + 1], by[start + 1] = here + self.floor, start, -1

    def trace(self, window: str, origin: list, by: list, upto: int) -> list[int]:
        parts, at = [], upto
        while at > 0:
            piece, start = by[at], origin[at]
            parts.append(self.fallback(window[start]) if piece < 0 else (piece,))
            at = start
        return [i for part in reversed(parts) for i in part]

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of strings, given out as soon as they are final.

        The window starts at the last boundary given out.  Positions up to a
        piece length before its end are relaxed; of those after the last
        relaxed one, the backpointers are followed until they meet.
        """
        longest = self.longest
        window, best, origin, by, relaxed = "", [0.0], [0], [-1], 0
        for some in chars:
            window += some
            best += [_NEVER] * len(some)
            origin += [0] * len(some)
            by += [None] * len(some)
            ready = len(window) - longest + 1
            if ready - relaxed < 4 * longest:
                continue
            self.relax(window, best, origin, by, relaxed, ready)
            relaxed = ready
            heads = {min(origin[end], ready) for end in range(ready, len(window) + 1) if by[end] is not None} | {ready}
            while len(heads) > 1:
                last = max(heads)
                heads.remove(last)
                heads.add(origin[last])
            met = heads.pop()
            if met:
                yield self.trace(window, origin, by, met)
                base = best[met]
                window, relaxed = window[met:], relaxed - met
                best = [x - base for x in best[met:]]
                origin, by = [x - met for x in origin[met:]], by[met:]
        if window:
            self.relax(window, best, origin, by, relaxed, len(window))
            yield self.trace(window, origin, by, len(window))

    def word(self, word: str) -> tuple[bytes, bool]:
        """Packed ids of a text that fits the memory, and whether they decode to it."""
        size = len(word)
        if size > _MEMO_LENGTH:
            parts = (word[i : i + 256] for i in range(0, size, 256))
            ids = [i for part in self.stream(parts) for i in part]
        else:
            best, origin, by = [0.0] + [_NEVER] * size, [0] * (size + 1), [-1] + [None] * size
            self.relax(word, best, origin, by, 0, size)
            ids = self.trace(word, origin, by, size)
        surface = self.surface
        said = b"".join([surface[i] for i in ids])
        return array(self.code, ids).tobytes(), said == word.replace(SPACE, " ").replace(_LITERAL, SPACE).encode()

    def many(self, words: list[str]) -> list[tuple[bytes, bool]]:
        """``word`` of many short texts: one search over all of them, position by position.

        The words stand behind each other with a gap between them; position p
        is the border before character p.  What ``relax`` does at one start is
        done here for all words that are long enough to have it.
        """
        if not words:
            return []
        joined = APART.join(words) + APART
        chars = characters(joined)
        numbers = self.flat.numbers(chars)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        inside = np.arange(len(chars)) - np.repeat(starts, sizes + 1)
        found = [(at, np.full(len(at), n), piece) for n, (at, piece) in enumerate(self.flat.matches(numbers, self.longest), 1)]
        begin, length, piece = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ())))
        order = np.argsort(inside[begin], kind="stable")
        begin, length, piece = begin[order], length[order], piece[order]
        # characters no piece begins with, by their place in the word
        strange = np.flatnonzero(~np.isin(numbers, self.flat.keys[:-1]) & (inside < np.repeat(sizes, sizes + 1)))
        strange = strange[np.argsort(inside[strange], kind="stable")]
        longest = int(sizes.max())
        cuts = np.searchsorted(inside[begin], np.arange(longest + 1))
        odd = np.searchsorted(inside[strange], np.arange(longest + 1))
        origin, by = np.zeros(len(chars), np.int64), np.full(len(chars), -2, np.int64)
        best = np.full(len(chars), _NEVER)
        by[starts], best[starts] = -1, 0.0
        scores, pairs = np.array(self.scores), self.pairs
        for step in range(longest):
            some = slice(cuts[step], cuts[step + 1])
            start, end, one = begin[some], begin[some] + length[some], piece[some]
            if self.merges:
                before = by[start]
                fits = (by[end] == -2) & (before != -2)
                ask = np.flatnonzero(fits & (before >= 0))
                keys = before[ask] * len(self.pieces) + one[ask]
                fits[ask] = np.fromiter(map(pairs.__getitem__, keys.tolist()), bool, len(ask))
            else:
                sums = best[start] + scores[one]
                fits = sums > best[end]
                best[end[fits]] = sums[fits]
            origin[end[fits]], by[end[fits]] = start[fits], one[fits]
            start = strange[odd[step] : odd[step + 1]]
            start = start[by[start + 1] == -2]
            best[start + 1], origin[start + 1], by[start + 1] = best[start] + self.floor, start, -1
        # back from the ends: the borders of the pieces
        border = np.zeros(len(chars), bool)
        at, first = starts + sizes, starts
        while True:
            on = at > first
            at, first = at[on], first[on]
            if not len(at):
                break
            border[at] = True
            at = origin[at]
        ends = np.flatnonzero(border)
        ids = by[ends]
        unknown = np.flatnonzero(ids < 0)
        at_word = np.searchsorted(starts, ends, "right") - 1
        if len(unknown):
            spelt = [self.fallback(joined[i]) for i in (ends[unknown] - 1).tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[unknown] = list(map(len, spelt))
            ids, at_word = np.repeat(ids, counts), np.repeat(at_word, counts)
            ids[ids < 0] = [i for s in spelt for i in s]
        upto = np.searchsorted(at_word, np.arange(len(words)), "right").tolist()
        packed, width = ids.astype(self.kind).tobytes(), self.kind().itemsize
        said, out, a = list(map(self.surface.__getitem__, ids.tolist())), [], 0
        for word, b in zip(words, upto):
            same = b"".join(said[a:b]) == word.replace(SPACE, " ").replace(_LITERAL, SPACE).encode()
            out.append((packed[a * width : b * width], same))
            a = b
        return out

    def spaced(self, word: str) -> tuple[bytes, bool]:
        return self.word(SPACE + word)

    def words(self, text: str) -> list[str]:
        """The parts of a text that are searched apart, without the mark of their first space."""
        marked = text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        if not self.apart:
            return [marked]
        words = marked.split(SPACE)
        if "" in words:  # several spaces in a row, or one at an end, are one word with what follows
            return [w[1:] for w in _WORDS.findall(SPACE + marked)]
        return words

    def encode(self, texts: list[str | None], memo: Memo) -> list[tuple[bytes, bool] | None]:
        """The packed ids of each text, and whether those of each of its words decode to that word.

        ``memo`` holds ``spaced`` words; those it lacks are searched together.
        """
        parts = [self.words(text) if text else [] for text in texts]
        found = [list(map(memo.get, words)) for words in parts]
        lacking = [i for i, got in enumerate(found) if None in got]
        fresh = {w for i in lacking for w, got in zip(parts[i], found[i]) if got is None and len(w) < _MEMO_LENGTH}
        fresh = [w for w in fresh if w not in memo.old]
        for at in range(0, len(fresh), 65536):
            some = fresh[at : at + 65536]
            for word, ids in zip(some, self.many([SPACE + w for w in some])):
                memo.put(word, ids)
        for i in lacking:
            found[i] = [memo[w] if len(w) < _MEMO_LENGTH else self.spaced(w) for w in parts[i]]
        out = []
        for text, got in zip(texts, found):
            if not got:
                out.append(None if text is None else (b"", True))
                continue
            ids, whole = zip(*got)
            out.append((b"".join(ids), all(whole)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        surface = self.surface
        said = b"".join([surface[i] for i in ids]).decode("utf-8", errors="replace")
        return said[1:] if said[:1] == " " else said


#: the last job's memo; a Python worker serves many tasks
_MEMO: list = []


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", ids: str = "ids", n: str = "n_pieces", lossless: str = "lossless", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, piece ids, their number, and whether decoding them gives the text.

    Null text: null ids, 0 pieces, lossless null.  Empty text: no ids.  Other
    columns, whatever their names, are not carried.  Memory does not grow
    with a text beyond its own characters and ids.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    plain = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        if _MEMO[:1] != [key]:
            _MEMO[:] = [key, Memo(v.spaced, 500_000)]
        memo = _MEMO[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("t").to_pylist()
                packed = v.encode(texts, memo)
                rows = [np.frombuffer(p[0] if p else b"", v.kind) for p in packed]
                sizes = np.array([len(r) for r in rows], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                same = [None if p is None else p[1] for p in packed]
                listed = pa.LargeListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)), mask=pa.array([p is None for p in packed])
                ).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept] + [listed, pa.array(sizes), pa.array(same, pa.bool_())],
                    names=kept + ["ids", "n", "same"],
                )

    schema = "".join(f"{k} {plain.schema[k].dataType.simpleString()}, " for k in kept)
    return plain.mapInArrow(run, schema + "ids array<int>, n long, same boolean").toDF(*keep, ids, n, lossless)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", text: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text behind piece ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    plain = encoded.select(*[encoded[c].alias(f"k{i}") for i, c in enumerate(keep)], encoded[ids].alias("ids"))
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            said = [None if row is None else v.decode(row) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(said, pa.string())], names=kept + ["t"])

    schema = "".join(f"{k} {plain.schema[k].dataType.simpleString()}, " for k in kept)
    return plain.mapInArrow(run, schema + "t string").toDF(*keep, text)
