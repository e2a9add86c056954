"""A trie in arrays: many positions of many words go down it at once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np

#: between words, in no word: a lone surrogate, which no valid text holds
APART = "\udfff"


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Trie:
    """Values (0 or more, or -1 for none) of strings; node 0 is the root."""

    def __init__(self, values: Mapping[str, int]):
        alphabet = sorted(set().union(*values)) if values else []
        self.size = len(alphabet) + 1
        #: code point -> its number, from 1; 0 for all that no string holds
        self.number = np.zeros(ord(alphabet[-1]) + 2 if alphabet else 1, np.int64)
        number = {c: i for i, c in enumerate(alphabet, 1)}
        self.number[[ord(c) for c in alphabet]] = range(1, self.size)
        edges: dict[int, int] = {}
        found = [-1]
        for text in sorted(values):
            node = 0
            for c in text:
                node = edges.setdefault(node * self.size + number[c], len(found))
                if node == len(found):
                    found.append(-1)
            found[node] = values[text]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.child = np.append(np.fromiter(edges.values(), np.int64, len(edges))[order], -1)
        self.values = np.array(found, np.int64)

    def numbers(self, chars: np.ndarray) -> np.ndarray:
        return self.number[np.minimum(chars, len(self.number) - 1)]

    def matches(self, numbers: np.ndarray, longest: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: where strings of that length begin, and their values."""
        at, node = np.arange(len(numbers)), np.zeros(len(numbers), np.int64)
        for length in range(longest):
            if length:
                inside = at + length < len(numbers)
                at, node = at[inside], node[inside]
            keys = node * self.size + numbers[at + length]
            place = np.searchsorted(self.keys, keys)
            alive = self.keys[place] == keys
            at, node = at[alive], self.child[place[alive]]
            if not len(at):
                return
            value = self.values[node]
            whole = value >= 0
            yield at[whole], value[whole]
