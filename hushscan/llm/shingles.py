"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from hushscan.llm.common import Memo

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_hashes = Memo(xxhash.xxh3_64_intdigest)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    A text with fewer words is one run; without words the set is empty.
    """
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(words) - size + 1)
    width = min(size, len(words))
    mixed = np.full(runs, width, np.uint64)
    for i in range(width):
        mixed = mixed * _STEP + hashed[i : i + runs]
        mixed ^= mixed >> _SHIFT
    mixed *= _MIX
    return np.unique(mixed ^ (mixed >> _SHIFT))


def set_id(hashes: np.ndarray) -> bytes:
    """128 bits that name a set; empty for the empty set."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else b""
