"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Word to 64-bit hash; emptied when it holds 2^18 words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()
_MULTIPLIERS = (np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed image of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` lower-case words.

    A text with fewer words is one shingle of all its words; one without words has none.
    """
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _MULTIPLIERS[k]
    return np.unique(mix(total + np.uint64(size)))
