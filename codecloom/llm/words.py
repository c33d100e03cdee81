"""Words of a text as 64-bit hashes, and hashes of runs of them; used inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word to 64-bit hash. Bounded: it starts anew when it is full."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; one per start, len(words) - width + 1 in all.

    A seed other than 0 spreads the word hashes anew before they are summed, so that runs which meet under one seed are no likelier to
    meet under another. (Two words with one 64-bit hash are one word under any seed.)
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if seed:
        words = mix64(words + np.uint64((seed * 0xD1342543DE82EF95) & (1 << 64) - 1))
    out = np.full(n, np.uint64(seed * 2 + 1), np.uint64)
    for k in range(width):
        out *= _ODD
        out += words[k : k + n]
    return mix64(out)
