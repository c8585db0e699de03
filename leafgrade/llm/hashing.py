"""Hashes of words and of runs of words, a whole text at a time."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """Remembers the hashes of the words of a task, up to some 40 MB of them, then anew."""

    bytes = 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += 160 + len(word)
        if self.bytes > 40 << 20:
            self.clear()
            self.bytes = 0
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def odd(seed: str, n: int) -> np.ndarray:
    """Odd multipliers from a seed."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}{i}") | 1 for i in range(n)], np.uint64)


def rolling(hashes: np.ndarray, width: int, factors: np.ndarray) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    out = hashes[:n] * factors[0]
    for j in range(1, width):
        out += hashes[j : n + j] * factors[j]
    return out
