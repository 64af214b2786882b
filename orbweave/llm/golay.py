"""The binary Golay code of length 23: nearby codewords of 23-bit words, for numpy arrays."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DIMENSION = 23, 12
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Two words at most 2 bits apart have a codeword within this distance of both: the code covers all words at 3 bits, so
#: the word half way has a codeword within 3 bits, and that is within 4 bits of either.
RADIUS = 4


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: the syndrome."""
    words = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - (LENGTH - DIMENSION))), words)
    return words


class Golay:
    """Tables by syndrome of all error patterns of weight up to ``RADIUS``."""

    def __init__(self) -> None:
        patterns = np.array([sum(1 << i for i in c) for w in range(RADIUS + 1) for c in combinations(range(LENGTH), w)], np.int64)
        syndromes = _remainder(patterns)
        order = np.argsort(syndromes, kind="stable")
        counts = np.bincount(syndromes, minlength=1 << (LENGTH - DIMENSION))
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.count = counts
        self.patterns = np.full((len(counts), counts.max()), -1, np.int64)
        for k in range(counts.max()):
            has = counts > k
            self.patterns[has, k] = patterns[order][at[has] + k]
        units = _remainder(1 << np.arange(LENGTH, dtype=np.int64))
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(12):
            low ^= np.where(np.arange(1 << 12) >> i & 1, units[i], 0)
        for i in range(11):
            high ^= np.where(np.arange(1 << 11) >> i & 1, units[12 + i], 0)
        self.low, self.high = low, high

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Indices (12 bits) of the codewords within ``RADIUS`` of each word, one row per word, -1 where there are fewer."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        errors = self.patterns[syndrome]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> (LENGTH - DIMENSION), -1)
