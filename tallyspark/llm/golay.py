"""The binary Golay code of length 23: every 23-bit word lies within 3 bits of exactly one of its 4,096 codewords."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - 11)
    return x


#: Check bits of each message, and for each syndrome the error of 3 bits or fewer that gives it.
CHECKS = np.array([_remainder(m << 11) for m in range(4096)], np.int64)
ERRORS = np.zeros(2048, np.int64)
for _weight in range(4):
    for _bits in combinations(range(23), _weight):
        _error = sum(1 << b for b in _bits)
        ERRORS[_remainder(_error)] = _error


def index(words: np.ndarray) -> np.ndarray:
    """The number (0 to 4095) of the codeword next to each 23-bit word."""
    syndrome = CHECKS[words >> 11] ^ (words & 0x7FF)
    return (words ^ ERRORS[syndrome]) >> 11


def keys(words: np.ndarray) -> np.ndarray:
    """For each word (a row), the codeword numbers of the word and of its 23 neighbours, sorted, repeats as -1.

    Words that differ in two bits or fewer have a common neighbour (or are neighbours), hence a common number.
    """
    ball = np.concatenate([[0], 1 << np.arange(23)])
    out = np.sort(index(words[:, None] ^ ball[None, :]), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out
