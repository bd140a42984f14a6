"""The perfect binary Golay code: 23-bit words to the 12-bit indices of nearby codewords.

Every word has exactly one codeword within three errors. All tables follow from the
generator polynomial.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


_OF_BIT = [_remainder(1 << bit) for bit in range(LENGTH)]


def _patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """All error patterns of a weight, and their syndromes."""
    bits = np.array(list(combinations(range(LENGTH), weight)), np.int64).reshape(-1, weight)
    return np.left_shift(1, bits).sum(axis=1), np.bitwise_xor.reduce(np.array(_OF_BIT)[bits], axis=1)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the pattern of at most three errors, those of four errors (-1 where there is none), and the remainder of each upper half."""
    nearest = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        patterns, syndromes = _patterns(weight)
        nearest[syndromes] = patterns
    patterns, syndromes = _patterns(4)
    order = np.argsort(syndromes, kind="stable")
    each = np.bincount(syndromes, minlength=1 << CHECK_BITS).max()
    further = np.full((1 << CHECK_BITS, each), -1, np.int64)
    begin = np.searchsorted(syndromes[order], syndromes[order])
    further[syndromes[order], np.arange(len(order)) - begin] = patterns[order]
    upper = np.zeros(1 << (LENGTH - CHECK_BITS), np.int64)
    for bit in range(LENGTH - CHECK_BITS):
        upper[(np.arange(len(upper)) >> bit & 1).astype(bool)] ^= _OF_BIT[bit + CHECK_BITS]
    return nearest, further, upper


_NEAREST, _FURTHER, _UPPER = _tables()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword within three errors, and those of the codewords at four errors (-1: none).

    Of two words that differ in one bit, each is within four errors of the other's codeword. Only
    words at three errors have codewords at four, five of them each.
    """
    syndromes = _UPPER[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))
    further = _FURTHER[syndromes]
    return (words ^ _NEAREST[syndromes]) >> CHECK_BITS, np.where(further < 0, -1, (words[:, None] ^ further) >> CHECK_BITS)
