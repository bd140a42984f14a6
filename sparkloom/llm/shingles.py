"""Word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_WORDS = np.random.Generator(np.random.PCG64(20240501))
#: One random 64-bit value for each byte, and odd bases of polynomial hashes with their inverses modulo 2**64.
BYTE_VALUES = _WORDS.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE_BASE = 0x9E3779B97F4A7C15
_FIRST_BASES = _WORDS.integers(0, 1 << 63, 16, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bases(n: int) -> np.ndarray:
    """An odd factor for each place of a shingle."""
    more = mix64(np.arange(16, max(n, 16), dtype=np.uint64)) >> np.uint64(1)
    return np.concatenate([_FIRST_BASES, more])[:n] * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step % (1 << 64)
    return out[:n]


def blank_bytes(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in spans:
        table[first : last + 1] = True
    return table


#: Words end at ASCII white space.
ASCII_SPACE = blank_bytes((0x20, 0x20), (0x09, 0x0D))


def hashed_words(texts: list[str | None], blanks: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the bounds of each text in them."""
    raw = [(t or "").encode().lower() for t in texts]
    separator = bytes([int(np.flatnonzero(blanks)[0])])
    data = np.frombuffer(separator + separator.join(raw) + separator, np.uint8)
    blank = blanks[data]
    # A word begins where a blank is followed by none, and ends the other way round.
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begins, ends = edges[0::2], edges[1::2]
    powers = _powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[:-1], out=sums[1:])
    inverse = _powers(pow(BYTE_BASE, -1, 1 << 64), len(data) + 1)
    words = mix64((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    return words, np.searchsorted(begins, at)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text is one shingle, one without words none."""
    words, bounds = hashed_words(texts)
    n = len(words)
    mixed, bases = np.zeros(max(n - width + 1, 0), np.uint64), word_bases(width)
    for k in range(width if len(mixed) else 0):
        mixed += words[k : n - width + 1 + k] * bases[k]
    mixed = mix64(mixed)
    sets = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= width:
            sets.append(np.unique(mixed[begin : end - width + 1]))
        elif end > begin:
            own = words[begin:end] * bases[: end - begin]
            sets.append(mix64(np.array([own.sum(dtype=np.uint64) + np.uint64(end - begin)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
