"""Hashes of words and n-grams for many texts at once, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_U = np.uint64
MIX1, MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one map)."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def _odd_powers(n: int) -> np.ndarray:
    out = np.full(n, GOLDEN, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


_BYTES = mix(np.arange(1, 257, dtype=_U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of every text, the number of words per text, and the words' lengths in bytes.

    A-Z count as a-z; words are separated by space and the controls 9 to 13.  A word's hash depends on its bytes
    and places only.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
    blank = _BLANK[data]
    inside = ~blank
    start = inside.copy()
    start[1:] &= blank[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    stop = blank.copy()
    stop[0] = False
    stop[1:] &= inside[:-1]
    lengths = np.flatnonzero(stop) - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _BYTES[data[at]] * _odd_powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(_U))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64), lengths


def sequence_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out = mix(out * _U(GOLDEN) + items[k:k + n])
    return out


def runs(counts: np.ndarray) -> np.ndarray:
    """Start of each run in an array that holds ``counts`` items per text."""
    return np.cumsum(counts) - counts


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; texts may have none."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
