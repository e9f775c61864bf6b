"""Words of whole Arrow string columns as 64-bit fingerprints, found and hashed without a Python loop over words.

A fingerprint is a polynomial over per-byte random values modulo 2**64 with an odd base, followed by a
finaliser; A-Z count as a-z. Two different words share one with a probability of about 2**-64. All
separators are ASCII, so bytes of UTF-8 give the same words as code points do.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _fold(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[0x09:0x0E] = NONSPACE[0x20] = False
_VALUE = _fold(mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)))
_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_CHUNK = 1 << 17
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: n + 1 word offsets of the n rows.
    rows: np.ndarray


def find_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of ``inside`` bytes; a run never spans two rows."""
    flags = inside[buf]
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    first[edges] |= flags[edges]
    last[edges - 1] |= flags[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def scan(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """All words of the rows, in order."""
    starts, ends = find_words(buf, offsets, inside)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        part = buf[base : ends[j - 1]]
        power, inverse = _power_tables(max(len(part) + 1, _CHUNK + 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    hashes[hashes == 0] = 1
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64))


_STEP = _U(0xD1342543DE82EF95)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the runs of ``k`` words that begin at each word but the last ``k - 1`` (rows are not looked at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for d in range(1, k):
        total *= _STEP
        total += hashes[d : d + n]
    return mix(total)
