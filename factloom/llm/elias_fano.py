"""Elias-Fano sequences and files of named arrays, read in place from memory-mapped bytes.

A non-decreasing sequence is stored as packed low bits and where the bucket of each high part begins, so a file is opened
without a pass over it. ``get`` reads the i-th value; ``find`` goes to the bucket of a value's high part and searches its low
bits there. Both take whole arrays of queries.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from factloom.llm.common import read_bytes, write_bytes

_U = np.uint64
#: Values that a bucket (those of one high part) holds on average; a power of two.
BUCKET = 8


class EliasFano:
    def __init__(self, n: int, shift: int, low: np.ndarray, starts: np.ndarray) -> None:
        """low: packed bytes with 8 spare ones; starts: how many values have a high part below each. Both are read in place."""
        self.n, self.shift = n, shift
        self.mask = _U((1 << shift) - 1)
        self.windows = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if shift else None
        self.starts = starts

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of a sequence of non-decreasing uint64 values; names as ``load`` expects them."""
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, min(56, (top // max(n, 1)).bit_length() - 1 + BUCKET.bit_length() - 1)) if n else 0
        low = np.zeros((n * shift + 7) // 8 + 8, np.uint8)
        for i in range(0, n if shift else 0, 1 << 16):
            part = values[i : i + (1 << 16)]
            bits = ((part[:, None] >> np.arange(shift, dtype=np.uint64)) & _U(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            low[i * shift // 8 : i * shift // 8 + len(packed)] = packed
        # One bucket more than there are high parts: the empty one of all that lie beyond.
        sizes = np.bincount((values >> _U(shift)).astype(np.int64), minlength=(top >> shift) + 2)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32 if n < 1 << 32 else np.int64)
        return {"meta": np.array([n, shift], np.int64), "low": low, "starts": starts}

    @staticmethod
    def load(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, shift = arrays[f"{name}.meta"].tolist()
        return EliasFano(n, shift, *(arrays[f"{name}.{k}"] for k in ("low", "starts")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        bit = i * self.shift
        return (self.windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``; quickest where they ascend."""
        high = np.searchsorted(self.starts, i.astype(self.starts.dtype), "right") - 1
        return (high.astype(np.uint64) << _U(self.shift)) | self._low(i)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is at least the given one, and where the bucket of the value's high part ends."""
        # High parts beyond the vector have no bucket.
        h = np.minimum(values >> _U(self.shift), _U(len(self.starts) - 2)).astype(np.int64)
        low, end = self.starts[h].astype(np.int64), self.starts[h + 1].astype(np.int64)
        high, want = end.copy(), values & self.mask
        open_ = np.flatnonzero(low < high)
        while open_.size:
            a, b = low[open_], high[open_]
            mid = (a + b) >> 1
            less = self._low(mid) < want[open_]
            low[open_] = a = np.where(less, mid + 1, a)
            high[open_] = b = np.where(less, b, mid)
            open_ = open_[a < b]
        return low, end

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is at least the given one; n if there is none."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1. Within its bucket a value is known by its low bits."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        at, end = self._search(values)
        return np.where((at < end) & (self._low(np.minimum(at, self.n - 1)) == (values & self.mask)), at, -1)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays into one file, each at a multiple of 64 bytes."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 8) // 64) * 64
    out = np.zeros(start + at, np.uint8)
    out[:8] = np.frombuffer(len(text).to_bytes(8, "little"), np.uint8)
    out[8 : 8 + len(text)] = np.frombuffer(text, np.uint8)
    for name, a in arrays.items():
        out[start + head[name][0] :][: a.nbytes] = np.ascontiguousarray(a).view(np.uint8)
    write_bytes(uri, pa.py_buffer(out))


def load(uri: str) -> dict[str, np.ndarray]:
    """Views into a file that ``save`` wrote."""
    raw = np.frombuffer(read_bytes(uri), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(size + 8) // 64) * 64
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {name: raw[start + at :][: n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in head.items()}
