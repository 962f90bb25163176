"""Words of whole batches of texts, found and hashed with numpy on their UTF-8 bytes.

A word is a run of ASCII letters and digits and of all code points from 128 up, with A-Z in lower case:
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text so lowered. Every byte of a longer UTF-8 sequence is over
127, so that bytes decide as code points would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOWER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOWER[_b] = _b + 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64, on an array that they may change."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte of a word, none for other bytes.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[_LOWER == 0] = 0
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        ones = np.full(max(n, 1 << 16), base)
        ones[0] = 1
        _powers[kind] = have = np.multiply.accumulate(ones)
    return have


@dataclass
class Words:
    """Of a batch: its bytes, where each text begins (and the last ends), and each word's text, first byte, end and hash."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The index of each text's first word, and the number of words."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    def text(self, i: int) -> bytes:
        return _LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def words(texts: pa.Array) -> Words:
    """texts: an Arrow string array without nulls."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LOWER[data] > 0
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word ends where its text does
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(start):
        sums = np.add.reduceat(_VALUE[data] * _power("up", _BASE, len(data))[: len(data)], start)
        hashes = mix(sums * _power("down", _INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, np.searchsorted(offsets[1:], start, "right"), start, end, hashes)


def runs(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of True."""
    edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
