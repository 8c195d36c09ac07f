"""Vectorised work on a block of texts: bytes, words, hashes. Plain numpy, used inside Spark tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

#: One odd 64-bit value per byte.
BYTE_VALUES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if "p" not in _POWERS or len(_POWERS["p"]) <= n:
        size = max(1 << 20, n + 1)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["i"]


def block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (one more than rows); null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of every row (one more than rows)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border))
    ends = np.flatnonzero(before & (~inside | border))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span, by differences of one running polynomial sum.

    For features only: a polynomial modulo 2^64 has collisions that anyone can write down. To tell spans apart take
    ``word_hashes``.
    """
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


#: The first i bytes of a lane.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U)
#: Spans of more bytes are hashed one by one, and are not kept in a SpanTable.
LONG_SPAN = 512


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on (and from the end) as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of every byte span under a key: eight bytes a step through ``mix``, so equal lanes cancel nowhere.

    Spans of at most eight bytes and one length never collide. With a key that is drawn for the job nobody can write
    longer ones down that do.
    """
    view, left, at = lanes(data), ends - starts, starts
    salt = U(key & (2**64 - 1))
    out = mix((left.astype(U) + U(1)) * U(0xD6E8FEB86659FD93) ^ salt)
    for i in np.flatnonzero(left > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(salt).to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    open_ = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    left, at = left[open_], at[open_]
    while len(open_):
        out[open_] = mix((out[open_] ^ (view[at] & _HEAD[np.minimum(left, 8)])) + salt)
        on = left > 8
        open_, at, left = open_[on], at[on] + 8, left[on] - 8
    return out


class SpanTable:
    """Byte spans by their hash, open addressing over arrays, so a block is looked up at once. A hit needs the same bytes."""

    CLASH = -2

    def __init__(self, bits: int = 21):
        self._mask = U((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self._keys, self._rows = np.zeros(int(self._mask) + 1, U), np.zeros(int(self._mask) + 1, np.int32)
        self._body, self._used, self.n = np.zeros((1 << 20) + 8, np.uint8), 0, 0
        self._begin, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of every span of a block (``view``: its lanes), -1 if unknown, CLASH if another span has its hash."""
        hashes = np.maximum(hashes, U(1))
        out, slot, open_ = np.full(len(hashes), -1, np.int64), hashes & self._mask, np.arange(len(hashes))
        while len(open_):
            held = self._keys[slot]
            hit = held == hashes[open_]
            out[open_[hit]] = self._rows[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + U(1)) & self._mask
        found = np.flatnonzero(out >= 0)
        rows, at, left = out[found], starts[found], (ends - starts)[found]
        same = self._size[rows] == left
        out[found[~same]] = self.CLASH
        open_, at, own, left = found[same], at[same], self._begin[rows[same]], left[same]
        mine = np.ndarray(len(self._body) - 7, "<u8", self._body, strides=(1,))
        while len(open_):
            other = ((view[at] ^ mine[own]) & _HEAD[np.minimum(left, 8)]) != 0
            out[open_[other]] = self.CLASH
            on = ~other & (left > 8)
            open_, at, own, left = open_[on], at[on] + 8, own[on] + 8, left[on] - 8
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Spans of distinct unknown hashes; they get the next rows in their order."""
        hashes, sizes = np.maximum(hashes, U(1)), ends - starts
        rows, slot, open_ = self.n + np.arange(len(hashes)), hashes & self._mask, np.arange(len(hashes))
        while len(open_):
            free = np.flatnonzero(self._keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self._keys[at], self._rows[at] = hashes[open_[taken]], rows[open_[taken]]
            on = np.ones(len(open_), bool)
            on[taken] = False
            open_, slot = open_[on], (slot[on] + U(1)) & self._mask
        total = np.concatenate([[0], np.cumsum(sizes)])
        while self._used + total[-1] + 8 > len(self._body):
            self._body = np.concatenate([self._body, np.zeros_like(self._body)])
        self._body[self._used : self._used + total[-1]] = data[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        self._begin = np.concatenate([self._begin, self._used + total[:-1]])
        self._size = np.concatenate([self._size, sizes])
        self._used += int(total[-1])
        self.n += len(hashes)

    def span(self, row: int) -> bytes:
        return self._body[self._begin[row] : self._begin[row] + self._size[row]].tobytes()

    def unknown(self, hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the spans to add: one for every unknown hash, without the very long spans."""
        at = np.flatnonzero((rows == -1) & (sizes <= LONG_SPAN))
        return at[np.unique(np.maximum(hashes[at], U(1)), return_index=True)[1]]


def shingles(word_hashes: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside a row, and the first shingle of every row (one more than rows).

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(first_word)
    each = np.where(counts == 0, 0, np.maximum(1, counts - k + 1))
    first = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(first_word[:-1] - first[:-1], each) + np.arange(first[-1])
    last = np.repeat(first_word[1:], each)
    padded = np.concatenate([word_hashes, np.zeros(k, U)])
    out = np.zeros(len(at), U)
    for i in range(k):
        here = np.where(at + i < last, padded[at + i], U(0x5851F42D4C957F2D))
        out = mix(out * U(_BASE) + here)
    return out, first


def distinct_rows(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of every row."""
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
