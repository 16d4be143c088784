"""Words and word n-grams of Arrow text columns as numpy arrays, whole batches at a time.

A word is a longest run of bytes other than space and tab..carriage return. UTF-8 never uses those bytes inside a character,
so the work is on bytes. Hashes are 64 bits and depend on the words alone: words of up to eight bytes have different ones, longer words and word sequences are folded in eight bytes at a time by a
nonlinear mix (sums of powers would let anyone write down texts that collide), and words above LONG bytes get a cryptographic digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

LONG = 128


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without gaps, and where each row begins (one entry more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of consecutive texts: ``hash``, byte range ``start``..``end`` in ``data``, and ``at``, the first word of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        ink = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = ink
        before[at] = False  # a text begins a new word
        self.start = np.flatnonzero(ink & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = ink
        after[at] = False
        self.end = np.flatnonzero(ink & ~after[1:]) + 1
        self.at = np.searchsorted(self.start, at)
        self.hash = byte_hashes(data, self.start, self.end)

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n consecutive words, and the first gram of each text. Texts of fewer words have none."""
        count = np.maximum(np.diff(self.at) - (n - 1), 0)
        first = np.concatenate(([0], np.cumsum(count)))
        if not first[-1]:
            return np.zeros(0, U), first
        begin = np.arange(first[-1]) + np.repeat(self.at[:-1] - first[:-1], count)
        part, size, left = self.hash, 1, n  # hashes of ``size`` words from each on; those across the end of a text are not taken
        out, have = None, 0
        while True:
            if left & size:
                out, have = (part, size) if out is None else (_join(out, part, have), have + size)
            if have == n:
                return mix(out[begin], seed + n), first
            part, size = _join(part, part, size), 2 * size

    def whole(self, row: int) -> np.ndarray:
        """One hash, as an array, for all words of a text in order."""
        own = self.hash[self.at[row] : self.at[row + 1]]
        seen = np.array([len(own)], U)
        for i in range(len(own)):
            seen = mix(seen ^ own[i : i + 1], 3)
        return seen


def _join(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each place on, followed by those of ``right`` behind them."""
    kept = max(0, min(len(left), len(right) - size))
    return mix(mix(left[:kept], 1) ^ right[size : size + kept], 2)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a time."""
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lane = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(_lane(lane, start, size), 5) + size.astype(U) * U(0xC2B2AE3D27D4EB4F)
    going = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(going):
        out[going] = mix(out[going] ^ _lane(lane, start[going] + at, size[going] - at), 7)
        at += 8
        going = going[size[going] > at]
    long = np.flatnonzero(size > LONG)
    if len(long):
        digests = b"".join(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest() for i in long.tolist())
        out[long] = np.frombuffer(digests, U)
    return out


def _lane(lane: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on, zeros behind the last."""
    return lane[at] & (~U(0) >> (U(8) * (8 - np.minimum(left, 8)).astype(U)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
