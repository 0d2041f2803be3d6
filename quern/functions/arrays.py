"""Words and runs of words of Arrow string columns, hashed all at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: A slice of a batch holds at most so many bytes of text, unless one text is longer.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text in column ``text``; a single text stays whole."""
    at, _ = buffers(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done, factor = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(factor)
            done, factor = done + more, factor * factor & _MASK
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial sums of values[start:end] for all spans, from prefix sums: the base is odd, so it can be divided out."""
    n = len(values) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        np.cumsum(values * _powers(base, n)[:-1], out=sums[1:], dtype=np.uint64)
        return (sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), n)[start]


class Words:
    """Words of texts whose words are parted by single blanks: where each begins and ends, its hash and its text."""

    def __init__(self, column: pa.Array):
        at, self.raw = buffers(column)
        inside = self.raw != 0x20
        before = np.r_[False, inside[:-1]]
        begins = at[:-1][at[:-1] < len(self.raw)]
        before[begins] = False
        after = np.r_[inside[1:], False]
        after[begins[begins > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.owner = np.searchsorted(at, self.start, side="right") - 1

    @cached_property
    def hashes(self) -> np.ndarray:
        return _mixed(_spans(self.raw.astype(np.uint64) + np.uint64(1), self.start, self.end, _BASE) + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within a text."""
        last = len(self.start) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.owner[:last] == self.owner[n - 1 :])
        return first, _mixed(_spans(self.hashes, first, first + n, _STEP))

    def text(self, first: int, n: int) -> str:
        return self.raw[self.start[first] : self.end[first + n - 1]].tobytes().decode("utf-8", "replace")


class HashSet:
    """Membership in a fixed set of 64-bit hashes: a bitmap turns most away, a binary search settles the rest."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        bits = max(10, int(len(self.sorted) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.sorted >> self.shift] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are in the set."""
        likely = np.flatnonzero(self.bitmap[hashes >> self.shift])
        if not len(likely) or not len(self.sorted):
            return likely[:0]
        some = hashes[likely]
        at = np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)
        return likely[self.sorted[at] == some]


# Fixed values of MD5: rotations of each round; the constants follow from sines.
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_INITIAL = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_blocks(words: np.ndarray) -> np.ndarray:
    """First state word of MD5 over single blocks, given as 16 rows of little-endian words."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _INITIAL)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[i])
        f += words[g]
        turn = _TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        f <<= np.uint32(turn)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_INITIAL[0])


def md5_heads(raw: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 8192) -> np.ndarray:
    """The first 32 bits, big-endian, of the MD5 of raw[start:end] for all spans at once.

    Spans up to 55 bytes are one block of the hash and go through array arithmetic; longer ones go one by one.
    """
    out = np.empty(len(start), np.uint32)
    size = end - start
    short, long = np.flatnonzero(size <= 55), np.flatnonzero(size > 55)
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(56, np.uint8)], 56)
    place = np.arange(56)
    for i in range(0, len(short), block):
        some = short[i : i + block]
        cells = np.zeros((len(some), 64), np.uint8)
        cells[:, :56] = windows[start[some]]
        n = size[some]
        cells[:, :56] *= place < n[:, None]
        cells[np.arange(len(some)), n] = 0x80
        cells[:, 56:58] = (n * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        out[some] = _md5_blocks(np.ascontiguousarray(cells.view("<u4").T)).byteswap()
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.md5(raw[start[k] : end[k]], usedforsecurity=False).digest()[:4], "big")
    return out


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed_in(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return h ^ (_turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))


def murmurs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42, most: int = 64) -> np.ndarray:
    """32-bit MurmurHash3 of raw[start:end] for all spans at once, as Spark's HashingTF has it; of over ``most`` blocks one by one."""
    size = end - start
    blocks = size // 4
    # Small integers are sorted by radix; how longer spans lie among themselves does not matter.
    order = np.argsort((-np.minimum(blocks, most + 1)).astype(np.int8), kind="stable")
    begin, many = start[order], blocks[order]
    least = -np.minimum(many, most + 1)
    padded = np.r_[raw, np.zeros(4, np.uint8)].astype(np.uint32)
    quads = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    h = np.full(len(start), seed, np.uint32)
    with np.errstate(over="ignore"):
        long = int(np.searchsorted(least, -most))
        for i in range(long):
            x = seed
            for k in quads[begin[i] : begin[i] + 4 * many[i] : 4].tolist():
                k = k * 0xCC9E2D51 & 0xFFFFFFFF
                x ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
                x = ((x << 13 | x >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
            h[i] = x
        for k in range(int(many[long]) if long < len(many) else 0):
            some = slice(long, int(np.searchsorted(least, -k)))
            h[some] = _turned(_mixed_in(h[some], quads[begin[some] + 4 * k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        length = size[order]
        rest = quads[begin + 4 * many] & ((np.uint32(1) << (length & 3).astype(np.uint32) * np.uint32(8)) - np.uint32(1))
        h = _mixed_in(h, rest) ^ length.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    out = np.empty_like(h)
    out[order] = h
    return out
