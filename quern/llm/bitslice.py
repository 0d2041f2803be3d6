"""Bit-sliced comparison of rows of bytes: vertical bit planes and carry-save counters.

Plane ``b`` holds bit ``b`` of 64 lanes a word, so that one word operation works on 64 lanes.  Differences are
added up by full adders, four at a time, into counters that are planes themselves.  A query is abandoned once
the counters of all its lanes exceed the radius.
"""

from __future__ import annotations

import numpy as np

WORD = 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def as_rows(prints: np.ndarray) -> np.ndarray:
    """uint64 values as rows of eight bytes."""
    return prints.astype(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)


def planes(rows: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of rows of bytes: bit i % 64 of word i // 64 belongs to row i."""
    lanes = -(-len(rows) // WORD) * WORD
    bits = np.zeros((rows.shape[1] * 8, lanes), np.uint8)
    bits[:, : len(rows)] = np.unpackbits(rows, axis=1).T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three planes."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(queries: np.ndarray, lanes: np.ndarray, radius: int, group: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) index pairs of rows that differ in at most ``radius`` groups of ``group`` bits."""
    if not len(queries) or not len(lanes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = planes(lanes)
    flips = np.unpackbits(queries, axis=1).astype(np.uint64) * _FULL
    alive = np.arange(len(queries))
    shape = (len(alive), table.shape[1])
    digits = [np.zeros(shape, np.uint64) for _ in range(max(2, radius.bit_length()))]
    over = np.zeros(shape, np.uint64)

    def differs(g: int) -> np.ndarray:
        made = table[g * group] ^ flips[:, g * group, None]
        for b in range(g * group + 1, (g + 1) * group):
            made |= table[b] ^ flips[:, b, None]
        return made

    groups = len(table) // group  # a multiple of four: rows are whole words of four bytes or more
    for g in range(0, groups, 4):
        digits[0], first = _add(digits[0], differs(g), differs(g + 1))
        digits[0], second = _add(digits[0], differs(g + 2), differs(g + 3))
        digits[1], carry = _add(digits[1], first, second)
        for place in range(2, len(digits)):
            digits[place], carry = digits[place] ^ carry, digits[place] & carry
        over |= carry
        above, equal = np.zeros_like(over), np.full_like(over, _FULL)
        for place in reversed(range(len(digits))):
            if radius >> place & 1:
                equal &= digits[place]
            else:
                above |= equal & digits[place]
                equal &= ~digits[place]
        over |= above
        keep = (over != _FULL).any(axis=1)
        if not keep.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not keep.all():
            alive, flips, over = alive[keep], flips[keep], over[keep]
            digits = [d[keep] for d in digits]
    found = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(lanes)]
    at, lane = np.nonzero(found)
    return alive[at], lane
