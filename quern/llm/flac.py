"""FLAC media columns: decode Rice residuals and linear predictors, verify checksums, write PCM blocks.

The decoder reads the native FLAC format: constant, verbatim, fixed and LPC subframes, both Rice
methods with escapes, wasted bits, stereo decorrelation, 4 to 32 bits a sample.  Frames of many
streams are decoded in lockstep: one array step decodes the next Rice code of every frame at once, and
one more undoes a step of every LPC predictor.  Each frame's CRC-8 and CRC-16 and the stream's MD5 are
verified.  PCM blocks carry their first sample, so a reader can seek.

The encoder stores bytes as 8-bit mono samples (value - 128) with fixed predictors and Rice residuals
and writes a seek table; it exists so that payloads can be stored losslessly.

Results that are defined: a null text counts as empty, whose payload is 64 zero bytes; a null medium has
no blocks; a damaged frame gives a block without bytes that is marked as not verified; equal texts give
equal media; texts and streams of any length are encoded and decoded in parts of bounded size; rows that
repeat an id each get their row; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from quern.llm.common import map_text, narrow, slices, texts_as_bytes
from quern.runtime import ship

BLOCK = 4096
UNIT = 64
RATE = 8000
#: Distance table of the CRC-16; longer frames are checked in pieces of this many bytes.
REACH = 8192
#: Bytes or samples that are encoded or decoded at a time, in one text or in many; a worker needs some 200 bytes for each.
SLICE = 3 << 20
#: Zeros that the texts of a slice may be filled up with beside that.
FILL = 1 << 18

# ---------------------------------------------------------------------------------- checksums


@lru_cache
def _crc8_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value << 1 ^ 0x07) & 0xFF if value & 0x80 else value << 1
        table.append(value)
    return table


def crc8(data: bytes) -> int:
    table, crc = _crc8_table(), 0
    for b in data:
        crc = table[crc ^ b]
    return crc


@lru_cache
def _crc16_reach() -> np.ndarray:
    """[d, b]: what byte b adds to the CRC-16 when d bytes follow it."""
    step = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        step = np.where(step & 0x8000, (step << 1) ^ 0x8005, step << 1) & 0xFFFF
    table = np.empty((REACH, 256), np.uint16)
    row = step
    for d in range(REACH):
        table[d] = row
        row = ((row << 8) & 0xFFFF) ^ step[row >> 8]
    return table


def crc16_many(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of raw[starts[i]:ends[i]], by one gather for all bytes of frames within reach."""
    table = _crc16_reach()
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    short = np.nonzero((size <= REACH) & (size > 0))[0]
    if len(short):
        n = size[short]
        first = np.cumsum(n) - n
        local = np.arange(int(n.sum())) - np.repeat(first, n)
        parts = table[np.repeat(n, n) - 1 - local, raw[np.repeat(starts[short], n) + local]]
        out[short] = np.bitwise_xor.reduceat(parts, first)
    for i in np.nonzero(size > REACH)[0].tolist():
        crc = 0
        for a in range(int(starts[i]), int(ends[i]), REACH):
            piece = raw[a : min(a + REACH, int(ends[i]))]
            d = len(piece)
            moved = int(table[d - 1, crc >> 8]) ^ (int(table[d - 2, crc & 255]) if d > 1 else (crc & 255) << 8)
            crc = moved ^ int(np.bitwise_xor.reduce(table[d - 1 - np.arange(d), piece]))
        out[i] = crc
    return out


# ---------------------------------------------------------------------------------- encoder


def _utf8_number(n: int) -> bytes:
    """The frame number in the extended UTF-8 code, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead_bits = 6
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead_bits -= 1
        if n < 1 << lead_bits:
            return bytes([(0xFF << (lead_bits + 1) & 0xFF) | n, *reversed(tail)])


def _part_size(n: np.ndarray) -> np.ndarray:
    """Samples in a Rice partition: up to four partitions, each at least a unit."""
    order = np.zeros_like(n)
    for p in (1, 2):
        order[(n % (UNIT << p)) == 0] = p
    return order


def _stream(payload: bytes, parts: list[tuple[bytes, np.ndarray, np.ndarray]], block: int) -> bytes:
    """Stream header, seek table and frames of one payload; a part is frames, their bytes and their samples."""
    sizes, samples = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    md5 = hashlib.md5(usedforsecurity=False)
    for a in range(0, len(payload), SLICE):
        md5.update((np.frombuffer(payload[a : a + SLICE], np.uint8) ^ 0x80).tobytes())
    info = struct.pack(">HH", int(min(block, max(samples[0], 16))), int(max(samples[0], 16)))
    info += int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5.digest()
    places = np.cumsum(sizes) - sizes
    points = b"".join(struct.pack(">QQH", j * block, at, n) for j, (at, n) in enumerate(zip(places.tolist(), samples.tolist())))
    head = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points
    return b"".join([head, *(frames for frames, _, _ in parts)])


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload (lengths are positive multiples of 64); bounded parts of them at a time."""
    step = max(SLICE // block, 1) * block
    pieces = [(i, p[a : a + step], a // block) for i, p in enumerate(payloads) for a in range(0, len(p), step)]
    parts: list[list] = [[] for _ in payloads]
    at = 0
    while at < len(pieces):
        last, size = at, 0
        while last < len(pieces) and (last == at or size + len(pieces[last][1]) <= step + FILL):
            size += len(pieces[last][1])
            last += 1
        for (i, _, _), made in zip(pieces[at:last], _frames([p for _, p, _ in pieces[at:last]], [k for _, _, k in pieces[at:last]], block)):
            parts[i].append(made)
        at = last
    return [_stream(p, own, block) for p, own in zip(payloads, parts)]


def _frames(payloads: list[bytes], numbers: list[int], block: int) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Frames of each payload, numbered from ``numbers`` on, with the bytes and the samples of each; all in one pass."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    sizes, owner, number = [], [], []
    for i, p in enumerate(payloads):
        for k, a in enumerate(range(0, len(p), block)):
            sizes.append(min(block, len(p) - a))
            owner.append(i)
            number.append(numbers[i] + k)
    n = np.array(sizes, np.int64)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(x)) - first[of]

    # The fixed predictor of order 0, 1 or 2 with the smallest residuals.
    residuals = [x]
    for _ in range(2):
        residuals.append(np.diff(residuals[-1], prepend=0))
    cost = np.stack([np.add.reduceat(np.abs(r) * (at >= k), first) for k, r in enumerate(residuals)])
    order = np.argmin(cost, axis=0)
    r = np.choose(order[of], residuals)
    coded = at >= order[of]
    u = np.where(coded, (r << 1) ^ (r >> 31), 0).astype(np.int64)

    # The Rice parameter of each partition with the fewest bits.
    p_order = _part_size(n)
    parts = 1 << p_order
    part_first = np.concatenate([f + np.arange(k) * (m // k) for f, k, m in zip(first.tolist(), parts.tolist(), n.tolist())])
    part_n = np.repeat(n // parts, parts)
    lead = np.zeros(len(part_first), np.int64)
    lead[np.cumsum(parts) - parts] = order
    bits = np.stack([np.add.reduceat(u >> k, part_first) + (part_n - lead) * (k + 1) for k in range(12)])
    k_part = np.argmin(bits, axis=0)
    part_of = np.repeat(np.arange(len(part_first)), part_n)
    k = k_part[part_of]
    q = u >> k
    width = np.where(coded, q + 1 + k, 0)

    # Lay out the frames: header, subframe header, warm-up, residual header, partitions, padding, CRC-16.
    heads = []
    for m, o, no in zip(sizes, order.tolist(), number):
        head = b"\xff\xf8" + bytes([0x70, 0x02]) + _utf8_number(no) + struct.pack(">H", m - 1)
        heads.append(head + bytes([crc8(head), (8 | o) << 1]))
    head_bytes = np.array([len(h) for h in heads], np.int64) + order
    within = np.cumsum(width) - width
    frame_bits = head_bytes * 8 + 6 + 4 * parts + np.add.reduceat(width, first)
    frame_bytes = (frame_bits + 7) // 8 + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    place = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    base = start * 8 + head_bytes * 8 + 6
    frame_of_part = np.repeat(np.arange(len(n)), parts)
    nth_part = np.arange(len(part_first)) - np.repeat(np.cumsum(parts) - parts, parts)
    code_at = base[of] + within - within[first][of] + 4 * (nth_part[part_of] + 1)
    part_at = base[frame_of_part] + 4 * nth_part + within[part_first] - within[first][frame_of_part]
    for b in range(4):
        place[part_at + b] = k_part >> (3 - b) & 1
        place[base - 4 + b] = p_order >> (3 - b) & 1
    own = np.nonzero(coded)[0]
    stop = code_at[own] + q[own]
    place[stop] = 1
    k, u = k[own], u[own]
    for b in range(int(k.max()) if len(k) else 0):
        some = k > b
        place[stop[some] + k[some] - b] = u[some] >> b & 1
    frames = np.packbits(place)
    signed = x.astype(np.int8).view(np.uint8)
    for s, h, o, f in zip(start.tolist(), heads, order.tolist(), first.tolist()):
        frames[s : s + len(h)] = np.frombuffer(h, np.uint8)
        frames[s + len(h) : s + len(h) + o] = signed[f : f + o]
    ends = start + frame_bytes - 2
    crc = crc16_many(frames, start, ends)
    frames[ends], frames[ends + 1] = crc >> 8, crc & 0xFF

    out, frame = [], 0
    for i in range(len(payloads)):
        last = frame
        while last < len(owner) and owner[last] == i:
            last += 1
        own = frames[int(start[frame]) : int(start[last - 1] + frame_bytes[last - 1])].tobytes()
        out.append((own, frame_bytes[frame:last], n[frame:last]))
        frame = last
    return out


# ---------------------------------------------------------------------------------- decoder


@dataclass
class Stream:
    channels: int
    bits: int
    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    body: int  # where the frames begin
    block: int = 0  # samples of all frames but the last, where that is fixed


@dataclass
class Frame:
    first: int  # first sample
    size: int
    assignment: int
    bits: int
    start: int  # of the frame in its buffer
    data: int  # of its first subframe
    end: int = 0  # behind its CRC-16
    good: bool = True
    channels: list[np.ndarray] = field(default_factory=list)


def parse_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, seek = 4, None, []
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            info = block
        elif kind & 0x7F == 3:
            seek = [struct.unpack_from(">QQH", block, i) for i in range(0, len(block) - 17, 18)]
        if kind & 0x80 or at + 4 > len(data):
            break
    if info is None or len(info) < 34:
        raise ValueError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    return Stream((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], seek, at, int.from_bytes(info[:2], "big") if info[:2] == info[2:4] else 0)


_BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _header(data: bytes, at: int, stream: Stream, fixed_size: int) -> tuple[Frame, int] | None:
    """A frame header with a right CRC-8, and its number; None where there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    assignment, bits_code = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p, lead = at + 4, data[at + 4]
    more = 0
    while lead & 0x80 >> more and more < 8:
        more += 1
    if more == 1 or more > 7 or rate_code == 15 or size_code == 0 or assignment > 10 or bits_code == 3 or data[at + 3] & 1:
        return None
    number = lead & (0x7F >> more)
    for b in data[p + 1 : p + more]:
        number = number << 6 | b & 0x3F
    p += max(more, 1)
    size = _BLOCK_SIZES.get(size_code, 0)
    if size_code in (6, 7):
        size = int.from_bytes(data[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    first = number if data[at + 1] & 1 else number * (fixed_size or size)
    return Frame(first, size, assignment, _SAMPLE_BITS.get(bits_code, stream.bits), at, p + 1), number


_SYNC = re.compile(rb"\xff[\xf8\xf9]")


def _sync(data: bytes, at: int, stream: Stream, fixed: int) -> Frame | None:
    """The next frame header from ``at`` on that has a right CRC-8."""
    for code in _SYNC.finditer(data, at):
        if found := _header(data, code.start(), stream, fixed):
            return found[0]
    return None


def _whole(data: bytes, frame: Frame, stream: Stream, fixed: int) -> bool:
    """Whether the bytes up to a header that continues the frame, or to the end, have the frame's CRC-16."""
    then = frame
    while then := _sync(data, then.data, stream, fixed):
        if then.first == frame.first + frame.size:
            break
    end = then.start if then else len(data)
    crc = crc16_many(np.frombuffer(data, np.uint8), np.array([frame.start]), np.array([end - 2]))[0]
    return int(crc) == int.from_bytes(data[end - 2 : end], "big")


def find_frames(data: bytes, stream: Stream) -> list[Frame]:
    """Frames in order: headers with a right CRC-8 whose first sample is the one due.

    Behind a damaged frame the next may begin later than due: where the seek table names it, or its CRC-16 is right.
    """
    frames: list[Frame] = []
    named = {(stream.body + offset, sample) for sample, offset, _ in stream.seek}
    fixed, due, at = stream.block, 0, stream.body
    while frame := _sync(data, at, stream, fixed):
        later = frame.first > due and ((frame.start, frame.first) in named or _whole(data, frame, stream, fixed))
        if not frames or frame.first == due or later:
            fixed = fixed or frame.size
            if frames:
                frames[-1].end = frame.start
            frames.append(frame)
            due, at = frame.first + frame.size, frame.data
        else:
            at = frame.start + 1
    if frames:
        frames[-1].end = len(data)
    return frames


class _Bits:
    """Bits of one buffer: scalar reads for headers, vector reads at many places."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + bytes(16), np.uint8)
        self.words = np.zeros(len(raw) - 8, np.uint64)
        for i in range(8):
            self.words |= raw[i : len(raw) - 8 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.data = data

    def get(self, at: int, n: int) -> int:
        a, b = at >> 3, (at + n + 7) >> 3
        return int.from_bytes(self.data[a:b].ljust(b - a, b"\0"), "big") >> (8 * b - at - n) & (1 << n) - 1

    def signed(self, at: int, n: int) -> int:
        v = self.get(at, n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self, at: int) -> int:
        n = 0
        while not self.get(at + n, 1):
            n += 1
            if (at + n) >> 3 > len(self.data):
                raise ValueError("no end of a unary code")
        return n


@dataclass
class _Lane:
    """One subframe whose residuals are still to come."""

    pos: int
    size: int
    order: int
    warm: list[int]
    wide: int
    shift: int = 0
    coefs: list[int] | None = None  # None: a fixed predictor
    parts: int = 1
    param_bits: int = 4
    plain: np.ndarray | None = None  # constant and verbatim subframes
    residual: np.ndarray | None = None
    failed: bool = False


def _subframe(bits: _Bits, pos: int, size: int, depth: int) -> _Lane:
    head = bits.get(pos, 8)
    pos += 8
    wasted = 0
    if head & 1:
        wasted = bits.unary(pos) + 1
        pos += wasted
    depth -= wasted
    kind = head >> 1
    if kind == 0:
        return _Lane(pos + depth, size, 0, [], wasted, plain=np.full(size, bits.signed(pos, depth), np.int64))
    if kind == 1:
        values = np.array([bits.signed(pos + i * depth, depth) for i in range(size)], np.int64)
        return _Lane(pos + size * depth, size, 0, [], wasted, plain=values)
    order = kind & 7 if 8 <= kind <= 12 else (kind & 31) + 1 if kind >= 32 else -1
    if order < 0 or order > size:
        raise ValueError("reserved subframe")
    warm = [bits.signed(pos + i * depth, depth) for i in range(order)]
    pos += order * depth
    shift, coefs = 0, None
    if kind >= 32:
        precision, shift = bits.get(pos, 4) + 1, bits.signed(pos + 4, 5)
        coefs = [bits.signed(pos + 9 + i * precision, precision) for i in range(order)]
        pos += 9 + order * precision
    method, p_order = bits.get(pos, 2), bits.get(pos + 2, 4)
    if method > 1 or (size >> p_order << p_order) != size and p_order:
        raise ValueError("reserved residual coding")
    return _Lane(pos + 6, size, order, warm, wasted, shift, coefs, 1 << p_order, 4 + method)


def _scalar_residual(bits: _Bits, lane: _Lane) -> None:
    """Residuals code by code, for partitions with escapes."""
    out, pos = [], lane.pos
    escape = (1 << lane.param_bits) - 1
    for p in range(lane.parts):
        k = bits.get(pos, lane.param_bits)
        pos += lane.param_bits
        count = lane.size // lane.parts - (lane.order if p == 0 else 0)
        if k == escape:
            n = bits.get(pos, 5)
            pos += 5
            out += [bits.signed(pos + i * n, n) for i in range(count)]
            pos += count * n
            continue
        for _ in range(count):
            q = bits.unary(pos)
            u = q << k | bits.get(pos + q + 1, k)
            pos += q + 1 + k
            out.append(u >> 1 ^ -(u & 1))
    lane.residual, lane.pos = np.array(out, np.int64), pos


@lru_cache
def _leading_zeros() -> np.ndarray:
    table = np.full(1 << 16, 16, np.int64)
    for z in range(15, -1, -1):
        table[1 << (15 - z) : 1 << (16 - z)] = z
    return table


def _residuals(bits: _Bits, lanes: list[_Lane]) -> None:
    """Rice codes of all lanes in lockstep; a step decodes the next code of each lane that has one."""
    lanes.sort(key=lambda x: x.order - x.size)
    lengths = np.array([x.size - x.order for x in lanes], np.int64)
    pos = np.array([x.pos for x in lanes], np.int64)
    k = np.zeros(len(lanes), np.int64)
    events: dict[int, list[int]] = {}
    for i, x in enumerate(lanes):
        for p in range(x.parts):
            events.setdefault(max(0, p * (x.size // x.parts) - x.order), []).append(i)
    limit = len(bits.data) * 8
    escaped = np.zeros(len(lanes), bool)
    out = np.zeros((int(lengths[0]) if len(lengths) else 0, len(lanes)), np.int64)
    active = np.searchsorted(-lengths, -np.arange(len(out)), side="left")  # lanes with more than t codes
    zeros, words = _leading_zeros(), bits.words
    one, top = np.uint64(1), np.uint64(48)
    shift = np.zeros(len(lanes), np.uint64)
    for t in range(len(out)):
        m = int(active[t])
        for i in events.get(t, ()):
            if t < lengths[i]:
                k[i] = bits.get(int(pos[i]), lanes[i].param_bits)
                pos[i] += lanes[i].param_bits
                escaped[i] |= k[i] == (1 << lanes[i].param_bits) - 1
                shift[i] = 63 - min(int(k[i]), 63)
        p = pos[:m]
        np.minimum(p, limit, out=p)
        w = words[p >> 3] << (p & 7).astype(np.uint64)
        q = zeros[(w >> top).astype(np.int64)]
        if (q == 16).any() or m and int(k[:m].max()) > 24:
            for i in np.nonzero((q == 16) | (k[:m] > 24))[0].tolist():
                try:
                    n = bits.unary(int(p[i]))
                    out[t, i] = n << int(k[i]) | bits.get(int(p[i]) + n + 1, int(k[i]))
                    q[i] = n
                except ValueError:
                    lanes[i].failed = True
            usual = np.nonzero((q < 16) & (k[:m] <= 24))[0]
            ws, qs = w[usual], q[usual]
            out[t, usual] = qs << k[usual] | (ws << (qs + 1).astype(np.uint64) >> one >> shift[usual]).astype(np.int64)
        else:
            out[t, :m] = (q << k[:m]) | (w << (q + 1).astype(np.uint64) >> one >> shift[:m]).astype(np.int64)
        p += q + 1 + k[:m]
    out = (out >> 1) ^ -(out & 1)
    for i, lane in enumerate(lanes):
        if escaped[i]:
            try:
                _scalar_residual(bits, lane)
            except ValueError:
                lane.failed = True
        else:
            lane.residual, lane.pos = out[: lengths[i], i], int(pos[i])


def _restore(lanes: list[_Lane]) -> list[np.ndarray]:
    """Samples of each lane: sums for fixed predictors, lockstep steps for LPC."""
    made: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lanes)
    linear = []
    for i, x in enumerate(lanes):
        if x.failed or x.plain is None and x.residual is None:
            made[i] = np.zeros(x.size, np.int64)
        elif x.plain is not None:
            made[i] = x.plain << x.wide
        elif x.coefs is None:
            y = x.residual
            levels = [np.array(x.warm, np.int64)]
            for _ in range(1, x.order):
                levels.append(np.diff(levels[-1]))
            for level in reversed(levels[: x.order]):
                y = level[-1] + np.cumsum(y)
            made[i] = np.concatenate([np.array(x.warm, np.int64), y]) << x.wide
        else:
            linear.append(i)
    if linear:
        linear.sort(key=lambda i: -lanes[i].size)
        high = max(lanes[i].order for i in linear)
        longest = lanes[linear[0]].size
        x = np.zeros((high + longest, len(linear)), np.int64)  # lane c holds sample s in row high + s
        res = np.zeros((longest, len(linear)), np.int64)
        coefs = np.zeros((high, len(linear)), np.int64)
        shift, order = np.zeros(len(linear), np.int64), np.zeros(len(linear), np.int64)
        for c, i in enumerate(linear):
            lane = lanes[i]
            x[high : high + lane.order, c] = lane.warm
            res[lane.order : lane.size, c] = lane.residual
            coefs[high - lane.order :, c] = lane.coefs[::-1]
            shift[c], order[c] = lane.shift, lane.order
        sizes = np.array([-lanes[i].size for i in linear])
        for s in range(int(order.min()), longest):
            m = int(np.searchsorted(sizes, -s, side="left"))
            guess = (x[s : s + high, :m] * coefs[:, :m]).sum(axis=0) >> shift[:m]
            x[high + s, :m] = np.where(s >= order[:m], guess + res[s, :m], x[high + s, :m])
        for c, i in enumerate(linear):
            made[i] = x[high : high + lanes[i].size, c] << lanes[i].wide
    return made


def decode_frames(data: bytes, frames: list[Frame], channels: int) -> None:
    """Fill in the samples of the frames and whether their checksums and codes were right."""
    if not frames:
        return
    bits = _Bits(data)
    raw = np.frombuffer(data, np.uint8)
    ends = np.array([f.end for f in frames], np.int64)
    want = raw[ends - 2].astype(np.uint32) << 8 | raw[ends - 1]
    right = crc16_many(raw, np.array([f.start for f in frames], np.int64), ends - 2) == want
    pos = [f.data * 8 for f in frames]
    for f, ok in zip(frames, right.tolist()):
        f.good = ok
    for c in range(channels):
        lanes: list[_Lane] = []
        for i, f in enumerate(frames):
            side = f.assignment == 8 and c == 1 or f.assignment == 9 and c == 0 or f.assignment == 10 and c == 1
            try:
                lane = _subframe(bits, pos[i], f.size, f.bits + side) if f.good else _Lane(0, f.size, 0, [], 0, failed=True)
            except ValueError:
                lane = _Lane(0, f.size, 0, [], 0, failed=True)
            lanes.append(lane)
        _residuals(bits, [x for x in lanes if x.plain is None and not x.failed])
        for i, (f, lane, samples) in enumerate(zip(frames, lanes, _restore(lanes))):
            f.good = f.good and not lane.failed
            f.channels.append(samples)
            pos[i] = lane.pos
    for f in frames:
        if len(f.channels) == 2 and f.assignment >= 8:
            a, b = f.channels
            if f.assignment == 8:
                f.channels = [a, a - b]
            elif f.assignment == 9:
                f.channels = [a + b, b]
            else:
                middle = (a << 1) | (b & 1)
                f.channels = [(middle + b) >> 1, (middle - b) >> 1]


def read_back(streams: list[bytes]) -> Iterator[tuple[int, Stream, list[Frame]]]:
    """(number, stream, frames) in order; at most SLICE bytes or samples are decoded at a time, in lockstep.

    Whoever is done with frames drops their ``channels``.  Frames are placed in ``streams`` as they were found.
    """
    heads = [parse_stream(s) for s in streams]
    todo = [(i, f) for i, (s, h) in enumerate(zip(streams, heads)) for f in find_frames(s, h)]
    at = 0
    while at < len(todo):
        last, size = at, 0
        while last < len(todo) and (last == at or size + max(todo[last][1].size, todo[last][1].end - todo[last][1].start) <= SLICE + FILL):
            size += max(todo[last][1].size, todo[last][1].end - todo[last][1].start)
            last += 1
        group = todo[at:last]
        places = [(f.start, f.data, f.end) for _, f in group]
        whole = b"".join(streams[i][f.start : f.end] for i, f in group)
        moved = 0
        for _, f in group:
            f.start, f.data, f.end = moved, moved + f.data - f.start, moved + f.end - f.start
            moved = f.end
        for channels in {heads[i].channels for i, _ in group}:
            decode_frames(whole, [f for i, f in group if heads[i].channels == channels], channels)
        for (_, f), place in zip(group, places):
            f.start, f.data, f.end = place
        first = 0
        for end in range(1, len(group) + 1):
            if end == len(group) or group[end][0] != group[first][0]:
                yield group[first][0], heads[group[first][0]], [f for _, f in group[first:end]]
                first = end
        at = last


def decode(streams: list[bytes]) -> list[tuple[Stream, list[Frame]]]:
    """All streams and all of their frames."""
    found: list[list[Frame]] = [[] for _ in streams]
    for i, _, frames in read_back(streams):
        found[i] += frames
    return list(zip(map(parse_stream, streams), found))


def pcm(frame: Frame) -> bytes:
    """Interleaved samples: 8-bit ones as unsigned bytes, wider ones as little-endian signed integers."""
    table = np.stack(frame.channels, axis=1)
    if frame.bits <= 8:
        return (table + 128).astype(np.uint8).tobytes()
    size = (frame.bits + 7) // 8
    return table.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def md5_matches(stream: Stream, frames: list[Frame]) -> bool:
    """Whether the decoded samples have the digest that the stream states; none stated counts as a match."""
    if not any(stream.md5):
        return True
    size = (stream.bits + 7) // 8
    digest = hashlib.md5(usedforsecurity=False)
    for f in frames:
        digest.update(np.stack(f.channels, axis=1).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes())
    return digest.digest() == stream.md5


def seek(data: bytes, sample: int) -> tuple[int, bytes]:
    """(first sample, PCM) of the frame that holds ``sample``, read from its seek point on."""
    stream = parse_stream(data)
    offset = max((o for s, o, _ in stream.seek if s <= sample), default=0)
    frames = find_frames(data, Stream(stream.channels, stream.bits, stream.samples, stream.md5, [], stream.body + offset, stream.block))
    own = [f for f in frames if f.first <= sample < f.first + f.size]
    decode_frames(data, own, stream.channels)
    return own[0].first, pcm(own[0])


# ---------------------------------------------------------------------------------- columns


def payload(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each text as a FLAC stream."""

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = texts_as_bytes(column)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())]

    fields = [StructField("n_bytes", LongType()), StructField("media", BinaryType())]
    return map_text(narrow(df, id_col, text_col), ["doc_id"], "text", compute, fields, SLICE)


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: doc_id, block, first_sample, n_samples, channels, bits, verified, pcm (null where not verified)."""
    ship(df.sparkSession)
    media = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{media_col}`").alias("media")).where("media is not null")
    numbers = ["block", "first_sample", "n_samples", "channels", "bits"]
    schema = StructType([media.schema["doc_id"], *(StructField(c, LongType()) for c in numbers), StructField("verified", BooleanType()), StructField("pcm", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, rows, size, blocks = part.column(0), [], 0, {}

                def made() -> pa.RecordBatch:
                    columns = list(zip(*rows)) or [()] * 8
                    arrays = [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:6])]
                    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[6], pa.bool_()), pa.array(columns[7], pa.binary())], schema.names)

                for i, stream, frames in read_back(texts_as_bytes(part.column(1))):
                    for f in frames:
                        rows.append((i, blocks.get(i, 0), f.first, f.size, stream.channels, f.bits, f.good, pcm(f) if f.good else None))
                        blocks[i] = blocks.get(i, 0) + 1
                        size += len(rows[-1][-1] or b"")
                        f.channels = []
                    if size > SLICE:
                        yield made()
                        rows, size = [], 0
                yield made()

    return media.mapInArrow(run, schema)


class _Heard:
    """Digests and features of mono 8-bit samples as they are read back, frame by frame."""

    def __init__(self) -> None:
        self.sha256, self.md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
        self.frames = self.samples = self.peak = self.energy = self.crossings = 0
        self.tail, self.last, self.good = b"", None, True

    def add(self, frame: Frame) -> None:
        x = frame.channels[0]
        back = (x + 128).astype(np.uint8)
        self.sha256.update(back.tobytes())
        self.md5.update((back ^ 0x80).tobytes())
        up = x >= 0
        self.crossings += int((up[1:] != up[:-1]).sum()) + (self.last is not None and bool(up[0]) != self.last)
        self.frames, self.samples, self.last = self.frames + 1, self.samples + len(x), bool(up[-1])
        self.peak, self.energy = max(self.peak, int(np.abs(x).max())), self.energy + int((x * x).sum())
        self.tail = (self.tail + back[-UNIT:].tobytes())[-UNIT:]
        self.good = self.good and frame.good

    def feature(self) -> str:
        return f"frames={self.frames};peak={self.peak};energy={self.energy};crossings={self.crossings}"


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as FLAC, read it back and describe what was read; one row per row of ``df``.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (frames, peak, sum of squares, zero crossings), verified (all CRCs and the MD5).
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = texts_as_bytes(column)
        media = encode([payload(t) for t in texts])
        found = [_Heard() for _ in texts]
        for i, stream, frames in read_back(media):
            for f in frames:
                found[i].add(f)
                f.channels = []
        rows = []
        for text, stored, heard in zip(texts, media, found):
            stream = parse_stream(stored)
            good = heard.good and heard.samples == stream.samples and heard.md5.digest() == stream.md5
            digest = hashlib.sha256(stored).hexdigest()
            rows.append((len(text), heard.samples, heard.sha256.hexdigest(), zlib.crc32(heard.tail), len(stored), digest, heard.feature(), good))
        columns = list(zip(*rows)) or [()] * 8
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))]

    kinds = {"n_bytes": LongType(), "payload_bytes": LongType(), "payload_sha256": StringType(), "tail_crc32": LongType(), "media_bytes": LongType(), "media_sha256": StringType(), "feature": StringType(), "verified": BooleanType()}
    return map_text(narrow(df, id_col, text_col), ["doc_id"], "text", compute, [StructField(n, t) for n, t in kinds.items()], SLICE)
