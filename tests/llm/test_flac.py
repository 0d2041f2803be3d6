import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import queries
from quern.llm.flac import crc8, crc16_many, decode, encode, md5_matches, media_features, payload, pcm, pcm_blocks, seek, text_media


def crc16(data):
    crc = 0
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1 & 0xFFFF
    return crc


def test_crc16():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 40_000, dtype=np.uint8)
    starts, ends = np.array([0, 5, 100, 7]), np.array([1, 9000, 100 + 8192, 30_007])
    assert crc16_many(raw, starts, ends).tolist() == [crc16(raw[a:b].tobytes()) for a, b in zip(starts, ends)]


@settings(deadline=None, max_examples=25)
@given(st.lists(st.binary(max_size=9000), min_size=1, max_size=5))
def test_round_trip(texts):
    payloads = [payload(t) for t in texts]
    assert all(len(p) % 64 == 0 and p and p.startswith(t) for p, t in zip(payloads, texts))
    media = encode(payloads)
    for p, m, (stream, frames) in zip(payloads, media, decode(media)):
        assert b"".join(map(pcm, frames)) == p
        assert all(f.good for f in frames) and md5_matches(stream, frames) and stream.samples == len(p)
        assert encode([p]) == [m]  # independent of what is encoded beside it


def test_seek():
    p = payload(bytes(range(256)) * 100)
    first, block = seek(encode([p])[0], 20_000)
    assert first <= 20_000 < first + len(block) and p[first : first + len(block)] == block


def test_damage_is_seen():
    m = bytearray(encode([payload(b"some text " * 2000)])[0])
    m[-30] ^= 4
    _, frames = decode([bytes(m)])[0]
    assert [f.good for f in frames].count(False) == 1 and frames[0].good


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def rice(self, r, k):
        u = r << 1 if r >= 0 else (-r << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        while len(self.bits) % 8:
            self.bits.append(0)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def stream_of(frames, channels, depth, samples):
    info = bytes(4) + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def frame(number, size, assignment, subframes):
    head = b"\xff\xf8" + bytes([0x70, assignment << 4]) + bytes([number]) + (size - 1).to_bytes(2, "big")
    head += bytes([crc8(head)])
    w = BitWriter()
    for write in subframes:
        write(w)
    body = head + w.bytes()
    return body + crc16(body).to_bytes(2, "big")


def lpc(x, depth, coefs, shift, precision, k, parts=0):
    order = len(coefs)

    def write(w):
        w.put((32 | (order - 1)) << 1, 8)
        for v in x[:order]:
            w.put(v & (1 << depth) - 1, depth)
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for c in coefs:
            w.put(c & (1 << precision) - 1, precision)
        w.put(0, 2)
        w.put(parts, 4)
        res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(x))]
        size = len(x) >> parts
        at = 0
        for p in range(1 << parts):
            count = size - (order if p == 0 else 0)
            own = res[at : at + count]
            at += count
            if p == 1:  # an escape: raw residuals
                w.put(15, 4)
                w.put(20, 5)
                for r in own:
                    w.put(r & (1 << 20) - 1, 20)
            else:
                w.put(k, 4)
                for r in own:
                    w.rice(r, k)

    return write


def test_linear_prediction_stereo_constant_verbatim_and_escapes():
    rng = np.random.default_rng(2)
    t = np.arange(256)
    left = (1000 * np.sin(t / 9) + rng.integers(-20, 20, 256)).astype(int).tolist()
    right = [v + int(d) for v, d in zip(left, rng.integers(-9, 9, 256))]
    side = [a - b for a, b in zip(left, right)]

    def verbatim(x, depth):
        def write(w):
            w.put(1 << 1, 8)
            for v in x:
                w.put(v & (1 << depth) - 1, depth)

        return write

    def constant(v, depth):
        def write(w):
            w.put(0, 8)
            w.put(v & (1 << depth) - 1, depth)

        return write

    def wasted(x, depth, by):
        def write(w):
            w.put(1 << 1 | 1, 8)
            w.put(1, by)
            for v in x:
                w.put(v >> by & (1 << (depth - by)) - 1, depth - by)

        return write

    frames = [
        frame(0, 256, 1, [lpc(left, 16, [1800, -800], 10, 12, 6), lpc(right, 16, [3, -3, 1], 0, 4, 7, parts=2)]),
        frame(1, 256, 8, [verbatim(left, 16), lpc(side, 17, [1], 0, 4, 3)]),
        frame(2, 256, 1, [constant(-7, 16), wasted([v * 8 for v in range(256)], 16, 3)]),
    ]
    (stream, found), = decode([stream_of(frames, 2, 16, 768)])
    assert [f.good for f in found] == [True] * 3 and [f.first for f in found] == [0, 256, 512]
    assert [c.tolist() for c in found[0].channels] == [left, right]
    assert [c.tolist() for c in found[1].channels] == [left, right]
    assert [c.tolist() for c in found[2].channels] == [[-7] * 256, [v * 8 for v in range(256)]]
    assert np.frombuffer(pcm(found[0]), "<i2").reshape(-1, 2)[:, 1].tolist() == right


def test_middle_and_side():
    left, right = [5, -8, 100, 7] * 16, [4, 9, -3, 7] * 16
    middle, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]

    def verbatim(x, depth):
        def write(w):
            w.put(2, 8)
            for v in x:
                w.put(v & (1 << depth) - 1, depth)

        return write

    (_, (f,)), = decode([stream_of([frame(0, 64, 10, [verbatim(middle, 16), verbatim(side, 17)])], 2, 16, 64)])
    assert [c.tolist() for c in f.channels] == [left, right]


def test_query_against_definition(spark, sf, texts):
    rows = queries.op10_flac(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        p = payload(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["verified"]


def test_blocks_and_odd_rows(odd, plain, empty):
    rows = plain.collect()
    media = text_media(odd)
    blocks = pcm_blocks(media).collect()
    assert all(b["verified"] for b in blocks)
    assert sum(b["n_samples"] for b in blocks) == sum(len(payload((r["text"] or "").encode())) for r in rows)
    assert media_features(odd).count() == len(rows)
    assert media_features(empty).count() == 0 and pcm_blocks(text_media(empty)).count() == 0
    with pytest.raises(ValueError):
        decode([b"RIFF"])


def test_long_texts_in_bounded_parts(spark, monkeypatch):
    """Parts of any size give the same stream; a long text needs little memory beside it."""
    from quern.llm import flac

    rng = np.random.default_rng(2)
    payloads = [payload(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 10, 5000, 40_000, 100_000)]
    whole = encode(payloads)
    monkeypatch.setattr(flac, "SLICE", 8192)
    monkeypatch.setattr(flac, "FILL", 64)
    assert encode(payloads) == whole
    for p, (stream, frames) in zip(payloads, decode(whole)):
        assert b"".join(map(pcm, frames)) == p and md5_matches(stream, frames)


def test_a_false_sync_inside_a_frame_is_passed_over():
    p = payload(bytes(range(256)) * 200)
    m = bytearray(encode([p])[0])
    stream = decode([bytes(m)])[0][0]
    from quern.llm.flac import find_frames

    frames = find_frames(bytes(m), stream)
    inside, later = frames[2].data + 40, frames[7]
    m[inside : inside + 8] = m[later.start : later.start + 8]  # a right header of a later frame
    found = find_frames(bytes(m), stream)
    assert [f.first for f in found] == [f.first for f in frames]
    assert [f.good for f in decode([bytes(m)])[0][1]] == [i != 2 for i in range(len(frames))]


def test_memory_of_a_long_text():
    import subprocess
    import sys

    code = """
import resource
from quern.llm.flac import _Heard, encode, payload, read_back
text = b"a long text of 24 million bytes " * 750_000
media = encode([payload(text)])
heard = _Heard()
for _, stream, frames in read_back(media):
    for f in frames:
        heard.add(f)
        f.channels = []
assert heard.samples == len(text) and heard.good and heard.md5.digest() == stream.md5
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1200
