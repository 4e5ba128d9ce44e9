"""Streams of all forms against a writer of its own, bit by bit, and the module's writers against each other's readers."""

import hashlib
import random

import numpy as np
import pytest

from strandloom.llm import flac


def crc(data: bytes, bits: int, polynomial: int) -> int:
    value = 0
    for byte in data:
        value ^= byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> bits - 1 & 1 else value << 1) & (1 << bits) - 1
    return value


def bits_of(value: int, n: int) -> str:
    return f"{value & (1 << n) - 1:0{n}b}" if n else ""


def stream(frames: list[tuple[int, str, list[str]]], channels: int, bits: int, samples: np.ndarray, block: int = 0) -> bytes:
    """Frames as (size, four bits of the form of channels, subframes as bits); each tells its size in 16 bits."""
    out = b""
    for number, (size, form, subframes) in enumerate(frames):
        top = b"\xff\xf8" + int("0111" + "0000", 2).to_bytes() + int(form + {8: "001", 16: "100"}[bits] + "0", 2).to_bytes() + bytes([number]) + (size - 1).to_bytes(2, "big")
        top += crc(top, 8, 7).to_bytes()
        body = "".join(subframes)
        body += "0" * (-len(body) % 8)
        whole = top + int(body, 2).to_bytes(len(body) // 8)
        out += whole + crc(whole, 16, 0x8005).to_bytes(2)
    raw = samples.T.reshape(-1).astype("<i1" if bits == 8 else "<i2").tobytes()
    info = (block or frames[0][0]).to_bytes(2) * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | bits - 1 << 36 | samples.shape[1]).to_bytes(8) + hashlib.md5(raw).digest()
    return b"fLaC\x80" + len(info).to_bytes(3) + info + out


def verbatim(x, bits: int, wasted: int = 0) -> str:
    return "0000001" + ("1" + "0" * (wasted - 1) + "1" if wasted else "0") + "".join(bits_of(int(v) >> wasted, bits - wasted) for v in x)


@pytest.mark.parametrize("form", ["0001", "1000", "1001", "1010"])
def test_channels(form):
    r = np.random.default_rng(1)
    a, b = r.integers(-3000, 3000, (2, 50))
    sides = {"0001": [(a, 16), (b, 16)], "1000": [(a, 16), (a - b, 17)], "1001": [(a - b, 17), (b, 16)], "1010": [((a + b) >> 1, 16), (a - b, 17)]}[form]
    media = stream([(50, form, [verbatim(x, n) for x, n in sides])], 2, 16, np.stack([a, b]))
    assert (flac.Reader(media).read() == np.stack([a, b])).all()


def test_subframes_and_residual_forms():
    """Constant, wasted bits, a fixed predictor with an escape, two partitions, and five-bit parameters."""
    ramp = np.arange(16) * 3 - 20
    fixed = lambda method, wide, parts: "0" + bits_of(8 + 1, 6) + "0" + bits_of(int(ramp[0]), 8) + bits_of(method, 2) + parts
    rice = lambda values, k: "".join("0" * ((2 * v if v >= 0 else -2 * v - 1) >> k) + "1" + bits_of(2 * v if v >= 0 else -2 * v - 1, k) for v in values)
    steps = np.diff(ramp).tolist()
    frames = [
        (16, "0000", ["0000000" + "0" + bits_of(-7, 8)]),
        (16, "0000", [verbatim(ramp * 4, 8, 2)]),
        (16, "0000", [fixed(0, 4, bits_of(0, 4) + "1111" + bits_of(4, 5) + "".join(bits_of(v, 4) for v in steps))]),
        (16, "0000", [fixed(0, 4, bits_of(1, 4) + bits_of(1, 4) + rice(steps[:7], 1) + bits_of(2, 4) + rice(steps[7:], 2))]),
        (16, "0000", [fixed(1, 5, bits_of(0, 4) + bits_of(3, 5) + rice(steps, 3))]),
    ]
    x = np.concatenate([np.full(16, -7), ramp * 4, ramp, ramp, ramp])[None, :]
    media = stream(frames, 1, 8, x)
    assert (flac.Reader(media).read() == x).all() and (flac.Reader(media).read(20, 50) == x[:, 20:50]).all()
    assert [(at, b.shape[1]) for at, b in flac.pcm_blocks(media, 30)] == [(0, 30), (30, 30), (60, 20)]
    for i in (len(media) - 3, len(media) - 9):
        broken = bytearray(media)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            flac.Reader(bytes(broken)).read()
    with pytest.raises(ValueError):
        flac.Reader(media[:-5]).read()


def test_a_linear_predictor_by_hand():
    """Second-order coefficients 3/2 and -3/4 with a shift of two bits."""
    x = [10, 12]
    residual = [1, -2, 0, 3, -1, 0, 0, 2, -3, 1, 0, 0, 1, 1]
    for e in residual:
        x.append((6 * x[-1] - 3 * x[-2] >> 2) + e)
    code = "".join("0" * ((2 * v if v >= 0 else -2 * v - 1) >> 1) + "1" + bits_of(2 * v if v >= 0 else -2 * v - 1, 1) for v in residual)
    body = "0" + bits_of(32 + 1, 6) + "0" + bits_of(x[0], 8) + bits_of(x[1], 8) + bits_of(3, 4) + bits_of(2, 5) + bits_of(6, 4) + bits_of(-3, 4) + "00" + bits_of(0, 4) + bits_of(1, 4) + code
    whole = np.array([x])
    assert (flac.Reader(stream([(16, "0000", [body])], 1, 8, whole)).read() == whole).all()


@pytest.mark.parametrize("bits,order,seek", [(8, 8, False), (16, 12, True), (16, 1, True), (8, 32, True)])
def test_written_predictors(bits, order, seek):
    r = np.random.default_rng(order)
    t = np.arange(5000)
    top = 1 << bits - 2
    x = np.clip(top * np.sin(t / 9) + top / 3 * np.sin(t / 2.3) + r.normal(0, top / 40, len(t)), -2 * top, 2 * top - 1).astype(np.int64)
    x[2000:3200] = 5
    media = flac.encode_lpc(x, order, 600, bits=bits, seek=seek)
    own = flac.Reader(media)
    assert (own.read()[0] == x).all() and bool(own.points) == seek and len(media) < len(x) * bits // 8
    for lo, hi in ((0, 1), (599, 601), (1234, 4321), (4990, 5000)):
        assert (own.read(lo, hi)[0] == x[lo:hi]).all()


def test_the_fast_reader_and_the_general_one_agree():
    r = random.Random(3)
    payloads = [flac.padded(bytes(r.choice(b"aeinorst. ") for _ in range(r.randint(0, 3000)))) for _ in range(6)] + [flac.padded(bytes(r.randrange(256) for _ in range(2000)))]
    for payload, media in zip(payloads, flac.encode(payloads)):
        assert (flac.Reader(media).read()[0] + 128).astype(np.uint8).tobytes() == payload == flac.decode([media])[0]
        assert (flac.Reader(media).read(100, 300)[0] + 128).astype(np.uint8).tobytes() == payload[100:300] == flac.samples([media], [(100, 300)])[0]


def test_seek_points_for_some_frames_only(monkeypatch):
    """As where a table would be too long for one point for each frame."""
    r = random.Random(5)
    payload = flac.padded(bytes(r.choice(b"ab c") for _ in range(20000)))
    media = flac.encode([payload])[0]
    s = flac.Stream(media)
    assert (flac._between(media, s.start[::4], 4, len(s.start)) == s.start).all()
