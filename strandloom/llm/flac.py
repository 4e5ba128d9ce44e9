"""Bytes kept losslessly as FLAC: 8-bit mono samples in frames of 576, fixed linear predictors, Rice residuals, checksums, a seek table.

Many frames of many streams are coded at once: every step below works on arrays with a row for each frame. The seek table has a point
for each frame, so a reader can begin at any sample and frames can be decoded side by side. Decoding goes through the 576
codes of all frames in step: each frame has its own bit position, the unary part comes from a count of leading zeros.
Header (CRC-8) and frame (CRC-16) checksums and the MD5 of the samples are verified; a difference raises ValueError.

Streams from elsewhere are read too, a frame at a time (`Reader`): linear predictors of any order, partitioned Rice residuals of both forms with their escapes, constant and verbatim subframes, wasted bits, any block size, sample size and
number of channels, with the stereo forms, and with or without seek points, which lead to the frame of a sample where there are some. `encode_lpc` writes such streams (Levinson-Durbin predictors with quantised coefficients, the best partition order);
op8 stores with fixed predictors, which are the linear predictors that need no coefficients: bytes of text are predicted no better by longer ones.

A sample is a byte minus 128. A text's payload is its UTF-8 bytes, with bytes 255 appended up to a positive multiple of 576.
Null text is empty: one frame of 255. Texts are kept whole, however long. Equal texts have equal values; repeated rows give repeated results; a null doc_id is kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import prepare, table

BLOCK, RATE, SLICE = 576, 16_000, 1 << 20
_MAGIC, _INFO, _SEEK, _POINT = b"fLaC", 34, 3, 18


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    found = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        found = np.where(found >> (bits - 1) & 1, found << 1 ^ polynomial, found << 1) & ((1 << bits) - 1)
    return found.astype(np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_ZEROS = np.array([16, *(15 - int(i).bit_length() + 1 for i in range(1, 1 << 16))], np.int64)


def _crc8(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    found = np.zeros(len(start), np.uint8)
    for i in range(int(size.max(initial=0))):
        at = i < size
        found[at] = _CRC8[found[at] ^ data[start[at] + i]]
    return found


def _crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of ranges of bytes, all ranges in step; the shorter ones leave first."""
    order = np.argsort(-size, kind="stable")
    begins, sizes = start[order], size[order]
    found = np.zeros(len(start), np.uint16)
    live = len(start) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
    for i, n in enumerate(live.tolist()):
        x = found[:n]
        found[:n] = (x << np.uint16(8)) ^ _CRC16[(x >> np.uint16(8)) ^ data[begins[:n] + i]]
    out = np.empty_like(found)
    out[order] = found
    return out


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form of frame headers: a row of up to 6 bytes each, and sizes."""
    size = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        at = size == s
        if at.any():
            x = n[at]
            for i in range(s - 1, 0, -1):
                out[at, i] = 0x80 | x & 0x3F
                x = x >> 6
            out[at, 0] = x if s == 1 else (0xFF << (8 - s) & 0xFF) | x
    return out, size


def _residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the best fixed predictor of each frame, and residuals (the first `order` columns are samples)."""
    best, cost, order, r = x.copy(), np.abs(x[:, 4:]).sum(axis=1), np.zeros(len(x), np.int64), x
    for o in range(1, 5):
        r = r.copy()
        r[:, o:] = r[:, o:] - r[:, o - 1 : -1]
        r[:, :o] = x[:, :o]
        full = np.diff(x, o, axis=1)
        r[:, o:] = full
        c = np.abs(full[:, 4 - o :]).sum(axis=1)
        better = c < cost
        best[better], cost, order = r[better], np.where(better, c, cost), np.where(better, o, order)
    return order, best


def encode_frames(payload: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of payload (frames x 576 bytes) with their numbers within their streams: all bytes, and sizes."""
    frames = len(payload)
    x = payload.astype(np.int32) - 128
    order, r = _residuals(x)
    code = (r << 1 ^ r >> 31).astype(np.int64)  # signs in the lowest bit
    warm = np.arange(BLOCK) < order[:, None]
    code[warm] = 0
    mean = code.sum(axis=1) / (BLOCK - order)
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 13).astype(np.int64)
    options = np.stack([np.clip(guess + d, 0, 14) for d in (0, 1)])
    bits = np.stack([(code >> k[:, None]).sum(axis=1) + (BLOCK - order) * (k + 1) for k in options])
    k = np.where(bits[1] < bits[0], options[1], options[0])
    size = 8 + 8 * order + 10 + bits.min(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (size >= 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    size = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, size))
    coded, coded_size = _number(number)
    head = 4 + coded_size + 1
    length = head + (size + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(start[-1], np.uint8)
    start = start[:-1]
    for i, value in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        out[start + i] = value
    for i in range(6):
        at = i < coded_size
        out[start[at] + 4 + i] = coded[at, i]
    out[start + head - 1] = _crc8(out, start, head - 1)
    body = start + head
    out[body] = np.where(constant, 0, np.where(verbatim, 2, 8 + order << 1))
    out[body[constant] + 1] = payload[constant, 0] ^ 0x80
    if verbatim.any():
        out[body[verbatim][:, None] + 1 + np.arange(BLOCK)] = payload[verbatim] ^ 0x80
    if rice.any():
        f = np.flatnonzero(rice)
        for i in range(4):
            at = f[order[f] > i]
            out[body[at] + 1 + i] = payload[at, i] ^ 0x80
        # From here on single bits, of these frames only, side by side.
        begin = body[f] + 1 + order[f]
        room = (10 + bits.min(axis=0)[f] + 7) // 8
        first = np.concatenate(([0], np.cumsum(room * 8)))
        bit = np.zeros(first[-1], np.uint8)
        for i in range(4):
            bit[first[:-1] + 6 + i] = k[f] >> (3 - i) & 1
        kk = np.broadcast_to(k[f][:, None], (len(f), BLOCK))
        c, cold = code[f], ~warm[f]
        q = c >> kk
        width = np.where(cold, q + 1 + kk, 0)
        ends = np.cumsum(width, axis=1) + (first[:-1] + 10)[:, None]
        stop = (ends - kk - 1)[cold]
        bit[stop] = 1
        c, kk = c[cold], kk[cold]
        for j in range(int(k[f].max())):
            at = kk > j
            bit[stop[at] + kk[at] - j] = c[at] >> j & 1
        packed = np.packbits(bit)
        to = np.repeat(begin - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(len(packed))
        out[to] = packed
    crc = _crc16(out, start, length - 2)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 0xFF
    return out, length


def head(payload: bytes, sizes: np.ndarray) -> bytes:
    """Stream head: marker, stream information, seek table."""
    n = len(payload)
    digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    packed = RATE << 44 | 0 << 41 | 7 << 36 | n
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
    every = -(-len(sizes) * _POINT // ((1 << 24) - _POINT))  # a table holds 932,067 points; of longer streams every second, third … frame has one
    points = np.zeros(len(sizes), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"], points["offset"], points["samples"] = np.arange(len(sizes)) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    table_ = points[::every].tobytes()
    return _MAGIC + bytes([0]) + _INFO.to_bytes(3, "big") + info + bytes([0x80 | _SEEK]) + len(table_).to_bytes(3, "big") + table_


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose sizes are positive multiples of 576."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    number = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
    parts = [encode_frames(x, number[lo : lo + len(x)]) for lo in range(0, len(number), SLICE // BLOCK) for x in [np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)[lo : lo + SLICE // BLOCK]]]
    data, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    edge, ends, frame = np.concatenate(([0], np.cumsum(sizes))), np.cumsum(counts), 0
    out = []
    for payload, end in zip(payloads, ends):
        out.append(head(payload, sizes[frame:end]) + data[edge[frame] : edge[end]].tobytes())
        frame = end
    return out


def rice_partitions(r: list[int], order: int, most: int = 6) -> tuple[int, str]:
    """The partition order that takes the fewest bits, and the residuals (after `order` warm-up samples of a block of order + len(r)) as bits."""
    n = order + len(r)
    code = [x << 1 if x >= 0 else -2 * x - 1 for x in r]
    best = None
    for p in range(most + 1):
        if n % (1 << p) or n >> p <= order:
            break
        bits, at = [], 0
        for part in range(1 << p):
            size = (n >> p) - (order if not part else 0)
            own = code[at : at + size]
            at += size
            k = min(range(15), key=lambda k: sum(c >> k for c in own) + size * (k + 1))
            signed = max((c + 1 >> 1).bit_length() + 1 for c in own) if any(own) else 0
            if size * signed + 5 < sum(c >> k for c in own) + size * (k + 1):  # an escape: values as they are
                bits.append("1111" + f"{signed:05b}" + ("".join(f"{(c >> 1 if c % 2 == 0 else -(c + 1 >> 1)) & (1 << signed) - 1:0{signed}b}" for c in own) if signed else ""))
            else:
                bits.append(f"{k:04b}" + "".join("0" * (c >> k) + "1" + (f"{c & (1 << k) - 1:0{k}b}" if k else "") for c in own))
        whole = f"00{p:04b}" + "".join(bits)
        if best is None or len(whole) < len(best[1]):
            best = (p, whole)
    return best


def predictor(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int]:
    """Coefficients of the linear predictor of an order by Levinson-Durbin on the windowed autocorrelation, as whole numbers, and the shift that they are divided by."""
    y = x * np.hanning(len(x) + 2)[1:-1]
    auto = np.array([float((y[: len(y) - i] * y[i:]).sum()) for i in range(order + 1)])
    a, error = np.zeros(order), auto[0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (auto[i + 1] - (a[:i] * auto[i:0:-1]).sum()) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error *= 1 - k * k
        if error <= 0:
            break
    top = np.abs(a).max(initial=0)
    shift = int(np.clip(precision - 1 - (np.frexp(top)[1] if top else 0), 0, 15))
    limit = (1 << precision - 1) - 1
    return [int(v) for v in np.clip(np.round(a * (1 << shift)), -limit - 1, limit)], shift


def encode_lpc(samples_: np.ndarray, order: int = 8, block: int = 1152, precision: int = 12, bits: int = 8, seek: bool = False) -> bytes:
    """A mono stream of signed samples with subframes of linear predictors, the last block as short as it is."""
    frames = []
    for number, lo in enumerate(range(0, len(samples_), block)):
        x = samples_[lo : lo + block].astype(np.int64)
        own = min(order, len(x) - 1)
        if own < 1 or (x == x[0]).all():
            body = "0" + f"{0:06b}" + "0" + f"{int(x[0]) & (1 << bits) - 1:0{bits}b}" if (x == x[0]).all() else ""
        else:
            weights, shift = predictor(x.astype(float), own, precision)
            predicted = np.array([sum(w * int(v) for w, v in zip(weights, x[i - own : i][::-1])) >> shift for i in range(own, len(x))])
            residual = (x[own:] - predicted).tolist()
            body = "0" + f"{32 + own - 1:06b}" + "0" + "".join(f"{int(v) & (1 << bits) - 1:0{bits}b}" for v in x[:own]) + f"{precision - 1:04b}" + f"{shift:05b}" + "".join(f"{w & (1 << precision) - 1:0{precision}b}" for w in weights) + rice_partitions(residual, own)[1]
        coded, size = _number(np.array([number]))
        top = bytes([0xFF, 0xF8, 0x70, {8: 0x02, 12: 0x04, 16: 0x08}[bits]]) + coded[0, : int(size[0])].tobytes() + (len(x) - 1).to_bytes(2, "big")
        top += bytes([int(_crc8(np.frombuffer(top, np.uint8), np.array([0]), np.array([len(top)]))[0])])
        body += "0" * (-len(body) % 8)
        whole = top + int(body, 2).to_bytes(len(body) // 8, "big")
        frames.append(whole + int(_crc16(np.frombuffer(whole, np.uint8), np.array([0]), np.array([len(whole)]))[0]).to_bytes(2, "big"))
    wide = (bits + 7) // 8
    digest = hashlib.md5(samples_.astype({1: "<i1", 2: "<i2"}[wide]).tobytes()).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (RATE << 44 | bits - 1 << 36 | len(samples_)).to_bytes(8, "big") + digest
    sizes = np.cumsum([0, *map(len, frames)])
    points = b"".join((i * block).to_bytes(8, "big") + int(sizes[i]).to_bytes(8, "big") + min(block, len(samples_) - i * block).to_bytes(2, "big") for i in range(0, len(frames), 3)) if seek else b""
    return _MAGIC + bytes([0 if seek else 0x80]) + _INFO.to_bytes(3, "big") + info + (bytes([0x80 | _SEEK]) + len(points).to_bytes(3, "big") + points if seek else b"") + b"".join(frames)


class Reader:
    """A stream of any form, read a frame at a time: rate, channels, bits and samples (0 if the stream doesn't tell) of its head, and `frames`."""

    _FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]

    def __init__(self, media: bytes):
        if media[:4] != _MAGIC:
            raise ValueError("not a FLAC stream")
        self.media, at, last, self.points = media, 4, False, []
        while not last:
            kind, size, last = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big"), bool(media[at] & 0x80)
            block = media[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block, self.longest = int.from_bytes(block[2:4], "big"), int.from_bytes(block[7:10], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == _SEEK:
                found = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big")) for i in range(0, size, _POINT)]
                self.points = [p for p in found if p[0] != (1 << 64) - 1]  # all ones are a place held free
            at += 4 + size
        self.first = at

    def frame(self, at: int) -> tuple[int, np.ndarray, int]:
        """The frame at a place: its first sample, samples (channels x block), and the place after it."""
        data = self.media
        if len(data) - at < 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            raise ValueError("no frame here")
        variable, size_code, rate_code, form, bit_code = data[at + 1] & 1, data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
        lead = data[at + 4]
        more = 0 if lead < 0x80 else 7 - (~lead & 0xFF).bit_length()
        number = lead if not more else lead & (1 << 6 - more) - 1
        p = at + 5
        for _ in range(more):
            number, p = number << 6 | data[p] & 0x3F, p + 1
        wide = {6: 1, 7: 2}.get(size_code, 0)
        size = int.from_bytes(data[p : p + wide], "big") + 1 if wide else 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
        p += wide + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if int(_crc8(np.frombuffer(data, np.uint8), np.array([at]), np.array([p - at]))[0]) != data[p]:
            raise ValueError("a frame header's CRC-8 differs")
        bits = {0: self.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bit_code]
        p += 1
        room = data[p : p + (self.longest or (size * (bits + 1) * self.channels // 8 + 4096) * 2)]
        self.text, self.at = bin(int.from_bytes(b"\1" + room, "big"))[3:], 0
        count = form + 1 if form < 8 else 2
        if form > 10:
            raise ValueError("a reserved form of channels")
        x = [self._subframe(size, bits + (form in (8, 10) and c == 1 or form == 9 and c == 0)) for c in range(count)]
        if form == 8:
            x[1] = x[0] - x[1]
        elif form == 9:
            x[0] = x[0] + x[1]
        elif form == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [mid + x[1] >> 1, mid - x[1] >> 1]
        end = p + -(-self.at // 8)
        if int(_crc16(np.frombuffer(data, np.uint8), np.array([at]), np.array([end - at]))[0]) != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError("a frame's CRC-16 differs")
        return number if variable else number * self.block, np.stack(x), end + 2

    def _take(self, n: int, signed: bool = False) -> int:
        if self.at + n > len(self.text):
            raise ValueError("a frame ends early")
        value = int(self.text[self.at : self.at + n], 2) if n else 0
        self.at += n
        return value - (1 << n) if signed and n and value >> n - 1 else value

    def _unary(self) -> int:
        end = self.text.find("1", self.at)
        if end < 0:
            raise ValueError("a frame ends early")
        n, self.at = end - self.at, end + 1
        return n

    def _subframe(self, size: int, bits: int) -> np.ndarray:
        self._take(1)
        kind = self._take(6)
        wasted = self._unary() + 1 if self._take(1) else 0
        bits -= wasted
        if kind == 0:
            x = [self._take(bits, True)] * size
        elif kind == 1:
            x = [self._take(bits, True) for _ in range(size)]
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            x = [self._take(bits, True) for _ in range(order)]
            weights, shift = self._FIXED[order] if kind < 32 else [], 0
            if kind >= 32:
                precision = self._take(4) + 1
                shift = self._take(5, True)
                weights = [self._take(precision, True) for _ in range(order)]
            for r in self._residuals(size, order):
                predicted = sum(w * v for w, v in zip(weights, reversed(x[len(x) - order :]))) if order else 0
                x.append((predicted >> shift if shift >= 0 else predicted << -shift) + r)
        else:
            raise ValueError("a reserved form of subframe")
        return np.array(x, np.int64) << wasted

    def _residuals(self, size: int, order: int) -> Iterator[int]:
        method = self._take(2)
        if method > 1:
            raise ValueError("a reserved form of residuals")
        wide, parts = 4 + method, 1 << self._take(4)
        for part in range(parts):
            k = self._take(wide)
            n = size // parts - (order if not part else 0)
            if k == (1 << wide) - 1:
                raw = self._take(5)
                yield from (self._take(raw, True) for _ in range(n))
            else:
                for _ in range(n):
                    q = self._unary() << k | self._take(k)
                    yield q >> 1 ^ -(q & 1)

    def frames(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(first sample, channels x samples) of the frames that hold samples lo to hi; the last seek point that isn't beyond lo leads there."""
        at = self.first + max((offset for sample, offset in self.points if sample <= lo), default=0)
        while at < len(self.media):
            begin, x, at = self.frame(at)
            if hi is not None and begin >= hi:
                break
            if begin + x.shape[1] > lo:
                yield begin, x

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Samples lo to hi (channels x samples), and of a whole stream the MD5 verified."""
        found = [x[:, max(0, lo - begin) : (hi if hi is not None else begin + x.shape[1]) - begin] for begin, x in self.frames(lo, hi)]
        x = np.concatenate(found, axis=1) if found else np.zeros((self.channels, 0), np.int64)
        if not lo and hi is None and any(self.md5):
            wide = (self.bits + 7) // 8
            raw = x.T.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
            if hashlib.md5(raw).digest() != self.md5:
                raise ValueError("the samples' MD5 differs")
        return x


def pcm_blocks(media: bytes, block: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of PCM samples of any stream: offset of the first sample, and channels x samples."""
    held, at = None, 0
    for _, x in Reader(media).frames():
        held = x if held is None else np.concatenate([held, x], axis=1)
        while held.shape[1] >= block:
            yield at, held[:, :block]
            held, at = held[:, block:], at + block
    if held is not None and held.shape[1]:
        yield at, held


class Stream:
    """A stored stream's head: samples, MD5, and the place of each frame from the seek table."""

    def __init__(self, media: bytes):
        if media[:4] != _MAGIC:
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, None
        while not last:
            kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            last = bool(media[at] & 0x80)
            block = media[at + 4 : at + 4 + size]
            if kind == 0:
                self.samples, self.md5 = int.from_bytes(block[10:18], "big") & (1 << 36) - 1, block[18:34]
            elif kind == _SEEK:
                points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
            at += 4 + size
        if points is None:
            raise ValueError("no seek table")
        frames = self.samples // BLOCK
        every = -(-frames // max(1, len(points)))
        self.start = points["offset"].astype(np.int64) + at
        if every > 1:  # the frames between two points follow each other
            self.start = _between(media, self.start, every, frames)
        self.end = np.append(self.start[1:], len(media))


def _between(media: bytes, start: np.ndarray, every: int, frames: int) -> np.ndarray:
    """Places of all frames from those of every so many: each is found by its number and its header's checksum."""
    out = np.empty(frames, np.int64)
    data = np.frombuffer(media, np.uint8)
    for first, at in enumerate(start.tolist()):
        for number in range(first * every, min(frames, (first + 1) * every)):
            if number > first * every:
                coded, size = _number(np.array([number]))
                head_ = b"\xff\xf8\x20\x02" + coded[0, : int(size[0])].tobytes()
                head_ += bytes([int(_crc8(np.frombuffer(head_, np.uint8), np.array([0]), np.array([len(head_)]))[0])])
                at = media.index(head_, at + 1)
                while True:  # what looks like a header in a frame's data isn't one if the frame before doesn't end there
                    last = int(out[number - 1])
                    if int(_crc16(data, np.array([last]), np.array([at - 2 - last]))[0]) == int.from_bytes(media[at - 2 : at], "big"):
                        break
                    at = media.index(head_, at + 1)
            out[number] = at
    return out


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples as bytes (frames x 576) of frames at start..end of data."""
    frames = len(start)
    if _crc16(data, start, end - start - 2).tolist() != (data[end - 2].astype(np.int64) << 8 | data[end - 1]).tolist():
        raise ValueError("a frame's CRC-16 differs")
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x20).any() or (data[start + 3] != 0x02).any():
        raise ValueError("a frame of another form")
    lead = data[start + 4].astype(np.int64)
    size = np.where(lead < 0x80, 1, 8 - np.ceil(np.log2(256 - lead + 0.0)).astype(np.int64))
    if (_crc8(data, start, 4 + size) != data[start + 4 + size]).any():
        raise ValueError("a frame header's CRC-8 differs")
    body = start + 4 + size + 1
    kind = data[body] >> 1
    x = np.zeros((frames, BLOCK), np.int32)
    at = np.flatnonzero(kind == 0)
    x[at] = data[body[at] + 1].astype(np.int8)[:, None]
    at = np.flatnonzero(kind == 1)
    x[at] = data[body[at][:, None] + 1 + np.arange(BLOCK)].astype(np.int8)
    at = np.flatnonzero((kind >= 8) & (kind <= 12))
    if len(at) + (kind < 2).sum() != frames:
        raise ValueError("a subframe of another form")
    if len(at):
        order = kind[at].astype(np.int64) - 8
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(data) + 3
        window = wide[:n] << np.uint64(32) | wide[1 : n + 1] << np.uint64(24) | wide[2 : n + 2] << np.uint64(16) | wide[3 : n + 3] << np.uint64(8) | wide[4 : n + 4]  # 40 bits from each byte on
        window = window.astype(np.int64)
        first = body[at] + 1 + order
        k = (window[first] >> 30 & 15).astype(np.int64)
        if (window[first] >> 34 & 63).any() or (k == 15).any():
            raise ValueError("residuals of another form")
        p, mask = first * 8 + 10, (1 << k) - 1
        r = np.zeros((BLOCK, len(at)), np.int32)
        for i in range(BLOCK):
            if i < 4:
                r[i] = data[body[at] + 1 + np.minimum(i, 3)].astype(np.int8)
                live = i >= order
                if not live.any():
                    continue
            else:
                live = None
            top = window[p >> 3] << (p & 7) >> 8 & 0xFFFFFFFF
            q = _ZEROS[top >> 16]
            low = q == 16
            if low.any():
                q = np.where(low, 16 + _ZEROS[top & 0xFFFF], q)
                while (more := (q % 32 == 0) & (q > 0)).any():  # a unary part of 32 zeros or more
                    at_ = p + q
                    t = window[at_ >> 3] << (at_ & 7) >> 8 & 0xFFFFFFFF
                    add = np.where(t >> 16 > 0, _ZEROS[t >> 16], 16 + _ZEROS[t & 0xFFFF])
                    q = np.where(more, q + add, q)
                    if not (more & (add == 32)).any():
                        break
            after = p + q + 1
            value = q << k | (window[after >> 3] >> (40 - (after & 7) - k) & mask)
            value = value >> 1 ^ -(value & 1)
            if live is None:
                r[i], p = value, after + k
            else:
                r[i], p = np.where(live, value, r[i]), np.where(live, after + k, p)
        r = r.T
        for o in range(1, 5):
            of = np.flatnonzero(order == o)
            if len(of):
                y = r[of]
                heads = [np.diff(y[:, : j + 1], j, axis=1)[:, 0] for j in range(o)]
                for j in range(o - 1, -1, -1):
                    y[:, j] = heads[j]
                    y[:, j:] = np.cumsum(y[:, j:], axis=1)
                r[of] = y
        x[at] = r
    return (x + 128).astype(np.uint8)


def decode(medias: list[bytes]) -> list[bytes]:
    """The payload of each stream of this module's form, with every checksum verified; Reader reads others."""
    streams = [Stream(m) for m in medias]
    base = np.cumsum([0, *map(len, medias)])
    data = np.frombuffer(b"".join(medias), np.uint8)
    start = np.concatenate([s.start + b for s, b in zip(streams, base)])
    end = np.concatenate([s.end + b for s, b in zip(streams, base)])
    step = SLICE // BLOCK
    parts = []
    for lo in range(0, len(start), step):
        a, b = start[lo : lo + step], end[lo : lo + step]
        parts.append(decode_frames(data[a[0] : b[-1]], a - a[0], b - a[0]))
    x, frame, out = np.concatenate(parts), 0, []
    for s in streams:
        mine = x[frame : frame + s.samples // BLOCK]
        frame += len(mine)
        if hashlib.md5((mine ^ 0x80).tobytes()).digest() != s.md5:
            raise ValueError("the samples' MD5 differs")
        out.append(mine.tobytes())
    return out


def samples(medias: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """Bytes lo to hi of each stream's payload: the seek table leads to the frames that hold them, and only these are decoded, side by side."""
    parts, sizes, firsts, counts = [], [], [], []
    for media, (lo, hi) in zip(medias, ranges):
        s = Stream(media)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        parts.append(media[s.start[a] : s.end[b - 1]])
        sizes.append(s.end[a:b] - s.start[a:b])
        firsts.append(lo - a * BLOCK)
        counts.append(b - a)
    end = np.cumsum(np.concatenate(sizes))
    found = decode_frames(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], end[:-1])), end)
    at = np.concatenate(([0], np.cumsum(counts)))
    return [found[at[i] : at[i + 1]].tobytes()[first : first + hi - lo] for i, (first, (lo, hi)) in enumerate(zip(firsts, ranges))]


def feature(payload: bytes) -> str:
    """Sum, energy, sign changes and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def _run(with_media: bool):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                    size += len(texts[hi])
                    hi += 1
                medias = encode([padded(t) for t in texts[lo:hi]])
                payloads = decode(medias)
                tails = samples(medias, [(len(x) - 32, len(x)) for x in payloads])
                for t, media, back, tail in zip(texts[lo:hi], medias, payloads, tails):
                    rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature(back), media if with_media else None))
                lo = hi
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            n = 8 if with_media else 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(n))], names[: n + 1])

    return run


def media(documents: DataFrame, stored: bool = False) -> DataFrame:
    """Documents to their stored form and what is read back from it; with `stored` also the bytes (media)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(_run(stored), schema + ", media binary" * stored)


def op8_flac_media(spark, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))


QUERIES = {"op8_flac_media": op8_flac_media}
