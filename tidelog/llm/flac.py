"""FLAC as a column: encode samples, decode Rice residuals and linear predictors, verify checksums, write PCM blocks.

Encoding makes mono, fixed-block streams (STREAMINFO with MD5, a SEEKTABLE, frames with CRC-8 and CRC-16) and chooses a
constant, verbatim, fixed-predictor or LPC subframe per frame. Decoding runs all frames of a batch in lockstep: one numpy step
reads the next residual of every frame, so there is no Python loop over samples. What the lockstep form does not take
(other block strategies, several channels, wasted bits, partitioned or escaped residuals) goes through a decoder
that walks the stream bit by bit; the two also check each other in the tests.

Defined results: a null payload is empty; a frame whose CRC, number or length is wrong raises FlacError with the sample offset; an
empty or null stream has no frames and gives no PCM block. Streams of any length are decoded in slices of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.textops import streamed

BLOCK, RATE, PRECISION, ORDER, SHIFT = 192, 8000, 8, 4, 6
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SEEK_EVERY = 64
LANES = 4096
_U = np.uint64


class FlacError(ValueError):
    pass


def _table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


_CRC8 = _table(0x07, 8)
_CRC16 = _table(0x8005, 16)
_PAIRS = np.arange(1 << 16)
_CRC16_PAIR = (((_CRC16[_PAIRS >> 8] << 8) & 0xFFFF) ^ _CRC16[((_CRC16[_PAIRS >> 8] >> 8) ^ (_PAIRS & 255))]).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(_CRC16[(c >> 8) ^ b])
    return c


def _crc16_many(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[start:end] for many ranges at once; leading zeros change nothing, so ranges are aligned at their ends."""
    n = int((end - start).max(initial=0))
    n += n & 1
    at = end - n
    crc = np.zeros(len(start), np.uint16)
    padded = np.concatenate((np.zeros(n + 2, np.uint8), buf))
    pair = (padded[:-1].astype(np.uint16) << np.uint16(8)) | padded[1:]
    for j in range(0, n, 2):
        p = at + j
        two = pair[p + n + 2]
        inside = p >= start
        if not inside.all():
            two = np.where(inside, two, np.where(p + 1 >= start, two & np.uint16(255), np.uint16(0)))
        crc = _CRC16_PAIR[crc ^ two]
    return crc


def _number(n: int) -> bytes:
    """A frame number as FLAC codes it (UTF-8 up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    count = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    tail = [0x80 | n >> 6 * k & 0x3F for k in range(count - 1)]
    head = (0xFF00 >> count) & 0xFF | n >> 6 * (count - 1)
    return bytes([head, *reversed(tail)])


_HEADERS: dict[int, bytes] = {}


def _header(n: int) -> bytes:
    found = _HEADERS.get(n)
    if found is None:
        h = b"\xff\xf8\x14\x02" + _number(n)
        found = h + bytes([crc8(h)])
        if len(_HEADERS) < 65_536:
            _HEADERS[n] = found
    return found


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients (frames x ORDER, scaled by 2^SHIFT) of each frame's linear predictor, by Levinson and Durbin."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    err = r[:, 0] * 1.0001 + 1e-6
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        prev = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = prev - k[:, None] * prev[:, ::-1]
        err *= np.maximum(1 - k * k, 1e-9)
    return np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def _encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of x (frames x BLOCK, 8-bit samples) and where each begins, with the end as last entry."""
    n = len(x)
    x = x.astype(np.int32)
    pick, best = np.zeros(n, np.int32), np.abs(x).sum(axis=1)
    d, res = x, x.copy()
    for order in range(1, 5):
        d = d[:, 1:] - d[:, :-1]
        cost = np.abs(d).sum(axis=1)
        better = cost < best
        best = np.where(better, cost, best)
        pick[better] = order
        res[better, order:] = d[better]
    coef = _lpc(x)
    pred = np.zeros((n, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        pred += coef[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    d = x[:, ORDER:] - (pred >> SHIFT)
    cost = np.abs(d).sum(axis=1) + 4 * ORDER
    lpc = cost < best
    res[lpc, ORDER:] = d[lpc]
    order = np.where(lpc, ORDER, pick)
    cols = np.arange(BLOCK)
    warm = cols < order[:, None]
    u = (res << 1) ^ (res >> 31)
    u[warm] = 0
    mean = u.sum(axis=1) / np.maximum(1, BLOCK - order)
    k0 = np.clip(np.floor(np.log2(mean * 0.6931 + 1e-9)), 0, 13).astype(np.int32)
    bits = [(u >> k[:, None]).sum(axis=1) + (k + 1) * (BLOCK - order) for k in (k0, k0 + 1)]
    k = np.where(bits[1] < bits[0], k0 + 1, k0)
    extra = 10 + np.where(lpc, 9 + ORDER * PRECISION, 0)
    total = np.minimum(bits[0], bits[1]) + 8 * order + extra
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (total >= 8 * BLOCK)
    coded = ~constant & ~verbatim
    raw = warm | ~coded[:, None]
    q = u >> k[:, None]
    width = np.where(raw, 8, q + 1 + k[:, None])
    width[constant, 1:] = 0
    kk = k[:, None]
    value = np.where(raw, x & 255, (1 << kk) | (u & ((1 << kk) - 1)))
    held = np.where(raw, 8, kk + 1)
    ends = np.cumsum(width, axis=1, dtype=np.int64) + 8
    ends += np.where(~warm & coded[:, None], extra[:, None], 0)
    heads = [_header(i) for i in numbers.tolist()]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    body = -(-ends[:, -1] // 8)
    size = head_len + body + 2
    start = np.concatenate(([0], np.cumsum(size)))
    base = (start[:-1] + head_len) * 8
    kind = np.select([constant, verbatim, lpc], [0, 1, 0x20 | ORDER - 1], 8 | order)
    keep = width > 0
    at = (base[:, None] + ends)[keep]
    items = [(at, held[keep], value[keep]), (base + 8, np.full(n, 8), kind << 1)]
    c = np.flatnonzero(coded)
    after = base[c] + 8 + 8 * order[c] + extra[c]
    items.append((after, np.full(len(c), 10), k[c]))
    ln = np.flatnonzero(coded & lpc)
    at_lpc = base[ln] + 8 + 8 * ORDER
    items.append((at_lpc + 9, np.full(len(ln), 9), np.full(len(ln), (PRECISION - 1) << 5 | SHIFT)))
    for j in range(ORDER):
        items.append((at_lpc + 9 + PRECISION * (j + 1), np.full(len(ln), PRECISION), coef[ln, j] & ((1 << PRECISION) - 1)))
    end = np.concatenate([i[0] for i in items])
    bits_held = np.concatenate([i[1] for i in items])
    val = np.concatenate([i[2] for i in items]).astype(np.int64)
    last = (end - 1) >> 3
    val <<= 7 - ((end - 1) & 7)
    n_bytes = int(start[-1]) + 3
    out = np.bincount(last + 2, val & 255, n_bytes)
    out += np.bincount(last + 1, val >> 8 & 255, n_bytes)
    if int(bits_held.max(initial=0)) + 7 > 16:
        out += np.bincount(last, val >> 16, n_bytes)
    buf = out[2 : 2 + int(start[-1])].astype(np.uint8)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    h0 = np.concatenate(([0], np.cumsum(head_len)))[:-1]
    buf[np.repeat(start[:-1] - h0, head_len) + np.arange(len(joined))] = joined
    crc = _crc16_many(buf, start[:-1], start[1:] - 2)
    buf[start[1:] - 2], buf[start[1:] - 1] = crc >> 8, crc & 255
    return buf, start


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of unsigned 8-bit samples; lengths are multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK for p in payloads):
        raise FlacError(f"payloads are multiples of {BLOCK} samples")
    out: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    for part in _slices(counts):
        x = np.concatenate([np.frombuffer(payloads[i], np.uint8)[lo * BLOCK : hi * BLOCK] for i, lo, hi in part]).reshape(-1, BLOCK)
        buf, start = _encode_frames(x.astype(np.int16) - 128, np.concatenate([np.arange(lo, hi) for _, lo, hi in part]))
        at = 0
        for i, lo, hi in part:
            out[i].append(buf[start[at] : start[at + hi - lo]].tobytes())
            sizes[i].append(np.diff(start[at : at + hi - lo + 1]))
            at += hi - lo
    return [_stream(p, b"".join(frames), np.concatenate(s) if s else np.zeros(0, np.int64)) for p, frames, s in zip(payloads, out, sizes, strict=True)]


def _slices(counts: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """(stream, first, end) of frames, LANES frames together at most."""
    part, room = [], LANES
    for i, n in enumerate(counts):
        lo = 0
        while lo < n:
            hi = min(n, lo + room)
            part.append((i, lo, hi))
            room -= hi - lo
            lo = hi
            if not room:
                yield part
                part, room = [], LANES
    if part:
        yield part


def _stream(payload: bytes, frames: bytes, sizes: np.ndarray) -> bytes:
    signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    small, large = (int(sizes.min()), int(sizes.max())) if len(sizes) else (0, 0)
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + small.to_bytes(3, "big") + large.to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    seek = b"".join(struct.pack(">QQH", f * BLOCK, int(at[f]), BLOCK) for f in range(0, len(sizes), SEEK_EVERY))
    blocks = [(0, info), (3, seek)] if seek else [(0, info)]
    head = b"".join(bytes([kind | 0x80 * (i == len(blocks) - 1)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))
    return b"fLaC" + head + frames


def metadata(stream: bytes) -> tuple[dict, int]:
    """Fields of STREAMINFO and the seek points, and where the first frame begins."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, info, last = 4, {"seek": []}, False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata end too early")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        b = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(b[10:18], "big")
            info |= {"min_block": int.from_bytes(b[:2], "big"), "max_block": int.from_bytes(b[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": b[18:34]}
        elif kind == 3:
            info["seek"] = [struct.unpack(">QQH", b[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
    return info, at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        if hi > len(self.data):
            raise FlacError("stream ends too early")
        self.at += n
        return int.from_bytes(self.data[lo:hi], "big") >> (hi * 8 - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(b: _Bits, size: int, bits: int) -> list[int]:
    head = b.take(8)
    kind, wasted = head >> 1 & 63, 0
    if head & 1:
        wasted = b.unary() + 1
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * size
    elif kind == 1:
        out = [b.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        out = [b.signed(bits) for _ in range(order)]
        coef, shift = list(FIXED[order]) if kind < 32 else [], 0
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        wide = 4 + b.take(2)
        parts = 1 << b.take(4)
        for p in range(parts):
            k, raw = b.take(wide), None
            if k == (1 << wide) - 1:
                raw = b.take(5)
            for _ in range(size // parts - (order if p == 0 else 0)):
                if raw is None:
                    u = b.unary() << k | b.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                out.append(r + (sum(c * x for c, x in zip(coef, out[: -order - 1 : -1], strict=True)) >> shift if order else 0))
    else:
        raise FlacError(f"reserved subframe {kind}")
    return [x << wasted for x in out] if wasted else out


def walk(stream: bytes, at: int | None = None, frames: int | None = None) -> Iterator[tuple[int, int, list[list[int]]]]:
    """(byte offset, first sample, samples of each channel) frame by frame, every checksum verified."""
    info, first = metadata(stream)
    at = first if at is None else at
    done, seen = 0, None
    while at < len(stream) and (frames is None or done < frames):
        b = _Bits(stream, at)
        if b.take(15) != 0x7FFC:
            raise FlacError(f"no frame at byte {at}")
        variable = b.take(1)
        size_code, rate_code, channel, bits_code, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
        lead = b.take(8)
        number, more = _lead(lead)
        for _ in range(more):
            number = number << 6 | b.take(8) & 63
        size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
        if rate_code in (12, 13, 14):
            b.take(8 if rate_code == 12 else 16)
        if crc8(stream[at : b.at >> 3]) != b.take(8):
            raise FlacError(f"header checksum at byte {at}")
        bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits_code]
        n = channel + 1 if channel < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(channel)
        out = [_subframe(b, size, bits + (c == side)) for c in range(n)]
        if channel == 8:
            out[1] = [x - y for x, y in zip(*out, strict=True)]
        elif channel == 9:
            out[0] = [x + y for x, y in zip(*out, strict=True)]
        elif channel == 10:
            mids = [m << 1 | s & 1 for m, s in zip(*out, strict=True)]
            out = [[m + s >> 1 for m, s in zip(mids, out[1], strict=True)], [m - s >> 1 for m, s in zip(mids, out[1], strict=True)]]
        end = (b.at + 7) >> 3
        if crc16(stream[at:end]) != int.from_bytes(stream[end : end + 2], "big"):
            raise FlacError(f"frame checksum at byte {at}")
        sample = number if variable else number * info["max_block"]
        if seen is not None and sample != seen:
            raise FlacError(f"frame {number} out of order at byte {at}")
        seen = sample + size
        yield at, sample, out
        at, done = end + 2, done + 1


def _lead(lead: int) -> tuple[int, int]:
    """Value bits of the first byte of a coded number, and how many bytes follow."""
    if lead < 0x80:
        return lead, 0
    ones = 8 - (lead ^ 0xFF).bit_length()
    return lead & (0x7F >> ones), ones - 1


def _starts(stream: bytes, at: int, info: dict) -> np.ndarray | None:
    """Where frames begin, if the stream has the lockstep form."""
    if info["channels"] != 1 or info["bits"] != 8 or info["min_block"] != BLOCK or info["max_block"] != BLOCK or info["samples"] % BLOCK:
        return None
    n = info["samples"] // BLOCK
    buf = np.frombuffer(stream, np.uint8)
    found = np.flatnonzero((buf[at:-1] == 0xFF) & (buf[at + 1 :] == 0xF8)) + at
    if len(found) != n:
        good = [int(p) for p in found if (h := _valid(stream, int(p))) is not None and h[0] >= 0]
        want, kept = 0, []
        for p in good:
            if _valid(stream, p)[0] == want:
                kept.append(p)
                want += 1
        found = np.array(kept, np.int64)
    return found if len(found) == n else None


def _valid(stream: bytes, p: int) -> tuple[int, int] | None:
    """Frame number and header length, if a header of the lockstep form with a valid CRC-8 stands at p."""
    number, more = _lead(stream[p + 4]) if p + 4 < len(stream) else (0, 0)
    h = stream[p : p + 6 + more]
    if len(h) < 6 + more or h[2] != 0x14 or h[3] != 0x02 or crc8(h[:-1]) != h[-1]:
        return None
    for b in h[5 : 5 + more]:
        number = number << 6 | b & 63
    return number, 6 + more


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each mono stream (int32), verified by frame checksums, frame order, length and MD5."""
    info, starts, out = [], [], []
    for s in streams:
        i, at = metadata(s)
        info.append(i)
        starts.append(_starts(s, at, i))
        out.append(np.zeros(i["samples"] if starts[-1] is not None else 0, np.int32))
    for part in _slices([0 if s is None else len(s) for s in starts]):
        begin, end, base, bufs = [], [], 0, []
        for i, lo, hi in part:
            b0 = int(starts[i][lo])
            b1 = int(starts[i][hi]) if hi < len(starts[i]) else len(streams[i])
            mine = starts[i][lo:hi] - b0 + base
            begin.append(mine)
            end.append(np.append(mine[1:], base + b1 - b0))
            bufs.append(streams[i][b0:b1])
            base += b1 - b0
        x = _decode_frames(b"".join(bufs), np.concatenate(begin), np.concatenate(end), np.concatenate([np.arange(lo, hi) for _, lo, hi in part]))
        at = 0
        for i, lo, hi in part:
            if x is None:
                starts[i] = None
            else:
                out[i][lo * BLOCK : hi * BLOCK] = x[at : at + hi - lo].ravel()
            at += hi - lo
    for i, s in enumerate(streams):
        if starts[i] is None:
            if info[i]["channels"] != 1:
                raise FlacError("several channels: use walk")
            out[i] = np.array([x for _, _, c in walk(s) for x in c[0]], np.int32)
        if len(out[i]) != info[i]["samples"]:
            raise FlacError(f"{len(out[i])} of {info[i]['samples']} samples")
        wide = -(-info[i]["bits"] // 8)
        raw = out[i].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes() if wide > 1 else out[i].astype(np.int8).tobytes()
        if any(info[i]["md5"]) and hashlib.md5(raw).digest() != info[i]["md5"]:
            raise FlacError("MD5 of the samples")
    return out


def _decode_frames(data: bytes, start: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray | None:
    """Samples (frames x BLOCK) in lockstep; None if some frame needs the walking decoder. Checks CRC-8, numbers and CRC-16."""
    n = len(start)
    buf = np.frombuffer(data, np.uint8)
    lead = buf[start + 4].astype(np.int64)
    ones = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 2, 3, 4, 5, 6], 7)
    more = np.maximum(ones - 1, 0)
    number = np.where(ones == 0, lead, lead & (0x7F >> ones))
    crc = np.zeros(n, np.int64)
    length = 6 + more
    for j in range(int(length.max()) - 1):
        on = j < length - 1
        b = buf[np.minimum(start + j, len(buf) - 1)].astype(np.int64)
        crc = np.where(on, _CRC8[crc ^ b], crc)
        if j >= 5:
            number = np.where(on, number << 6 | b & 63, number)
    if (crc != buf[start + length - 1]).any() or (number != numbers).any() or (buf[start + 2] != 0x14).any() or (buf[start + 3] != 2).any():
        return None
    if (_crc16_many(buf, start, end - 2) != (buf[end - 2].astype(np.uint16) << np.uint16(8) | buf[end - 1])).any():
        return None
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    wide = np.zeros(len(buf) + 8, _U)
    for j in range(8):
        wide |= padded[j : j + len(wide)].astype(_U) << _U(56 - 8 * j)
    pos = (start + length) * 8

    def peek() -> np.ndarray:
        return wide[pos >> 3] << (pos & 7).astype(_U)

    head = (peek() >> _U(56)).astype(np.int64)
    pos = pos + 8
    kind = head >> 1
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if (head & 1).any() or not (constant | verbatim | fixed | lpc).all():
        return None
    order = np.where(fixed, kind & 7, np.where(lpc, (kind & 31) + 1, 0))
    most = int(order.max(initial=0))
    x = np.zeros((BLOCK, n), np.int64)
    raw = np.select([constant, verbatim], [1, BLOCK], order)
    for i in range(int(raw.max(initial=0))):
        on = i < raw
        v = (peek() >> _U(56)).astype(np.int64)
        x[i] = np.where(on, (v ^ 128) - 128, x[i])
        pos = pos + np.where(on, 8, 0)
    x[:, constant] = x[0, constant]
    coef, shift = np.zeros((max(most, 4), n), np.int64), np.zeros(n, np.int64)
    for p in range(1, 5):
        coef[:p, fixed & (order == p)] = np.array(FIXED[p])[:, None]
    if lpc.any():
        v = (peek() >> _U(55)).astype(np.int64)
        precision, s = (v >> 5) + 1, v & 31
        shift = np.where(lpc, (s ^ 16) - 16, 0)
        if (shift < 0).any():
            return None
        pos = pos + np.where(lpc, 9, 0)
        for j in range(most):
            on = lpc & (j < order)
            v = ((peek() >> _U(1)) >> (63 - precision).astype(_U)).astype(np.int64)
            half = 1 << (precision - 1)
            coef[j] = np.where(on, (v ^ half) - half, coef[j])
            pos = pos + np.where(on, precision, 0)
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        pos, order_c = pos[coded], order[coded]
        top = (peek() >> _U(54)).astype(np.int64)
        k = top & 15
        if (top >> 4).any() or (k == 15).any():
            return None
        pos = pos + 10
        k_left = (63 - k).astype(_U)
        r = np.zeros((BLOCK, len(coded)), np.int64)
        for i in range(int(order_c.min()), BLOCK):
            w = peek()
            top53 = (w >> _U(11)).astype(np.float64)
            zeros = 1075 - (top53.view(np.int64) >> 52)
            if (zeros + k > 55).any():
                zeros = _long_unary(wide, pos, w)
                pos_low = pos + zeros + 1
                low = ((wide[np.minimum(pos_low >> 3, len(wide) - 1)] << (pos_low & 7).astype(_U)) >> _U(1)) >> k_left
            else:
                low = ((w << (zeros + 1).astype(_U)) >> _U(1)) >> k_left
            u = (zeros << k) | low.astype(np.int64)
            value = (u >> 1) ^ -(u & 1)
            step = zeros + 1 + k
            if i < most:
                on = i >= order_c
                r[i] = np.where(on, value, 0)
                pos = pos + np.where(on, step, 0)
            else:
                r[i] = value
                pos = pos + step
        if ((pos + 7) >> 3 != end[coded] - 2).any():
            return None
        y, c, s = x[:, coded], coef[:, coded], shift[coded]
        for i in range(BLOCK):
            pred = np.zeros(len(coded), np.int64)
            for j in range(min(i, most)):
                pred += c[j] * y[i - 1 - j]
            pred >>= s
            y[i] = np.where(i >= order_c, r[i] + pred, y[i]) if i < most else r[i] + pred
        x[:, coded] = y
    return x.T.astype(np.int32)


def _long_unary(wide: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Zeros before the next one bit, however many."""
    zeros = np.zeros(len(pos), np.int64)
    at, open_ = pos.copy(), np.ones(len(pos), bool)
    while open_.any():
        now = np.minimum(at >> 3, len(wide) - 1)
        v = (wide[now] << (at & 7).astype(_U)) >> _U(16)
        f = v.astype(np.float64)
        found = np.where(v > 0, 47 - ((f.view(np.int64) >> 52) - 1023), 48)
        zeros += np.where(open_, found, 0)
        at += np.where(open_, found, 0)
        open_ &= (v == 0) & ((at >> 3) < len(wide) - 1)
    return zeros


def read_samples(stream: bytes, first: int, count: int) -> list[int]:
    """Samples first .. first + count of a mono stream, decoded from the seek point before them."""
    info, at = metadata(stream)
    point = max((p for p in info["seek"] if p[0] <= first), default=(0, 0, 0))
    out: list[int] = []
    if count <= 0 or first >= info["samples"]:
        return out
    for _, sample, channels in walk(stream, at + point[1]):
        lo, hi = max(first - sample, 0), min(first + count - sample, len(channels[0]))
        if lo < hi:
            out += channels[0][lo:hi]
        if sample + len(channels[0]) >= first + count:
            break
    return out


def payload(text: Column, unit: int = BLOCK) -> Column:
    """The text's UTF-8 bytes with spaces appended up to a positive multiple of unit."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.concat(raw, F.repeat(F.lit(" "), F.when(n == 0, unit).otherwise(F.pmod(-n, F.lit(unit)))).cast("binary"))


def encode(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """All columns, with the payload (unsigned 8-bit samples, a multiple of BLOCK of them) replaced by its FLAC stream; a column that has the stream's name already gives way to it."""
    kept = [f for f in df.schema.fields if f.name not in (payload_col, media_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                media = pa.array(encode_many([x or b"" for x in part.column(part.num_columns - 1).to_pylist()]), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), media], [*part.schema.names[:-1], media_col])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(payload_col)).mapInArrow(streamed(run), T.StructType([*kept, T.StructField(media_col, T.BinaryType())]))


def pcm(samples: np.ndarray, bits: int, block: int = 4096) -> list[tuple[int, int, bytes]]:
    """(sample offset, samples, signed little-endian bytes) of each block of a channel; a sample's block is its number over `block`, so blocks can be sought."""
    kind = np.dtype("<i1") if bits <= 8 else np.dtype("<i2") if bits <= 16 else np.dtype("<i4")
    return [(lo, len(y := samples[lo : lo + block]), y.astype(kind).tobytes()) for lo in range(0, len(samples), block)]


def pcm_range(blocks: list[tuple[int, int, bytes]], first: int, count: int) -> bytes:
    """The bytes of count samples of 8 bits from first on, from the blocks that hold them."""
    out = []
    for lo, n, raw in blocks[first // blocks[0][1] :] if blocks else ():
        if lo >= first + count:
            break
        out.append(raw[max(0, first - lo) : first + count - lo])
    return b"".join(out)


def features(x: np.ndarray, stream: bytes) -> str:
    """Figures of a stream's samples: counts, level and shape, as key=value pairs."""
    wide = x.astype(np.int64)
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    peak = int(np.abs(wide).max(initial=0))
    total, power = int(wide.sum()), int((wide * wide).sum())
    change = int(np.abs(np.diff(wide)).sum())
    return f"samples={len(x)};frames={len(x) // BLOCK};peak={peak};sum={total};power={power};crossings={crossings};change={change};coded={len(stream)}"


#: Signed to unsigned samples and back.
_UNSIGNED = bytes(b ^ 128 for b in range(256))


def describe(df: DataFrame, media_col: str = "media", block: int = 4096) -> DataFrame:
    """All columns but the media, and what reading it back gives: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_blocks.

    The stream is decoded to PCM blocks; the payload is their samples in order and its tail is sought by sample offset. A null or empty media has no samples. Columns that have one of these names already give way.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in added.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in (media_col, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                streams = [s or b"" for s in part.column(part.num_columns - 1).to_pylist()]
                found, rows = iter(decode_many([s for s in streams if s])), []
                for s in streams:
                    x = next(found) if s else np.zeros(0, np.int32)
                    blocks, sha = pcm(x, 8, block), hashlib.sha256()
                    for _, _, raw in blocks:
                        sha.update(raw.translate(_UNSIGNED))
                    tail = pcm_range(blocks, max(0, len(x) - 16), 16).translate(_UNSIGNED)
                    rows.append((sum(n for _, n, _ in blocks), sha.hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), features(x, s), len(blocks)))
                columns = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *names])

    schema = T.StructType([*kept, *T.StructType.fromDDL(added).fields])
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(media_col)).mapInArrow(streamed(run), schema)


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", block: int = 4096) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, pcm (signed little-endian): a mono stream's verified samples in seekable blocks; a null or empty media has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                streams = [x or b"" for x in part.column(1).to_pylist()]
                some = [i for i, s in enumerate(streams) if s]
                rows: list[tuple] = []
                for i, x in zip(some, decode_many([streams[i] for i in some]), strict=True):
                    rows += [(part.column(0)[i].as_py(), k, *found) for k, found in enumerate(pcm(x, metadata(streams[i])[0]["bits"], block))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(streamed(run), "doc_id long, block long, sample_offset long, n_samples long, pcm binary")
