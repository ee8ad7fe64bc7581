"""FLAC as its public format description has it: a decoder of all subframe kinds, and an encoder with fixed predictors.

Decoding works bit by bit over each frame's residuals, so it is meant for clips of seconds to minutes in Arrow batches.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: sample sizes by their codes, factors of the fixed predictors.
_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK = 4096


class _Bits:
    """Reads big-endian bit fields and unary numbers of a byte string."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8
        self.ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))  # places of set bits, for unary numbers
        self.next = 0

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        if b > 8 * len(self.data):
            raise EOFError("the stream ends inside a frame")
        self.at = b
        return (int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big") >> (-b & 7)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        self.next = int(np.searchsorted(self.ones, self.at)) if self.next >= len(self.ones) or self.ones[self.next] < self.at or (self.next and self.ones[self.next - 1] >= self.at) else self.next
        if self.next >= len(self.ones):
            raise EOFError("the stream ends inside a frame")
        zeros = int(self.ones[self.next]) - self.at
        self.at += zeros + 1
        return zeros

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    wide, out = (4, 5)[method], []
    for k in range(parts):
        count = size // parts - (0 if k else order)
        rice = bits.take(wide)
        if rice == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            v = (bits.unary() << rice) | bits.take(rice)
            out.append((v >> 1) ^ -(v & 1))
    return out


def _predicted(start: list[int], factors, shift: int, residual: list[int]) -> list[int]:
    out, order = start, len(factors)
    for r in residual:
        out.append(r + (sum(f * out[-1 - k] for k, f in enumerate(factors)) >> shift) if order else r)
    return out


def _subframe(bits: _Bits, size: int, wide: int) -> np.ndarray:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    wide -= wasted
    if kind == 0:
        out = [bits.signed(wide)] * size
    elif kind == 1:
        out = [bits.signed(wide) for _ in range(size)]
    elif 8 <= kind <= 12:
        start = [bits.signed(wide) for _ in range(kind - 8)]
        out = _predicted(start, _FIXED[kind - 8], 0, _residual(bits, size, kind - 8))
    elif kind >= 32:
        order = kind - 31
        start = [bits.signed(wide) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        factors = [bits.signed(precision) for _ in range(order)]
        out = _predicted(start, factors, shift, _residual(bits, size, order))
    else:
        raise ValueError(f"reserved subframe kind {kind}")
    return np.array(out, np.int64) << wasted


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of FLAC bytes; what breaks off or isn't FLAC is a ValueError or EOFError."""
    if content[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(content):
            raise EOFError("the stream ends in its header")
        last, kind, size = content[at] >> 7, content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(content[at + 14 : at + 22], "big")
        at += 4 + size
    if info is None:
        raise ValueError("no stream information")
    rate, wide, total = info >> 44, ((info >> 36) & 31) + 1, info & ((1 << 36) - 1)
    bits, blocks, got = _Bits(content, at), [], 0
    while bits.at + 16 <= 8 * len(content) and (not total or got < total):
        if bits.take(14) != 0x3FFE:
            raise ValueError("a frame does not begin where it should")
        bits.take(2)
        code, rates, channels, sizes = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        first = bits.take(8)
        for _ in range(max(0, 7 - (~first & 0xFF).bit_length())) if first & 128 else ():  # further bytes of the coded number
            bits.take(8)
        size = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else bits.take(8 * (code - 5)) + 1
        if rates >= 12:
            bits.take(8 if rates == 12 else 16)
        bits.take(8)
        own = _SIZES.get(sizes, wide)
        lines = [_subframe(bits, size, own + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)) for c in range(2 if channels >= 8 else channels + 1)]
        if channels == 8:
            lines[1] = lines[0] - lines[1]
        elif channels == 9:
            lines[0] = lines[0] + lines[1]
        elif channels == 10:
            middle, side = (lines[0] << 1) | (lines[1] & 1), lines[1]
            lines = [(middle + side) >> 1, (middle - side) >> 1]
        bits.align()
        bits.take(16)
        blocks.append(np.mean(lines, axis=0) / float(1 << (own - 1)))
        got += size
    if got < total:
        raise EOFError("the stream ends before its last frame")
    data = np.concatenate(blocks) if blocks else np.zeros(0)
    return (data[:total] if total else data).astype(np.float32), rate


def _crc(data: bytes, wide: int, factor: int) -> int:
    value, top = 0, 1 << (wide - 1)
    for byte in data:
        value ^= byte << (wide - 8)
        for _ in range(8):
            value = (value << 1) ^ factor if value & top else value << 1
        value &= (1 << wide) - 1
    return value


def _coded(number: int) -> bytes:
    """A frame number in the format's variable length (that of UTF-8, up to six bytes)."""
    if number < 128:
        return bytes([number])
    more = 1
    while number >> (6 * more + 6 - more):
        more += 1
    head = (0xFF00 >> (more + 1)) & 0xFF | number >> (6 * more)
    return bytes([head, *((number >> (6 * k)) & 63 | 128 for k in range(more - 1, -1, -1))])


def _frame(samples: np.ndarray, number: int) -> bytes:
    fields: list[tuple[int, int]] = []
    best, order = None, 0
    line = samples.astype(np.int64)
    for k in range(min(4, len(samples) - 1) + 1):  # the fixed predictor whose residuals are least
        cost = int(np.abs(line).sum())
        if best is None or cost < best[0]:
            best, order = (cost, line), k
        line = np.diff(line)
    residual = best[1]
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    rice = min(14, max(0, int(np.mean(folded)).bit_length() - 1)) if len(folded) else 0
    fields.append((8, (8 + order) << 1))
    fields += [(16, int(v) & 0xFFFF) for v in samples[:order]]
    fields += [(6, 0), (4, rice)]
    bits = "".join(format(v, f"0{n}b") for n, v in fields)
    low = [format(v & ((1 << rice) - 1), f"0{rice}b") if rice else "" for v in folded.tolist()]
    bits += "".join("0" * (v >> rice) + "1" + b for v, b in zip(folded.tolist(), low, strict=True))
    bits += "0" * (-len(bits) % 8)
    head = b"\xff\xf8" + bytes([0x70, 0x08]) + _coded(number) + (len(samples) - 1).to_bytes(2, "big")
    head += bytes([_crc(head, 8, 0x07)])
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    return body + _crc(body, 16, 0x8005).to_bytes(2, "big")


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit FLAC bytes of mono samples."""
    whole = (np.clip(samples, -1, 1) * 32767).astype(np.int64)
    info = (rate << 44) | (15 << 36) | len(whole)
    head = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + info.to_bytes(8, "big") + bytes(16)
    frames = [_frame(whole[a : a + BLOCK], k) for k, a in enumerate(range(0, len(whole), BLOCK))]
    return b"fLaC" + bytes([0x80]) + len(head).to_bytes(3, "big") + head + b"".join(frames)
