"""JPEG: header, sequential and progressive Huffman decoding (whole or at M/8 of the size), baseline writing."""

from __future__ import annotations

import heapq
import struct
from array import array

import numpy as np

MAX_PIXELS = 1 << 28
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: Position in the block of the k-th coefficient of the zigzag order.
ZIGZAG = [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]
# The quantisation tables of the standard's annex K, luminance and chrominance.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


def _segments(raw: bytes):
    """(marker, start, end) of the segments' bodies; a scan's coded bytes follow its end."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            return
        marker = raw[at + 1]
        if marker in (0, 0xFF) or marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return
        if at + 4 > len(raw):
            return
        n = struct.unpack_from(">H", raw, at + 2)[0]
        if n < 2 or at + 2 + n > len(raw):
            raise ValueError("cut short")
        yield marker, at + 4, at + 2 + n
        at += 2 + n


def size(raw: bytes) -> tuple[int, int, int]:
    """(width, height, channels) from the frame header."""
    for marker, a, b in _segments(raw):
        if marker in FRAMES:
            if b - a < 6:
                break
            h, w, n = struct.unpack_from(">HHB", raw, a + 1)
            if not w or not h:
                break
            return w, h, n
    raise ValueError("no frame header")


def scaled(full: int, m: int) -> int:
    return -(-full * m // 8)


class _Bits:
    """Bits of coded bytes from which the stuffing is gone; zeros for a little while after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            if self.at >= len(self.data) + 16:
                raise ValueError("cut short")
            self.hold = (self.hold << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at += 1
            self.have += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.have < n:
            self.fill(n)
        self.have -= n
        return self.hold >> self.have & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.have < 16:
            self.fill(16)
        v = table[self.hold >> (self.have - 16) & 0xFFFF]
        if not v:
            raise ValueError("bad code")
        self.have -= v >> 8
        return v & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """length << 8 | symbol for every 16 bits that may come next; 0 where there is no code."""
    table: list[int] = []
    k = 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            table += [length << 8 | s] * (1 << (16 - length))
        k += n
    if len(table) > 65536:
        raise ValueError("bad table")
    return table + [0] * (65536 - len(table))


class _Part:
    def __init__(self, key: int, h: int, v: int, q: int):
        self.key, self.h, self.v, self.q = key, h, v, q


class _Scan:
    """How the blocks of one scan are read; eob and dc carry over from block to block."""

    def __init__(self, progressive: bool, lo: int, hi: int, high: int, low: int):
        self.lo, self.hi, self.low, self.run = lo, hi, low, 0
        if not progressive:
            self.block = self.whole
        elif lo == 0:
            self.block = self.dc_again if high else self.dc_first
        else:
            self.block = self.ac_again if high else self.ac_first

    def whole(self, bits: _Bits, c: array, at: int, part: _Part) -> None:
        part.last += bits.signed(bits.symbol(part.dc))
        c[at] = part.last
        k = 1
        while k < 64:
            s = bits.symbol(part.ac)
            if not s & 15:
                if s != 0xF0:
                    return
                k += 16
                continue
            k += s >> 4
            if k > 63:
                raise ValueError("bad block")
            c[at + ZIGZAG[k]] = bits.signed(s & 15)
            k += 1

    def dc_first(self, bits: _Bits, c: array, at: int, part: _Part) -> None:
        part.last += bits.signed(bits.symbol(part.dc))
        c[at] = part.last << self.low

    def dc_again(self, bits: _Bits, c: array, at: int, part: _Part) -> None:
        if bits.take(1):
            c[at] |= 1 << self.low

    def ac_first(self, bits: _Bits, c: array, at: int, part: _Part) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.lo
        while k <= self.hi:
            s = bits.symbol(part.ac)
            r, n = s >> 4, s & 15
            if n:
                k += r
                if k > 63:
                    raise ValueError("bad block")
                c[at + ZIGZAG[k]] = bits.signed(n) * (1 << self.low)
                k += 1
            elif r == 15:
                k += 16
            else:
                self.run = (1 << r) + bits.take(r) - 1
                return

    def ac_again(self, bits: _Bits, c: array, at: int, part: _Part) -> None:
        bit, k = 1 << self.low, self.lo

        def refine(p: int) -> None:
            if bits.take(1) and not abs(c[p]) & bit:
                c[p] += bit if c[p] > 0 else -bit

        while k <= self.hi and not self.run:
            s = bits.symbol(part.ac)
            skip, fresh = s >> 4, 0
            if s & 15:
                fresh = bit if bits.take(1) else -bit
            elif skip < 15:
                self.run = (1 << skip) + bits.take(skip)
                break
            while k <= self.hi:  # passes `skip` zeros, refines what is not zero on the way
                p = at + ZIGZAG[k]
                k += 1
                if c[p]:
                    refine(p)
                elif skip:
                    skip -= 1
                else:
                    c[p] = fresh
                    break
        if self.run:
            for k in range(k, self.hi + 1):
                if c[at + ZIGZAG[k]]:
                    refine(at + ZIGZAG[k])
            self.run -= 1


def _coefficients(raw: bytes):
    """(width, height, parts with their blocks and quantisation, transform of the Adobe segment or None)."""
    quant, dc, ac, parts, adobe, every = {}, {}, {}, [], None, 0
    w = h = top_h = top_v = kind = 0
    for marker, a, b in _segments(raw):
        body = raw[a:b]
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker in FRAMES:
            if marker not in (0xC0, 0xC1, 0xC2) or body[0] != 8 or parts:
                raise ValueError("this kind of JPEG is not read")
            kind, (h, w, n) = marker, struct.unpack_from(">HHB", body, 1)
            if not w or not h or w * h > MAX_PIXELS or n not in (1, 3, 4) or len(body) < 6 + 3 * n:
                raise ValueError("bad frame header")
            parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not (1 <= p.h <= 4 and 1 <= p.v <= 4) for p in parts):
                raise ValueError("bad frame header")
            top_h, top_v = max(p.h for p in parts), max(p.v for p in parts)
            for p in parts:
                p.w, p.rows = -(-w * p.h // top_h), -(-h * p.v // top_v)
                p.across, p.down = -(-w // (8 * top_h)) * p.h, -(-h // (8 * top_v)) * p.v
                p.c, p.table = array("h", bytes(128 * p.across * p.down)), None
        elif marker == 0xDA:
            if not parts:
                raise ValueError("scan before frame")
            n = body[0]
            used = []
            for i in range(n):
                p = next((p for p in parts if p.key == body[1 + 2 * i]), None)
                if p is None:
                    raise ValueError("bad scan")
                p.dc, p.ac = dc.get(body[2 + 2 * i] >> 4), ac.get(body[2 + 2 * i] & 15)
                p.table = quant.get(p.q) if p.table is None else p.table
                used.append(p)
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = _Scan(kind == 0xC2, lo, min(hi, 63), approx >> 4, approx & 15)
            _read(raw, b, used, scan, every, w, h, top_h, top_v)
    if not parts or any(p.table is None for p in parts):
        raise ValueError("no picture")
    return w, h, parts, adobe


def _read(raw: bytes, at: int, used: list[_Part], scan: _Scan, every: int, w: int, h: int, top_h: int, top_v: int) -> None:
    pieces, end = [], at
    start = at
    while True:  # split at restart markers
        end = raw.find(b"\xff", end)
        if end < 0 or end + 1 >= len(raw):
            pieces.append(raw[start:])
            break
        m = raw[end + 1]
        if m == 0:
            end += 2
        elif 0xD0 <= m <= 0xD7:
            pieces.append(raw[start:end])
            start = end = end + 2
        elif m == 0xFF:
            end += 1
        else:
            pieces.append(raw[start:end])
            break
    if len(used) == 1:
        p = used[0]
        across = -(-p.w // 8)
        total = across * -(-p.rows // 8)
        place = lambda i: [(p, (i // across * p.across + i % across) * 64)]
    else:
        across = -(-w // (8 * top_h))
        total = across * -(-h // (8 * top_v))
        place = lambda i: [(p, (((i // across) * p.v + y) * p.across + (i % across) * p.h + x) * 64) for p in used for y in range(p.v) for x in range(p.h)]
    each = every or total
    for k, piece in enumerate(pieces):
        bits, scan.run = _Bits(piece.replace(b"\xff\0", b"\xff")), 0
        for p in used:
            p.last = 0
        for i in range(k * each, min(total, (k + 1) * each)):
            for p, where in place(i):
                scan.block(bits, p.c, where, p)


def _basis(m: int) -> np.ndarray:
    """(8, m): the inverse transform of the first m coefficients to m samples, scaled for blocks of eight."""
    u, x = np.arange(m)[:, None], np.arange(m)[None, :]
    out = np.zeros((8, m))
    out[:m] = np.cos((2 * x + 1) * u * np.pi / (2 * m)) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return out


def _plane(p: _Part, m: int) -> np.ndarray:
    """Samples of one component, m for each eight."""
    table = np.zeros(64, np.float32)
    table[ZIGZAG] = p.table
    basis, out = _basis(m).astype(np.float32), np.empty((p.down * m, p.across * m), np.float32)
    blocks = np.frombuffer(p.c, np.int16).reshape(p.down, p.across, 8, 8)
    for j in range(p.down):  # a row of blocks at a time
        f = blocks[j] * table.reshape(8, 8)
        out[j * m : (j + 1) * m] = np.einsum("uy,kuv,vx->ykx", basis, f, basis, optimize=True).reshape(m, -1)
    return np.clip(np.floor(out + 128.5), 0, 255)


def _stack(parts: list[_Part], w: int, h: int, m: int) -> np.ndarray:
    """(height, width, components) samples, those of smaller components repeated."""
    top_h, top_v = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        ys, xs = np.arange(h) * p.v // top_v, np.arange(w) * p.h // top_h
        planes.append(_plane(p, m)[ys[:, None], xs[None, :]])
    return np.stack(planes, axis=-1)


def to_rgb(v: np.ndarray) -> np.ndarray:
    """Red, green and blue of (..., 3) samples in YCbCr, whole numbers."""
    y, cb, cr = v[..., 0], v[..., 1] - 128.0, v[..., 2] - 128.0
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255)


def samples(raw: bytes) -> np.ndarray:
    """(height, width, components) bytes without any change of colour space."""
    w, h, parts, _ = _coefficients(raw)
    return _stack(parts, w, h, 8).astype(np.uint8)


def decode(raw: bytes, m: int = 8) -> np.ndarray:
    """(height, width, 4) bytes at m/8 of the size, rounded up; chroma is repeated, not smoothed."""
    w, h, parts, adobe = _coefficients(raw)
    v = _stack(parts, scaled(w, m), scaled(h, m), m)
    out = np.full((*v.shape[:2], 4), 255, np.uint8)
    if len(parts) == 1:
        out[..., :3] = v
        return out
    rgb, letters = v[..., :3], bytes(p.key for p in parts[:3]) == b"RGB"
    if (len(parts) == 3 and adobe != 0 and not (adobe is None and letters)) or (len(parts) == 4 and adobe == 2):
        rgb = to_rgb(rgb)
        if len(parts) == 4:
            rgb = 255 - rgb
    if len(parts) == 4:
        rgb = np.floor(rgb * v[..., 3:] / 255 + 0.5)
    out[..., :3] = rgb
    return out


# ---- writing


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits, no code of ones alone."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(counts.items())] + [(0, -1, (None,))]  # None takes the code of ones
    heapq.heapify(heap)
    deep, tick = dict.fromkeys([None, *counts], 0), len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            deep[s] += 1
        tick += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
    if max(deep.values()) > 16:  # flatten: 256 symbols fit into 16 bits whatever their counts
        return _lengths({s: n // 2 + 1 for s, n in counts.items()})
    longest = max(deep, key=lambda s: (deep[s], s is None))
    if longest is not None and deep[longest] > deep[None]:
        deep[longest], deep[None] = deep[None], deep[longest]
    del deep[None]
    return deep


def _table(counts: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(the table as stored, code and length by symbol)."""
    deep = _lengths(counts)
    symbols = sorted(deep, key=lambda s: (deep[s], s))
    per, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= deep[s] - last
        last = deep[s]
        codes[s] = code, last
        per[last - 1] += 1
        code += 1
    return bytes(per) + bytes(symbols), codes


def quantisation(base: list[int], quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def encode(pixels: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG of (height, width, 1..4) bytes; an alpha channel is left out. Chroma is kept whole, codes fit the picture."""
    h, w, n = pixels.shape
    if not (0 < w < 65536 and 0 < h < 65536):
        raise ValueError("bad size")
    p = pixels[..., : 1 if n < 3 else 3].astype(np.float64)
    if n >= 3:
        r, g, b = p[..., 0], p[..., 1], p[..., 2]
        p = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], axis=-1)
    p = np.pad(p, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    basis, tables, units = _basis(8), [quantisation(LUMA, quality), quantisation(CHROMA, quality)], []
    down, across, k = p.shape[0] // 8, p.shape[1] // 8, p.shape[2]
    for c in range(k):
        f = np.einsum("uy,jyix,vx->jiuv", basis, p[..., c].reshape(down, 8, across, 8), basis, optimize=True).reshape(-1, 64)
        units.append(np.rint(f / tables[min(c, 1)]).astype(np.int64)[:, ZIGZAG])
    out, counts, last = [], [{}, {}, {}, {}], [0] * k

    def put(kind: int, s: int, value: int, bits: int) -> None:
        counts[kind][s] = counts[kind].get(s, 0) + 1
        out.append((kind, s, value if value >= 0 else value + (1 << bits) - 1, bits))

    for i in range(down * across):
        for c in range(k):
            block, t = units[c][i].tolist(), 2 * min(c, 1)
            d, last[c] = block[0] - last[c], block[0]
            put(t, abs(d).bit_length(), d, abs(d).bit_length())
            zeros, stop = 0, max((j for j in range(64) if block[j]), default=0)
            for v in block[1 : stop + 1]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    put(t + 1, 0xF0, 0, 0)
                    zeros -= 16
                put(t + 1, zeros << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                zeros = 0
            if stop < 63:
                put(t + 1, 0, 0, 0)
    made = [_table(c or {0: 1}) for c in counts[: 2 * min(k, 2)]]
    hold = have = 0
    coded = bytearray()
    for kind, s, value, bits in out:
        code, length = made[kind][1][s]
        hold, have = (hold << length | code) << bits | value, have + length + bits
        while have >= 8:
            have -= 8
            coded.append(hold >> have & 255)
        hold &= (1 << have) - 1
    if have:
        coded.append((hold << (8 - have) | (1 << (8 - have)) - 1) & 255)
    segment = lambda m, body: struct.pack(">BBH", 255, m, len(body) + 2) + body
    return b"".join(
        [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
        + [segment(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].tolist())) for i in range(min(k, 2))]
        + [segment(0xC0, struct.pack(">BHHB", 8, h, w, k) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(k)))]
        + [segment(0xC4, bytes([(i & 1) << 4 | i >> 1]) + t[0]) for i, t in enumerate(made)]
        + [segment(0xDA, bytes([k]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(k)) + b"\0\x3f\0")]
        + [bytes(coded).replace(b"\xff", b"\xff\0"), b"\xff\xd9"]
    )
