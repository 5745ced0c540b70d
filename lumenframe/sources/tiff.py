"""TIFF and BigTIFF: directories, samples, geographic tags.

A directory is a dict of tag to tuple; everything that reads pixels takes a
window, so only the strips or tiles that meet it are expanded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import jpeg

MAX_PIXELS = 1 << 28
MAX_SIDE = 1 << 24
MAX_ENTRIES = 65536
#: Field type: struct code and bytes. Fixed by the format.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def order(raw: bytes) -> tuple[str, bool, int]:
    """(byte order, whether BigTIFF, offset of the first directory)."""
    e = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if e is None or len(raw) < 8:
        raise ValueError("not a TIFF")
    magic = struct.unpack_from(e + "H", raw, 2)[0]
    if magic == 42:
        return e, False, struct.unpack_from(e + "I", raw, 4)[0]
    if magic == 43 and len(raw) >= 16:
        return e, True, struct.unpack_from(e + "Q", raw, 8)[0]
    raise ValueError("not a TIFF")


def directory(raw: bytes, at: int, e: str, big: bool = False) -> tuple[dict, int]:
    """(tags, offset of the next directory); entries that lie outside the file or have an unknown type are left out."""
    head, size, tail = ("Q", 20, "Q") if big else ("H", 12, "I")
    try:
        n = struct.unpack_from(e + head, raw, at)[0]
    except struct.error:
        raise ValueError("directory outside the file") from None
    if n > MAX_ENTRIES:
        raise ValueError("too many entries")
    at += struct.calcsize("=" + head)
    tags = {}
    for i in range(n):
        where = at + i * size
        if where + size > len(raw):
            break
        tag, kind = struct.unpack_from(e + "HH", raw, where)
        count = struct.unpack_from(e + ("Q" if big else "I"), raw, where + 4)[0]
        if kind not in TYPES:
            continue
        code, unit = TYPES[kind]
        room = 8 if big else 4
        place = where + size - room
        if count * unit > room:
            place = struct.unpack_from(e + tail, raw, place)[0]
        if place + count * unit > len(raw):
            continue
        if code == "s":
            body = raw[place : place + count]
            tags[tag] = (body.split(b"\0")[0][:65536].rstrip(b" "),) if kind == 2 else (body,)
        else:
            v = struct.unpack_from(f"{e}{count * len(code)}{code[0]}", raw, place)
            tags[tag] = tuple(zip(v[::2], v[1::2])) if len(code) == 2 else v
    end = at + n * size
    after = struct.unpack_from(e + tail, raw, end)[0] if end + struct.calcsize("=" + tail) <= len(raw) else 0
    return tags, after


def first(raw: bytes) -> tuple[dict, str]:
    e, big, at = order(raw)
    return directory(raw, at, e, big)[0], e


def _one(tags: dict, tag: int, default: int = 0):
    return tags[tag][0] if tags.get(tag) else default


# ---- compression


def lzw(data: bytes, most: int) -> bytes:
    """Codes from the most significant bit, one code earlier to the next width than need be."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, prior = start[:], 9, None
    out, n, hold, have = [], 0, 0, 0
    for byte in data:
        hold = (hold << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = hold >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, prior = start[:], 9, None
            continue
        if prior is None:
            if code > 255:
                raise ValueError("bad code")
            text = table[code]
        elif code < len(table):
            text = table[code]
            table.append(prior + text[:1])
        elif code == len(table):
            text = prior + prior[:1]
            table.append(text)
        else:
            raise ValueError("bad code")
        out.append(text)
        n += len(text)
        prior = text
        if n >= most:
            break
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)[:most]


def pack_bits(data: bytes, most: int) -> bytes:
    out, at, n = [], 0, 0
    while at < len(data) and n < most:
        k = data[at]
        if k < 128:
            out.append(data[at + 1 : at + 2 + k])
            at += 2 + k
        elif k > 128:
            out.append(data[at + 1 : at + 2] * (257 - k))
            at += 2
        else:
            at += 1
            continue
        n += len(out[-1])
    return b"".join(out)[:most]


def _deflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


CODECS = {1: lambda d, n: d[:n], 5: lzw, 8: _deflate, 32946: _deflate, 32773: pack_bits}
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

# ---- samples


class Layout:
    """What a directory says of its samples, checked."""

    def __init__(self, tags: dict, e: str):
        self.tags, self.e = tags, e
        self.width, self.height = _one(tags, 256), _one(tags, 257)
        self.samples = _one(tags, 277, 1)
        if not (0 < self.width <= MAX_SIDE and 0 < self.height <= MAX_SIDE) or self.width * self.height > MAX_PIXELS:
            raise ValueError("bad size")
        if not 1 <= self.samples <= 16:
            raise ValueError("bad number of samples")
        depths, formats = tags.get(258, (1,)), tags.get(339, (1,))
        if len(set(depths[: self.samples])) != 1 or len(set(formats[: self.samples])) != 1:
            raise ValueError("samples of different kinds")
        self.bits, self.format = depths[0], formats[0] if formats[0] in (1, 2, 3) else 1
        if not (1 <= self.bits <= 16 or self.bits in (32, 64)) or (self.format == 3 and self.bits not in (16, 32, 64)):
            raise ValueError("bad depth")
        self.codec, self.predictor, self.planar = _one(tags, 259, 1), _one(tags, 317, 1), _one(tags, 284, 1) == 2
        if self.codec == 7 and (self.bits != 8 or self.format != 1):
            raise ValueError("JPEG samples must be bytes")
        if self.codec not in CODECS and self.codec != 7:
            raise ValueError(f"compression {self.codec} is not read")
        self.photometric = _one(tags, 262, 1)
        if 322 in tags:
            self.chunk_w, self.chunk_h, where, sizes = _one(tags, 322), _one(tags, 323), 324, 325
            self.tiled = True
        else:
            self.chunk_w, self.chunk_h, where, sizes = self.width, min(_one(tags, 278, self.height), self.height), 273, 279
            self.tiled = False
        self.offsets, self.lengths = tags.get(where, ()), tags.get(sizes, ())
        if self.chunk_w < 1 or self.chunk_h < 1:
            raise ValueError("bad chunks")

    def chunks(self, x: int, y: int, w: int, h: int):
        """(index, plane, column, row) of the chunks that meet the window."""
        across, down = -(-self.width // self.chunk_w), -(-self.height // self.chunk_h)
        for p in range(self.samples if self.planar else 1):
            for j in range(y // self.chunk_h, (y + h - 1) // self.chunk_h + 1):
                for i in range(x // self.chunk_w, (x + w - 1) // self.chunk_w + 1):
                    yield (p * down + j) * across + i, p, i, j


def _unpack(lines: np.ndarray, per: int, bits: int, e: str, kind: int) -> np.ndarray:
    """(rows, per) samples of rows of bytes."""
    if kind == 3 or bits in (8, 16, 32, 64):
        code = {1: "u", 2: "i", 3: "f"}[kind]
        return np.ascontiguousarray(lines[:, : per * bits // 8]).view(f"{e}{code}{bits // 8}")
    flags = np.unpackbits(lines, axis=1)[:, : per * bits].reshape(len(lines), per, bits)
    v = flags @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
    return np.where(v >> (bits - 1) & 1, v - (1 << bits), v) if kind == 2 else v


def _jpeg_chunk(layout: Layout, body: bytes) -> np.ndarray:
    """Samples of one JPEG stream, whose tables may be kept apart; YCbCr becomes RGB."""
    tables = _one(layout.tags, 347, b"")
    if len(tables) > 4:
        body = tables[:-2] + body[2:]
    v = jpeg.samples(body)
    return jpeg.to_rgb(v).astype(np.uint8) if layout.photometric == 6 and v.shape[2] == 3 else v


def _paste(out: np.ndarray | None, v: np.ndarray, layout: Layout, window: tuple[int, int, int, int], plane: int, i: int, j: int) -> np.ndarray:
    """Puts the part of chunk (i, j) that lies in the window into the result."""
    x, y, w, h = window
    if out is None:
        out = np.zeros((h, w, layout.samples), v.dtype.newbyteorder("="))
    left, top = i * layout.chunk_w, j * layout.chunk_h
    x0, x1, y0, y1 = max(x, left), min(x + w, left + v.shape[1]), max(y, top), min(y + h, top + v.shape[0])
    at = slice(plane, plane + 1) if layout.planar else slice(None)
    out[y0 - y : y1 - y, x0 - x : x1 - x, at] = v[y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def read_samples(raw: bytes, layout: Layout, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """(height, width, samples) in the file's own type; the window is (x, y, width, height)."""
    x, y, w, h = window or (0, 0, layout.width, layout.height)
    if x < 0 or y < 0 or w < 1 or h < 1 or x + w > layout.width or y + h > layout.height:
        raise ValueError("window outside the image")
    out, n, cw = None, 1 if layout.planar else layout.samples, layout.chunk_w
    stride = (cw * n * layout.bits + 7) // 8
    for k, plane, i, j in layout.chunks(x, y, w, h):
        if k >= len(layout.offsets) or k >= len(layout.lengths):
            raise ValueError("chunk missing")
        rows = layout.chunk_h if layout.tiled else min(layout.chunk_h, layout.height - j * layout.chunk_h)
        body = raw[layout.offsets[k] : layout.offsets[k] + layout.lengths[k]]
        if layout.codec == 7:
            v = _jpeg_chunk(layout, body)[:rows, :cw]
            if v.shape != (rows, cw, n):
                raise ValueError("cut short")
            out = _paste(out, v, layout, (x, y, w, h), plane, i, j)
            continue
        if _one(layout.tags, 266, 1) == 2:
            body = body.translate(_MIRROR)
        flat = CODECS[layout.codec](body, rows * stride)
        if len(flat) < rows * stride:
            raise ValueError("cut short")
        lines = np.frombuffer(flat, np.uint8, rows * stride).reshape(rows, stride)
        if layout.predictor == 3:
            size = layout.bits // 8
            summed = np.cumsum(lines.reshape(rows, -1, n), axis=1, dtype=np.uint8).reshape(rows, size, cw * n)
            lines = np.ascontiguousarray((summed if layout.e == ">" else summed[:, ::-1]).transpose(0, 2, 1)).reshape(rows, stride)
        v = _unpack(lines, cw * n, layout.bits, layout.e, layout.format).reshape(rows, cw, n)
        if layout.predictor == 2:
            v = np.cumsum(v.view(v.dtype.newbyteorder("=")) if v.dtype.byteorder == "=" else v.astype(v.dtype.newbyteorder("=")), axis=1, dtype=v.dtype.newbyteorder("="))
            if layout.bits not in (8, 16, 32, 64):
                v = v & ((1 << layout.bits) - 1)
        out = _paste(out, v, layout, (x, y, w, h), plane, i, j)
    return out


def _levels(v: np.ndarray, bits: int, kind: int, top: int) -> np.ndarray:
    """Samples as integers 0..top, rounded to the nearest level."""
    if kind == 3:
        f = np.where(np.isfinite(v), v, 0).astype(np.float64)
        return np.floor(np.clip(f, 0, 1) * top + 0.5).astype(np.int64)
    most = (1 << (bits - 1 if kind == 2 else bits)) - 1
    if bits == 64:
        return np.floor(np.clip(v.astype(np.float64), 0, most) / most * top + 0.5).astype(np.int64)
    return (np.maximum(v.astype(np.int64), 0) * top + most // 2) // max(most, 1)


def decode(raw: bytes, top: int = 255) -> np.ndarray:
    """(height, width, 4) of levels 0..top: uint8 for 255, else uint16."""
    layout = Layout(*first(raw))
    v, p = read_samples(raw, layout), layout.photometric
    h, w, n = v.shape
    out = np.full((h, w, 4), top, np.int64)
    if p == 3:
        table = np.array(layout.tags.get(320, ()), np.int64)
        size = 1 << layout.bits
        if len(table) < 3 * size:
            raise ValueError("no palette")
        out[..., :3] = ((table[: 3 * size].reshape(3, size).T * top + 32767) // 65535)[v[..., 0].astype(np.int64)]
        colours = 1
    else:
        s = _levels(v, layout.bits, layout.format, top)
        if p in (0, 1):
            colours = 1
            out[..., :3] = top - s[..., :1] if p == 0 else s[..., :1]
        elif n >= 3 and (p == 2 or (p == 6 and layout.codec == 7)):
            colours = 3
            out[..., :3] = s[..., :3]
        elif p == 5 and n >= 4:
            colours = 4
            out[..., :3] = ((top - s[..., :3]) * (top - s[..., 3:4]) + top // 2) // top
        else:
            raise ValueError(f"photometric {p} is not read")
    extra = layout.tags.get(338, ())
    for k, kind in enumerate(extra):
        if kind in (1, 2) and colours + k < n:
            a = _levels(v[..., colours + k], layout.bits, layout.format, top)
            out[..., 3] = a
            if kind == 1:
                a = a[..., None]
                out[..., :3] = np.where(a > 0, np.minimum(top, (out[..., :3] * top + a // 2) // np.maximum(a, 1)), 0)
            break
    return out.astype(np.uint8 if top == 255 else np.uint16)


def size(raw: bytes) -> tuple[int, int, int]:
    layout = Layout(*first(raw))
    return layout.width, layout.height, 3 if layout.photometric == 3 else layout.samples


# ---- geographic tags


def geo(raw: bytes) -> dict:
    """Size, sample layout, pixel scale, tie points, transform, no-data value and EPSG code (a projected one first)."""
    tags, _ = first(raw)
    keys, wide = tags.get(34735, ()), {}
    for i in range(4, len(keys) - 3, 4):
        if keys[i + 1] == 0 and i // 4 <= keys[3]:
            wide[keys[i]] = keys[i + 3]
    text = _one(tags, 42113, b"")
    try:
        nothing = float(text) if text else None
    except ValueError:
        nothing = None
    code = lambda k: wide[k] if 0 < wide.get(k, 0) < 32767 else None
    return {
        "width": _one(tags, 256), "height": _one(tags, 257), "channels": _one(tags, 277, 1), "bits": _one(tags, 258, 1), "format": _one(tags, 339, 1),
        "scale": list(map(float, tags.get(33550, ()))), "tiepoints": list(map(float, tags.get(33922, ()))), "transform": list(map(float, tags.get(34264, ()))),
        "nodata": nothing, "epsg": code(3072) or code(2048),
    }


def geo_samples(raw: bytes, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """(height, width, channels) float32 of the window, channels as stored."""
    return read_samples(raw, Layout(*first(raw)), window).astype(np.float32)
