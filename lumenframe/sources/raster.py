"""BMP, TGA, PNM and ICO bytes to (height, width, 4) bytes."""

from __future__ import annotations

import re
import struct

import numpy as np

from . import png

MAX_PIXELS = png.MAX_PIXELS


def _check(w: int, h: int) -> None:
    if w < 1 or h < 1:
        raise ValueError("bad header")
    if w * h > MAX_PIXELS:
        raise ValueError("too large")


def _bits(lines: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, most significant first, of rows of bytes."""
    if depth == 8:
        return lines[:, :width]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :width].astype(np.uint8)


def _rows(raw: bytes, at: int, height: int, stride: int) -> np.ndarray:
    if at < 0 or len(raw) < at + height * stride:
        raise ValueError("cut short")
    return np.frombuffer(raw, np.uint8, height * stride, at).reshape(height, stride)


# ---- BMP


def _field(v: np.ndarray, mask: int) -> np.ndarray:
    """The masked bits of each value, stretched to 0..255."""
    if not mask:
        return np.zeros(v.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((((v & mask) >> low).astype(np.uint64) * 255 + top // 2) // top).astype(np.uint8)


def bmp_size(raw: bytes) -> tuple[int, int, int]:
    if raw[:2] != b"BM" or len(raw) < 26:
        raise ValueError("not a BMP")
    return _dib_size(raw, 14)


def _dib_size(raw: bytes, at: int) -> tuple[int, int, int]:
    size = struct.unpack_from("<I", raw, at)[0]
    if size == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", raw, at + 4)
    else:
        w, h, _, depth = struct.unpack_from("<iiHH", raw, at + 4)
    return w, abs(h), 4 if depth == 32 else 3


def _run_lengths(raw: bytes, at: int, w: int, h: int, depth: int) -> np.ndarray:
    """Indices of a run-length coded BMP, bottom row first."""
    out, x, y = np.zeros((h, w), np.uint8), 0, 0
    while at + 2 <= len(raw) and y < h:
        n, v = raw[at], raw[at + 1]
        at += 2
        if n:
            run = [v] * n if depth == 8 else [v >> 4, v & 15] * ((n + 1) // 2)
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + raw[at], y + raw[at + 1], at + 2
            continue
        else:
            n, used = v, v if depth == 8 else (v + 1) // 2
            body = raw[at : at + used]
            run = list(body) if depth == 8 else [k for b in body for k in (b >> 4, b & 15)]
            at += used + used % 2
        run = run[: max(0, min(n, w - x))]
        out[y, x : x + len(run)] = run
        x += n
    return out


def _dib(raw: bytes, at: int, data: int | None, halved: bool = False) -> tuple[np.ndarray, int, bool]:
    """(pixels, end of the pixel data, whether alpha is stored) of a device-independent bitmap."""
    size = struct.unpack_from("<I", raw, at)[0]
    pack, used, masks = 0, 0, None
    if size == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", raw, at + 4)
    else:
        w, h, _, depth, pack, _, _, _, used = struct.unpack_from("<iiHHIIiiI", raw, at + 4)
    down, h = h < 0, abs(h) // (2 if halved else 1)
    _check(w, h)
    after = at + size
    if pack in (3, 6):
        n = 4 if size >= 56 or pack == 6 else 3
        masks = struct.unpack_from(f"<{n}I", raw, at + 40) + (0,) * (4 - n)
        after += 0 if size >= 52 else 4 * n
    elif depth == 16:
        masks = (0x7C00, 0x3E0, 0x1F, 0)
    entry, palette = 3 if size == 12 else 4, None
    if depth <= 8:
        count = min(used or 1 << depth, 256)
        if data is not None:
            count = min(count, max(0, data - after) // entry)
        found = _rows(raw, after, count, entry)[:, 2::-1]
        palette = np.zeros((256, 3), np.uint8)
        palette[:count] = found
        after += count * entry
    data = after if data is None else data
    stride = (w * depth + 31) // 32 * 4
    out, alpha = np.full((h, w, 4), 255, np.uint8), False
    if pack in (1, 2):
        out[..., :3] = palette[_run_lengths(raw, data, w, h, 8 if pack == 1 else 4)]
    elif depth in (1, 2, 4, 8):
        out[..., :3] = palette[_bits(_rows(raw, data, h, stride), w, depth)]
    elif depth == 24:
        out[..., :3] = _rows(raw, data, h, stride)[:, : w * 3].reshape(h, w, 3)[..., ::-1]
    elif depth in (16, 32):
        v = np.ascontiguousarray(_rows(raw, data, h, stride)).view("<u2" if depth == 16 else "<u4")[:, :w].astype(np.uint32)
        m = masks or (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
        for c in range(3):
            out[..., c] = _field(v, m[c])
        if m[3] and (a := _field(v, m[3])).any():
            out[..., 3], alpha = a, True
    else:
        raise ValueError("bad depth")
    return (out if down else out[::-1]), data + h * stride, alpha


def bmp(raw: bytes) -> np.ndarray:
    bmp_size(raw)
    return np.ascontiguousarray(_dib(raw, 14, struct.unpack_from("<I", raw, 10)[0])[0])


# ---- ICO and CUR


def _entries(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(width, height, depth, length, offset) of the images in an icon file."""
    if len(raw) < 6 or raw[:2] != b"\0\0" or raw[2:4] not in (b"\1\0", b"\2\0"):
        raise ValueError("not an icon")
    out = []
    for i in range(struct.unpack_from("<H", raw, 4)[0]):
        if 22 + 16 * i > len(raw):
            break
        w, h, _, _, _, depth, n, at = struct.unpack_from("<BBBBHHII", raw, 6 + 16 * i)
        body = raw[at : at + n]
        try:
            if body[:8] == png.SIGNATURE:
                w, h, d, colour, _ = png.header(body)
                depth = d * png.CHANNELS[colour]
            else:
                w, h, depth = struct.unpack_from("<ii", body, 4) + struct.unpack_from("<H", body, 14)
                h = abs(h) // 2
        except (struct.error, ValueError):
            continue
        if 0 < w <= 16384 and 0 < h <= 16384:
            out.append((w, h, depth, n, at))
    if not out:
        raise ValueError("no image in the icon")
    return out


def _best(raw: bytes) -> tuple[int, int, int, int, int]:
    return max(_entries(raw), key=lambda e: (e[0] * e[1], e[2]))


def ico_size(raw: bytes) -> tuple[int, int, int]:
    w, h, *_ = _best(raw)
    return w, h, 4


def ico(raw: bytes) -> np.ndarray:
    """The image with most pixels, of equal ones the deepest."""
    _, _, depth, n, at = _best(raw)
    body = raw[at : at + n]
    if body[:8] == png.SIGNATURE:
        return png.decode(body)
    out, end, alpha = _dib(body, 0, None, halved=True)
    out = np.ascontiguousarray(out)
    if depth != 32 or not alpha:
        h, w = out.shape[:2]
        stride = (w + 31) // 32 * 4
        if len(body) >= end + h * stride:
            out[..., 3] = np.where(_bits(_rows(body, end, h, stride), w, 1)[::-1], 0, 255)
    return out


# ---- TGA


def tga_size(raw: bytes) -> tuple[int, int, int]:
    if len(raw) < 18:
        raise ValueError("not a TGA")
    mapped, kind, w, h, depth = raw[1], raw[2], *struct.unpack_from("<HH", raw, 12), raw[16]
    if mapped > 1 or kind not in (1, 2, 3, 9, 10, 11) or depth not in (8, 15, 16, 24, 32) or not w or not h or (kind & 7 == 1) != (mapped == 1):
        raise ValueError("not a TGA")
    gray = kind & 7 == 3
    deep = raw[7] if mapped else depth
    return w, h, (2 if depth == 16 else 1) if gray else 4 if deep == 32 else 3


def _tga_colours(v: np.ndarray, depth: int, gray: bool) -> np.ndarray:
    """Pixels of (n, bytes) raw colours."""
    out = np.full((len(v), 4), 255, np.uint8)
    if gray:
        out[:, :3] = v[:, :1]
        if depth == 16:
            out[:, 3] = v[:, 1]
    elif depth in (15, 16):
        word = v.astype(np.uint32) @ np.array([1, 256], np.uint32)
        for c, mask in enumerate((0x7C00, 0x3E0, 0x1F)):
            out[:, c] = _field(word, mask)
    else:
        out[:, :3] = v[:, 2::-1]
        if depth == 32:
            out[:, 3] = v[:, 3]
    return out


def tga(raw: bytes) -> np.ndarray:
    w, h, _ = tga_size(raw)
    _check(w, h)
    kind, first, count, map_depth, depth, flags = raw[2], *struct.unpack_from("<HHB", raw, 3), raw[16], raw[17]
    at, size, n = 18 + raw[0], (depth + 7) // 8, w * h
    palette = None
    if raw[1]:
        k = (map_depth + 7) // 8
        palette = _tga_colours(_rows(raw, at, count, k), map_depth, False)
        at += count * k
    if kind < 8:
        v = _rows(raw, at, n, size)
    else:
        parts, got = [], 0
        while got < n:
            if at >= len(raw):
                raise ValueError("cut short")
            run = (raw[at] & 127) + 1
            if raw[at] & 128:
                parts.append(np.repeat(_rows(raw, at + 1, 1, size), run, axis=0))
                at += 1 + size
            else:
                parts.append(_rows(raw, at + 1, run, size))
                at += 1 + run * size
            got += run
        v = np.concatenate(parts)[:n]
    if palette is not None:
        i = (v[:, 0] if size == 1 else v.astype(np.int64) @ np.array([1, 256])).astype(np.int64) - first
        if len(palette) == 0:
            raise ValueError("no palette")
        out = palette[np.where((i < 0) | (i >= len(palette)), 0, i)]
    else:
        out = _tga_colours(v, depth, kind & 7 == 3)
    out = out.reshape(h, w, 4)
    out = out if flags & 32 else out[::-1]
    return np.ascontiguousarray(out[:, ::-1] if flags & 16 else out)


# ---- PNM: P5 and P6

_PNM = re.compile(rb"P([56])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)\s")


def _pnm(raw: bytes) -> tuple[int, int, int, int, int]:
    m = _PNM.match(raw[:65536])
    if not m:
        raise ValueError("not a PNM")
    kind, w, h, most = (int(m[i]) for i in (1, 3, 5, 7))
    if not 0 < most < 65536:
        raise ValueError("bad header")
    _check(w, h)
    return w, h, 3 if kind == 6 else 1, most, m.end()


def pnm_size(raw: bytes) -> tuple[int, int, int]:
    return _pnm(raw)[:3]


def pnm_samples(raw: bytes) -> tuple[np.ndarray, int]:
    """((height, width, channels) as stored, bits a sample)."""
    w, h, n, most, at = _pnm(raw)
    k = 2 if most > 255 else 1
    lines = _rows(raw, at, h, w * n * k)
    return (np.ascontiguousarray(lines).view(">u2").astype(np.uint16) if k == 2 else lines).reshape(h, w, n), 8 * k


def pnm(raw: bytes) -> np.ndarray:
    v, bits = pnm_samples(raw)
    out = np.full((*v.shape[:2], 4), 255, np.uint8)
    out[..., :3] = v >> (bits - 8)
    return out
