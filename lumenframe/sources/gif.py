"""GIF: frames composed onto the canvas, counts and loops."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAX_PIXELS = 1 << 28


@dataclass
class Block:
    """One image of the file, not yet decoded."""

    x: int
    y: int
    width: int
    height: int
    palette: np.ndarray | None
    interlaced: bool
    bits: int
    data: bytes
    delay_ms: int
    disposal: int
    clear: int  # transparent index or -1


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("cut short")
        n = raw[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(raw):
            raise ValueError("cut short")
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 128:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(raw):
        raise ValueError("cut short")
    return np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def walk(raw: bytes) -> Iterator[Block | int]:
    """Blocks in order; a bare int is the number of plays the file asks for (0: for ever)."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    shared, at = _palette(raw, 13, raw[10])
    delay, disposal, clear = 0, 0, -1
    while at < len(raw) and raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            label = raw[at + 1] if at + 1 < len(raw) else 0
            body, after = _sub_blocks(raw, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, cs, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear = cs * 10, flags >> 2 & 7, index if flags & 1 else -1
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                n = struct.unpack_from("<H", body, 12)[0]
                yield n + 1 if n else 0
            at = after
        elif kind == 0x2C:
            if at + 11 > len(raw):
                raise ValueError("cut short")
            x, y, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
            own, at = _palette(raw, at + 10, flags)
            if at >= len(raw):
                raise ValueError("cut short")
            bits = raw[at]
            data, at = _sub_blocks(raw, at + 1)
            yield Block(x, y, w, h, shared if own is None else own, bool(flags & 64), bits, data, delay, disposal, clear)
            delay, disposal, clear = 0, 0, -1
        else:
            raise ValueError("bad block")


def size(raw: bytes) -> tuple[int, int, int]:
    """(width, height, 4); a screen of no size takes the extent of its frames."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    w, h = struct.unpack_from("<HH", raw, 6)
    if not (w and h):
        frames = [b for b in walk(raw) if isinstance(b, Block)]
        w, h = (max((e for e in ends), default=0) for ends in ([b.x + b.width for b in frames], [b.y + b.height for b in frames]))
    if not (w and h):
        raise ValueError("no size")
    if w * h > MAX_PIXELS:
        raise ValueError("too large")
    return w, h, 4


def frame_count(raw: bytes) -> int:
    """Number of frames, 0 if the file is malformed."""
    try:
        return sum(isinstance(b, Block) for b in walk(raw))
    except (ValueError, IndexError, struct.error):
        return 0


def plays(raw: bytes) -> int:
    """How often the file asks to be played: 1 if it does not say, 0 for ever."""
    return next((b for b in walk(raw) if isinstance(b, int)), 1)


def unpack(data: bytes, bits: int, total: int) -> bytes:
    """LZW codes, least significant bit first, to at most `total` indices."""
    if not 1 <= bits <= 11:
        raise ValueError("bad code size")
    clear, end = 1 << bits, (1 << bits) + 1
    start = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    table, width, prior = start[:], bits + 1, None
    out, n, hold, have = [], 0, 0, 0
    for byte in data:
        hold |= byte << have
        have += 8
        while have >= width:
            code = hold & ((1 << width) - 1)
            hold >>= width
            have -= width
            if code == clear:
                table, width, prior = start[:], bits + 1, None
                continue
            if code == end:
                return b"".join(out)[:total]
            if prior is None:
                if code >= clear:
                    raise ValueError("bad code")
                text = table[code]
            elif code < len(table):
                text = table[code]
                if len(table) < 4096:
                    table.append(prior + text[:1])
            elif code == len(table) and len(table) < 4096:
                text = prior + prior[:1]
                table.append(text)
            else:
                raise ValueError("bad code")
            out.append(text)
            n += len(text)
            prior = text
            if n >= total:
                return b"".join(out)[:total]
            if len(table) == 1 << width and width < 12:
                width += 1
    return b"".join(out)[:total]


def frames(raw: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(canvas as (height, width, 4) bytes, delay in ms) of each frame in turn."""
    w, h, _ = size(raw)
    canvas = np.zeros((h, w, 4), np.uint8)
    for b in walk(raw):
        if isinstance(b, int):
            continue
        before = canvas.copy() if b.disposal == 3 else None
        flat = np.frombuffer(unpack(b.data, b.bits, b.width * b.height).ljust(b.width * b.height, b"\0"), np.uint8).reshape(b.height, b.width)
        if b.interlaced:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, b.height, step)]
            lines = np.empty_like(flat)
            lines[order] = flat
            flat = lines
        if b.palette is None:
            raise ValueError("no palette")
        colours = np.zeros((256, 3), np.uint8)
        colours[: len(b.palette)] = b.palette
        part = flat[: max(0, h - b.y), : max(0, w - b.x)]
        area = canvas[b.y : b.y + part.shape[0], b.x : b.x + part.shape[1]]
        seen = part != b.clear
        area[seen, :3] = colours[part[seen]]
        area[seen, 3] = 255
        yield canvas.copy(), b.delay_ms
        if b.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def decode(raw: bytes) -> np.ndarray:
    """The first frame."""
    for pixels, _ in frames(raw):
        return pixels
    raise ValueError("no frame")
