"""ISO base media containers: HEIF/AVIF descriptions and the previews inside CR3 files.

Pixels coded with HEVC or AV1 need a decoder that the host registers (`images.register_codec`).
"""

from __future__ import annotations

import struct

#: Boxes whose body is more boxes, and the bytes before those. Fixed by the format.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"iprp": 0, b"ipco": 0, b"meta": 4}
# The identifiers of the boxes that hold CR3 metadata and preview.
CR3_META = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
CR3_PREVIEW = bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16")


def walk(raw: bytes, at: int = 0, end: int | None = None):
    """(type, start, end) of the boxes side by side; ends at the first that does not fit."""
    end = len(raw) if end is None else end
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", raw, at)
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            return
        yield kind, at + head, at + n
        at += n


def find(raw: bytes, path: list[bytes], at: int = 0, end: int | None = None):
    """(start, end) of every box at the path."""
    for kind, a, b in walk(raw, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from find(raw, path[1:], a + NESTED.get(kind, 0), b)


def brands(raw: bytes) -> list[str]:
    for a, b in find(raw, [b"ftyp"]):
        return [raw[a : a + 4].decode("latin-1")] + [raw[i : i + 4].decode("latin-1") for i in range(a + 8, b - 3, 4)]
    return []


def is_heif(raw: bytes) -> bool:
    return bool({"heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "avif", "avis", "mif2"} & set(brands(raw[:4096])))


def _wide(raw: bytes, wide: bool, at: int) -> tuple[int, int]:
    """(a number of four or two bytes, the place after it)."""
    return (struct.unpack_from(">I", raw, at)[0], at + 4) if wide else (struct.unpack_from(">H", raw, at)[0], at + 2)


def _items(raw: bytes, a: int, b: int) -> dict[int, str]:
    """Item numbers and their types."""
    kinds = {}
    for s, e in find(raw, [b"iinf"], a, b):
        for kind, s2, _ in walk(raw, s + (8 if raw[s] else 6), e):
            if kind == b"infe" and raw[s2] >= 2:
                item, at = _wide(raw, raw[s2] > 2, s2 + 4)
                kinds[item] = raw[at + 2 : at + 6].decode("latin-1")
    return kinds


def heif_item(raw: bytes, kind: str) -> bytes | None:
    """The bytes of the first item of a type, None if there is none or it lies outside the file."""
    meta = next(find(raw, [b"meta"]), None)
    if meta is None:
        return None
    a, b = meta[0] + 4, meta[1]
    wanted = next((i for i, k in _items(raw, a, b).items() if k == kind), None)
    number = lambda at, n: int.from_bytes(raw[at : at + n], "big")
    data = next(find(raw, [b"idat"], a, b), (0, 0))
    for s, _ in find(raw, [b"iloc"], a, b):
        version, sizes = raw[s], raw[s + 4 : s + 6]
        off, length, base, index = sizes[0] >> 4, sizes[0] & 15, sizes[1] >> 4, sizes[1] & 15 if version else 0
        n, at = _wide(raw, version == 2, s + 6)
        for _ in range(n):
            item, at = _wide(raw, version == 2, at)
            inside = version > 0 and raw[at + 1] & 15 == 1
            at += 4 if version else 2
            start, at = number(at, base), at + base
            pieces, at = number(at, 2), at + 2
            out = b""
            for _ in range(pieces):
                at += index
                first, size = number(at, off) + start + (data[0] if inside else 0), number(at + off, length)
                at += off + length
                if item == wanted:
                    if first + size > len(raw):
                        return None
                    out += raw[first : first + size] if size else raw[first:]
            if item == wanted:
                return out
    return None


def heif_info(raw: bytes) -> dict:
    """Size as displayed before rotation, coding, bits, alpha, rotation, mirror, thumbnails and number of items."""
    meta = next(find(raw, [b"meta"]), None)
    if not is_heif(raw) or meta is None:
        raise ValueError("not a HEIF")
    a, b = meta[0] + 4, meta[1]
    wide = lambda v, at: _wide(raw, v, at)
    primary = next((wide(raw[s], s + 4)[0] for s, _ in find(raw, [b"pitm"], a, b)), None)
    kinds = _items(raw, a, b)
    props = [p for s, e in find(raw, [b"iprp", b"ipco"], a, b) for p in walk(raw, s, e)]
    has: dict[int, list[int]] = {}
    for s, _ in find(raw, [b"iprp", b"ipma"], a, b):
        big, at = raw[s + 3] & 1, s + 8
        for _ in range(struct.unpack_from(">I", raw, s + 4)[0]):
            item, at = wide(raw[s] > 0, at)
            n, at = raw[at], at + 1
            for _ in range(n):
                k = struct.unpack_from(">H", raw, at)[0] & 0x7FFF if big else raw[at] & 0x7F
                at += 2 if big else 1
                has.setdefault(item, []).append(k - 1)
    links = []
    for s, e in find(raw, [b"iref"], a, b):
        for kind, s2, _ in walk(raw, s + 4, e):
            source, at = wide(raw[s], s2)
            n, at = struct.unpack_from(">H", raw, at)[0], at + 2
            for _ in range(n):
                target, at = wide(raw[s], at)
                links.append((kind, source, target))

    def of(item: int, kind: bytes):
        return next((props[k][1] for k in has.get(item, []) if 0 <= k < len(props) and props[k][0] == kind), None)

    def extent(item: int) -> tuple[int, int]:
        at = of(item, b"ispe")
        return struct.unpack_from(">II", raw, at + 4) if at is not None else (0, 0)

    if primary is None or extent(primary) == (0, 0):
        raise ValueError("no primary image")
    turn, flip, bits = of(primary, b"irot"), of(primary, b"imir"), of(primary, b"pixi")
    auxiliary = [s for k, s, t in links if k == b"auxl" and t == primary]

    def is_alpha(item: int) -> bool:
        at = of(item, b"auxC")
        return at is not None and (raw[at + 4 : at + 60].split(b"\0")[0].endswith(b"alpha") or b"auxid:1" in raw[at + 4 : at + 60].split(b"\0")[0])

    w, h = extent(primary)
    return {
        "brands": brands(raw), "width": w, "height": h, "coding": kinds.get(primary, ""), "bits": raw[bits + 5] if bits is not None else 8, "items": len(kinds),
        "rotation": (raw[turn] & 3) * 90 if turn is not None else 0, "mirror": raw[flip] & 1 if flip is not None else None, "has_alpha": any(map(is_alpha, auxiliary)),
        "thumbnails": [dict(zip(("item", "width", "height"), (s, *extent(s)))) for k, s, t in links if k == b"thmb" and t == primary],
    }


def pick_thumbnail(sizes: list[tuple[int, int]], least: int) -> int:
    """Index of the smallest whose short side is at least `least`, else of the largest."""
    enough = [i for i, s in enumerate(sizes) if min(s) >= least]
    key = lambda i: sizes[i][0] * sizes[i][1]
    return min(enough, key=key) if enough else max(range(len(sizes)), key=key)


def is_cr3(raw: bytes) -> bool:
    return raw[4:12] == b"ftypcrx "


def cr3_metadata(raw: bytes) -> dict[bytes, bytes]:
    """The TIFF blocks CMT1 (image), CMT2 (exposure), CMT3 (maker) and CMT4 (place)."""
    out = {}
    for a, b in find(raw, [b"moov", b"uuid"]):
        if raw[a : a + 16] == CR3_META:
            out |= {k: raw[s:e] for k, s, e in walk(raw, a + 16, b) if k[:3] == b"CMT"}
    return out


def cr3_jpegs(raw: bytes) -> dict[str, bytes]:
    """The thumbnail, preview and full JPEGs of a CR3 file that lie wholly in the bytes given."""
    out = {}

    def inner(name: str, at: int, end: int, tag: bytes) -> None:
        for kind, a, b in walk(raw, at, end):
            if kind == tag:
                start = raw.find(b"\xff\xd8\xff", a, b)
                if start >= 0:
                    out[name] = raw[start:b]

    for a, b in find(raw, [b"moov", b"uuid"]):
        if raw[a : a + 16] == CR3_META:
            inner("thumbnail", a + 16, b, b"THMB")
    for a, b in find(raw, [b"uuid"]):
        if raw[a : a + 16] == CR3_PREVIEW:
            inner("preview", a + 24, b, b"PRVW")
    for a, b in find(raw, [b"moov", b"trak", b"mdia", b"minf", b"stbl"]):
        where = next(find(raw, [b"co64"], a, b), None)
        sizes = next(find(raw, [b"stsz"], a, b), None)
        if where and sizes and where[1] - where[0] >= 16 and sizes[1] - sizes[0] >= 12:
            at, n = struct.unpack_from(">Q", raw, where[0] + 8)[0], struct.unpack_from(">I", raw, sizes[0] + 4)[0]
            n = n or (struct.unpack_from(">I", raw, sizes[0] + 12)[0] if sizes[1] - sizes[0] >= 16 else 0)
            body = raw[at : at + n]
            if body[:3] == b"\xff\xd8\xff" and len(body) == n:
                out["full"] = body
                break
    return out
