"""EXIF: where it lies in a file, its fields as a record, orientation, thumbnail."""

from __future__ import annotations

import re
import struct

import numpy as np

from . import boxes, png, tiff


def _jpeg_segments(raw: bytes):
    """(marker, data) of the segments up to the first scan."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        n = struct.unpack_from(">H", raw, at + 2)[0]
        if n < 2:
            return
        yield marker, raw[at + 4 : at + 2 + n]
        at += 2 + n


def find(raw: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG, WebP, HEIF, CR3 or TIFF file, None if there is none."""
    if raw[:2] == b"\xff\xd8":
        return next((d[6:] for m, d in _jpeg_segments(raw) if m == 0xE1 and d[:6] == b"Exif\0\0"), None)
    if raw[:8] == png.SIGNATURE:
        return next((d for k, d in png.chunks(raw) if k == b"eXIf"), None)
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(raw):
            kind, n = struct.unpack_from("<4sI", raw, at)
            if kind == b"EXIF":
                body = raw[at + 8 : at + 8 + n]
                return body[6:] if body[:6] == b"Exif\0\0" else body
            at += 8 + n + n % 2
        return None
    if boxes.is_heif(raw):
        body = boxes.heif_item(raw, "Exif")
        return body[4 + struct.unpack_from(">I", body)[0] :] if body and len(body) > 8 else None
    if boxes.is_cr3(raw):
        return boxes.cr3_metadata(raw).get(b"CMT1")
    return raw if raw[:4] in (b"II*\0", b"MM\0*") else None


def _tables(block: bytes) -> tuple[dict, dict, dict, dict]:
    """Tags of the image, the exposure, the place and the thumbnail."""
    e, big, at = tiff.order(block)
    main, after = tiff.directory(block, at, e, big)

    def sub(tag: int) -> dict:
        try:
            return tiff.directory(block, main[tag][0], e, big)[0] if main.get(tag) else {}
        except ValueError:
            return {}

    try:
        thumb = tiff.directory(block, after, e, big)[0] if after else {}
    except ValueError:
        thumb = {}
    return main, sub(0x8769), sub(0x8825), thumb


def _apart(raw: bytes) -> tuple[dict, dict, dict]:
    """The image's, the exposure's and the place's tags; a CR3 keeps each in a block of its own."""
    block = find(raw)
    if block is None:
        raise ValueError("no EXIF")
    main, shot, place, _ = _tables(block)
    if boxes.is_cr3(raw):
        more = boxes.cr3_metadata(raw)
        shot, place = (tiff.first(more[k])[0] if k in more else {} for k in (b"CMT2", b"CMT4"))
    return main, shot, place


def upright(p: np.ndarray, orientation: int) -> np.ndarray:
    """The eight orientations, stored to displayed."""
    if orientation in (5, 6, 7, 8):
        p = p.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        p = p[:, ::-1]
    if orientation in (3, 4, 7, 8):
        p = p[::-1]
    return np.ascontiguousarray(p)


def turned(degrees: int, mirror: int | None) -> int:
    """The orientation of an anticlockwise rotation and then a mirror (0: top to bottom, 1: left to right, None: none)."""
    probe = np.arange(4).reshape(2, 2)
    want = np.rot90(probe, degrees // 90)
    want = want if mirror is None else want[:, ::-1] if mirror else want[::-1]
    return next(k for k in range(1, 9) if (upright(probe, k) == want).all())


def orientation(raw: bytes) -> int:
    """1 to 8, 1 if the file does not say. A HEIF's is its rotation and mirror."""
    try:
        if boxes.is_heif(raw):
            got = boxes.heif_info(raw)
            return turned(got["rotation"], got["mirror"])
        v = (_tables(find(raw) or b"")[0].get(0x112) or (1,))[0]
    except (ValueError, IndexError, struct.error):
        return 1
    return v if isinstance(v, int) and 1 <= v <= 8 else 1


def thumbnail(raw: bytes) -> bytes | None:
    """The JPEG bytes of the embedded thumbnail."""
    block = find(raw)
    if block is None:
        return None
    try:
        thumb = _tables(block)[3]
    except (ValueError, struct.error):
        return None
    if not (thumb.get(0x201) and thumb.get(0x202)):
        return None
    at, n = thumb[0x201][0], thumb[0x202][0]
    body = block[at : at + n]
    return body if n and len(body) == n and body[:2] == b"\xff\xd8" else None


def exposure_text(seconds: float) -> str:
    """1/N below a quarter of a second, or within 1% of such; else seconds with one decimal."""
    n = int(1 / seconds + 0.5)
    if seconds < 0.25 or (n > 1 and abs(1 / seconds - n) <= 0.01 * n):
        return f"1/{n}"
    return f"{seconds:.1f}"


def iso_time(text: str, fraction: str = "") -> str | None:
    """YYYY-MM-DDTHH:MM:SS, with the digits of the fraction; None for dates that are not there."""
    m = re.match(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", text)
    if not m or m[1] == "0000":
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    if not (1 <= mo <= 12 and 1 <= d <= 31 and h < 24 and mi < 60 and s < 61):
        return None
    digits = re.match(r"\d*", fraction)[0]
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}" + (f".{digits}" if digits else "")


def _ratio(v) -> float | None:
    if not v:
        return None
    a = v[0]
    if isinstance(a, tuple):
        return a[0] / a[1] if a[1] else None
    return float(a) if isinstance(a, (int, float)) else None


def _degrees(v, ref: bytes, negative: bytes) -> float | None:
    parts = [_ratio((p,)) for p in (v or ())[:3]]
    if len(parts) < 3 or any(p is None for p in parts):
        return None
    d = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -d if ref[:1].upper() == negative else d


#: Field and its Spark type, in the order of `record`.
FIELDS = [("make", "string"), ("model", "string"), ("lens", "string"), ("taken", "string"), ("exposure", "string"), ("exposure_seconds", "double"), ("f_number", "double"), ("iso", "int"), ("focal_mm", "double"), ("orientation", "int"), ("latitude", "double"), ("longitude", "double"), ("altitude", "double")]


def record(raw: bytes) -> tuple:
    """The camera, exposure and place fields; absent ones are None."""
    main, shot, place = _apart(raw)
    text = lambda t, k: (t[k][0].decode("utf-8", "replace").strip() or None) if t.get(k) and isinstance(t[k][0], bytes) else None
    seconds = _ratio(shot.get(0x829A))
    iso = (shot.get(0x8827) or (None,))[0]
    height = _ratio(place.get(6))
    if height is not None and (place.get(5) or (0,))[0] == 1:
        height = -height
    ref = lambda k: place[k][0] if place.get(k) and isinstance(place[k][0], bytes) else b""
    return (
        text(main, 0x10F), text(main, 0x110), text(shot, 0xA434),
        iso_time(text(shot, 0x9003) or text(main, 0x132) or "", text(shot, 0x9291) or ""),
        exposure_text(seconds) if seconds and seconds > 0 else None, seconds, _ratio(shot.get(0x829D)), iso if isinstance(iso, int) else None, _ratio(shot.get(0x920A)),
        orientation(raw), _degrees(place.get(2), ref(1), b"S"), _degrees(place.get(4), ref(3), b"W"), height,
    )
