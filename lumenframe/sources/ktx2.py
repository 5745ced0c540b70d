"""KTX2 textures: header, mip levels, and the pixels of those that are not block-coded."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\xabKTX 20\xbb\r\n\x1a\n"
#: Vulkan formats whose texels are bytes: channels and whether they are sRGB. Fixed values.
PLAIN = {9: (1, False), 15: (1, True), 16: (2, False), 22: (2, True), 23: (3, False), 29: (3, True), 37: (4, False), 43: (4, True)}
SCHEMES = {0: "none", 1: "basis", 2: "zstd", 3: "zlib"}


def info(raw: bytes) -> dict:
    if raw[:12] != SIGNATURE or len(raw) < 80:
        raise ValueError("not a KTX2 file")
    kind, _, w, h, _, layers, faces, levels, scheme = struct.unpack_from("<9I", raw, 12)
    levels = max(levels, 1)
    if not w or levels > 32 or len(raw) < 80 + 24 * levels:
        raise ValueError("bad header")
    mips = [struct.unpack_from("<3Q", raw, 80 + 24 * i) for i in range(levels)]
    at, n = struct.unpack_from("<2I", raw, 48)
    block = raw[at : at + n] if n >= 28 else b""
    model, transfer = (block[12], block[14]) if block else (0, 0)
    samples = [block[28 + 16 * i + 3] for i in range((len(block) - 28) // 16)] if block else []
    alpha = any(s & 15 == 15 for s in samples) if model not in (163, 166) else (len(samples) > 1 if model == 163 else any(s & 15 in (3, 5) for s in samples))
    return {
        "width": w, "height": max(h, 1), "layers": max(layers, 1), "faces": max(faces, 1), "vk_format": kind, "scheme": SCHEMES.get(scheme, "unknown"),
        "coding": {163: "etc1s", 166: "uastc"}.get(model, "plain" if kind in PLAIN else "blocks"), "has_alpha": alpha or PLAIN.get(kind, (0,))[0] == 4, "srgb": transfer == 2 or PLAIN.get(kind, (0, False))[1],
        "levels": [(max(1, w >> i), max(1, max(h, 1) >> i), *m) for i, m in enumerate(mips)],
    }


def decode(raw: bytes, level: int = 0) -> np.ndarray:
    """(height, width, 4) bytes of the first layer and face of a level; Basis payloads need a transcoder."""
    got = info(raw)
    if got["vk_format"] not in PLAIN:
        raise ValueError(f"{got['coding']} payloads are not transcoded")
    if level >= len(got["levels"]):
        raise ValueError("no such level")
    w, h, at, n, full = got["levels"][level]
    k = PLAIN[got["vk_format"]][0]
    need = w * h * k
    body = raw[at : at + n]
    if got["scheme"] == "zlib":
        body = zlib.decompressobj().decompress(body, need)
    elif got["scheme"] == "zstd":
        import zstandard

        body = zstandard.ZstdDecompressor().stream_reader(body).read(need)
    elif got["scheme"] != "none":
        raise ValueError("unknown compression")
    if len(body) < need:
        raise ValueError("cut short")
    out = np.zeros((h, w, 4), np.uint8)
    out[..., 3] = 255
    out[..., :k] = np.frombuffer(body, np.uint8, need).reshape(h, w, k)
    return out
