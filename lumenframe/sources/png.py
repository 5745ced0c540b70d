"""PNG bytes: header, text, pixels, writing. Functions of bytes, and DataFrame operators over a `content` column."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MAX_PIXELS = 1 << 28
MAX_TEXT = 16 << 20


def chunks(raw: bytes):
    """(type, data) of the chunks whose checksum holds, up to the end or the first cut."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(raw):
            return
        if zlib.crc32(kind + data) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]:
            yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return


def header(raw: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, depth, colour type, interlace)."""
    kind, data = next(chunks(raw), (b"", b""))
    if kind != b"IHDR" or len(data) != 13:
        raise ValueError("no header")
    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", data)
    if not (w and h and colour in CHANNELS):
        raise ValueError("bad header")
    return w, h, depth, colour, lace


def _inflate(data: bytes, most: int) -> bytes:
    z = zlib.decompressobj()
    out = z.decompress(data, most)
    if z.unconsumed_tail:
        raise ValueError("too large")
    return out


def texts(raw: bytes) -> list[tuple[str, str]]:
    """(keyword, text) in order, repeats kept; malformed chunks are skipped."""
    out = []
    for kind, data in chunks(raw):
        try:
            key, _, rest = data.partition(b"\0")
            if kind == b"tEXt":
                out.append((key.decode("latin-1"), rest.decode("latin-1")))
            elif kind == b"zTXt" and rest[:1] == b"\0":
                out.append((key.decode("latin-1"), _inflate(rest[1:], MAX_TEXT).decode("latin-1")))
            elif kind == b"iTXt":
                _, _, body = rest[2:].split(b"\0", 2)
                out.append((key.decode("latin-1"), (_inflate(body, MAX_TEXT) if rest[0] else body).decode("utf-8")))
        except (ValueError, IndexError, zlib.error):
            continue
    return out


def _unfilter(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            x, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, c = (x[i - bpp], up[i - bpp]) if i >= bpp else (0, 0)
                b = up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                x[i] = (x[i] + guess) & 255
            line = np.array(x, np.uint8)
        elif kind:
            raise ValueError("bad filter")
        out[y] = above = line
    return out


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    h = len(lines)
    if depth == 16:
        return lines.reshape(h, -1, 2).astype(np.uint16)[:, : width * channels] @ np.array([256, 1], np.uint16)
    if depth == 8:
        return lines[:, : width * channels].astype(np.uint16)
    bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)[:, : width * channels]


_PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def decode(raw: bytes) -> np.ndarray:
    """(height, width, 4) bytes, as stored; 16-bit samples keep their high byte."""
    out = decode16(raw)
    return (out >> 8).astype(np.uint8)


def decode16(raw: bytes) -> np.ndarray:
    """(height, width, 4) of 16 bits; smaller samples are stretched to the whole range."""
    w, h, depth, colour, lace = header(raw)
    if w * h > MAX_PIXELS:
        raise ValueError("too large")
    n, palette, clear, data = CHANNELS[colour], None, None, []
    for kind, body in chunks(raw):
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
    bpp = max(1, n * depth // 8)
    stride = lambda k: (k * n * depth + 7) // 8
    parts = [(0, 0, 1, 1)] if not lace else _PASSES
    sizes = [(-(-(h - y) // sy), -(-(w - x) // sx)) for y, x, sy, sx in parts]
    total = sum(a * (stride(b) + 1) for a, b in sizes if a > 0 and b > 0)
    flat = _inflate(b"".join(data), total + 1)
    out, at = np.zeros((h, w, n), np.uint16), 0
    for (y, x, sy, sx), (a, b) in zip(parts, sizes):
        if a > 0 and b > 0:
            used = a * (stride(b) + 1)
            out[y::sy, x::sx] = _samples(_unfilter(flat[at : at + used], a, stride(b), bpp), b, depth, n).reshape(a, b, n)
            at += used
    rgba = np.full((h, w, 4), 65535, np.uint16)
    if colour == 3:
        rgba[..., :3] = palette[out[..., 0]].astype(np.uint16) * 257
        if clear:
            rgba[..., 3] = np.pad(np.frombuffer(clear, np.uint8), (0, max(0, 256 - len(clear))), constant_values=255)[out[..., 0]].astype(np.uint16) * 257
        return rgba
    if clear and colour in (0, 2):
        key = np.array(struct.unpack(f">{n}H", clear[: 2 * n]))
        rgba[..., 3] = np.where((out == key).all(-1), 0, 65535)
    v = out if depth == 16 else out * np.uint16(65535 // ((1 << depth) - 1))
    rgba[..., :3] = v[..., :1] if n < 3 else v[..., :3]
    if n in (2, 4):
        rgba[..., 3] = v[..., -1]
    return rgba


def keyword_ok(key: str) -> bool:
    """1 to 79 Latin-1 characters without spaces at the edges or doubled."""
    return 1 <= len(key) <= 79 and key == key.strip(" ") and "  " not in key and all(32 <= ord(c) <= 126 or 161 <= ord(c) <= 255 for c in key)


def encode(pixels: np.ndarray, text: list[tuple[str, str]] = ()) -> bytes:
    """PNG bytes of (height, width, 1..4) bytes; text goes right after the header."""
    h, w, n = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    out = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0))]
    for key, value in text:
        if not keyword_ok(key):
            raise ValueError(f"no keyword: {key!r}")
        plain = value.isascii()
        out.append(chunk(b"tEXt" if plain else b"iTXt", key.encode("latin-1") + b"\0" + (value.encode() if plain else b"\0\0\0\0" + value.encode("utf-8"))))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, w * n)], axis=1)
    return b"".join([*out, chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), chunk(b"IEND", b"")])


def _rows(df: DataFrame, id_col: str, content: str, one, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """One row a file with an error column: a bad file never fails the job."""
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            got, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    got.append(one(raw or b""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    got.append((None,) * len(fields))
                    errors.append(str(e) or type(e).__name__)
            cols = list(zip(*got)) if got else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(cols, fields)), pa.array(errors, pa.string())], ["id", *(f[0] for f in fields), "error"])

    schema = ", ".join([f"id {kind}", *(f"{n} {s}" for n, s, _ in fields), "error string"])
    return df.select(F.col(id_col).alias("id"), F.col(content).alias("content")).mapInArrow(run, schema)


def probe(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, channels, error) from headers alone."""
    return _rows(df, id_col, content, lambda raw: (h := header(raw))[:2] + (CHANNELS[h[3]] if h[3] != 3 else 3,), [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("channels", "int", pa.int32())])


def decode_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, data, error): four channels as stored."""
    return _rows(df, id_col, content, lambda raw: ((p := decode(raw)).shape[1], p.shape[0], p.tobytes()), [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("data", "binary", pa.binary())])


def text_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, texts, error)."""
    pair = pa.struct([("keyword", pa.string()), ("text", pa.string())])
    return _rows(df, id_col, content, lambda raw: ([{"keyword": k, "text": v} for k, v in (header(raw) and texts(raw))],), [("texts", "array<struct<keyword: string, text: string>>", pa.list_(pair))])


def encode_rows(df: DataFrame, id_col: str, data: str, width: int, channels: int, texts_col: str | None = None) -> DataFrame:
    """(id, png, error) of binary samples, row by row; texts_col: an array of structs (keyword, text) to write after the header."""
    one = lambda raw, text=(): (encode(np.frombuffer(raw, np.uint8).reshape(-1, width, channels), text),)
    if texts_col is None:
        return _rows(df, id_col, data, one, [("png", "binary", pa.binary())])
    both = df.withColumn("_both", F.struct(F.col(data).alias("raw"), F.col(texts_col).alias("texts")))
    return _rows(both, id_col, "_both", lambda x: one(x["raw"] or b"", [(t["keyword"], t["text"]) for t in x["texts"] or ()]), [("png", "binary", pa.binary())])
