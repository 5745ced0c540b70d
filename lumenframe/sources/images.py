"""Image files of any format as DataFrames: probing, decoding, frames, scaling, metadata, writing.

The input of each operator has an id column and a `content` column, as
`spark.read.format("binaryFile")` gives. Work is one Arrow pass over the rows;
what a task holds is one batch of files and at most BATCH_BYTES of results, or
one image. A file that cannot be read gives a row with nulls and an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boxes, exif, gif, jpeg, ktx2, png, raster, tiff

#: Results are handed on at this many bytes.
BATCH_BYTES = 32 << 20
#: Files of one input batch.
BATCH_FILES = 64
#: Codecs that a host may add.
MAX_CODECS = 16


@dataclass(frozen=True)
class Codec:
    """A format: sniff(bytes) -> bool, size(bytes) -> (w, h, channels), decode(bytes) -> (h, w, 4) bytes."""

    name: str
    sniff: Callable[[bytes], bool]
    decode: Callable[[bytes], np.ndarray]
    size: Callable[[bytes], tuple[int, int, int]] | None = None


def _cr3(raw: bytes) -> bytes:
    found = boxes.cr3_jpegs(raw)
    for name in ("full", "preview", "thumbnail"):
        if name in found:
            return found[name]
    raise ValueError("no preview in the CR3")


def _no_decoder(raw: bytes) -> np.ndarray:
    raise ValueError("HEVC and AV1 pixels need a registered codec")


def _heif_size(raw: bytes) -> tuple[int, int, int]:
    got = boxes.heif_info(raw)
    return got["width"], got["height"], 4 if got["has_alpha"] else 3


_TIFF = (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")
#: In the order in which they are tried.
CODECS = [
    Codec("jpeg", lambda r: r[:2] == b"\xff\xd8", jpeg.decode, jpeg.size),
    Codec("cr3", boxes.is_cr3, lambda r: jpeg.decode(_cr3(r)), lambda r: jpeg.size(_cr3(r))),
    Codec("heif", boxes.is_heif, _no_decoder, _heif_size),
    Codec("ico", lambda r: r[:4] in (b"\0\0\1\0", b"\0\0\2\0"), raster.ico, raster.ico_size),
    Codec("tiff", lambda r: r[:4] in _TIFF, tiff.decode, tiff.size),
    Codec("gif", lambda r: r[:6] in (b"GIF87a", b"GIF89a"), gif.decode, gif.size),
    Codec("png", lambda r: r[:8] == png.SIGNATURE, png.decode, lambda r: (lambda h: (h[0], h[1], 3 if h[3] == 3 else png.CHANNELS[h[3]]))(png.header(r))),
    Codec("bmp", lambda r: r[:2] == b"BM", raster.bmp, raster.bmp_size),
    Codec("pnm", lambda r: r[:2] in (b"P5", b"P6"), raster.pnm, raster.pnm_size),
    Codec("tga", lambda r: True, raster.tga, raster.tga_size),  # has no signature: last
]

_registered: list[Codec] = []


def register_codec(codec: Codec) -> None:
    """Adds a codec that is tried before the built-in ones, in order of registration; names are unique."""
    if not codec.name or not callable(codec.sniff) or not callable(codec.decode):
        raise ValueError("a codec needs a name, sniff and decode")
    if has_codec(codec.name):
        raise ValueError(f"already registered: {codec.name}")
    if len(_registered) >= MAX_CODECS:
        raise ValueError("too many codecs")
    _registered.append(codec)


def has_codec(name: str) -> bool:
    return any(c.name == name for c in _registered)


def unregister_codec(name: str) -> None:
    _registered[:] = [c for c in _registered if c.name != name]


def _try(raw: bytes, codecs: list[Codec], one: Callable[[Codec], object]):
    """The first codec that knows the bytes and reads them; else the first reason given."""
    reason = None
    for c in codecs:
        if not c.sniff(raw):
            continue
        try:
            return one(c)
        except Exception as e:  # noqa: BLE001
            reason = reason or (str(e) or type(e).__name__)
    raise ValueError(reason or "unknown format")


def decode(raw: bytes, codecs: list[Codec] | None = None) -> np.ndarray:
    """(height, width, 4) bytes as stored, by registered codecs first (those that the driver has, unless given)."""
    return _try(raw, (_registered if codecs is None else codecs) + CODECS, lambda c: c.decode(raw))


def probe(raw: bytes, codecs: list[Codec] | None = None) -> tuple[int, int, int, str]:
    """(width, height, channels, format) from headers; a registered codec without `size` decodes."""

    def one(c: Codec):
        if c.size:
            return (*c.size(raw), c.name)
        p = c.decode(raw)
        return p.shape[1], p.shape[0], 4, c.name

    return _try(raw, (_registered if codecs is None else codecs) + CODECS, one)


def decode_u16(raw: bytes) -> np.ndarray:
    """(height, width, 4) of 16 bits; bytes v become v * 257. Registered codecs are not asked."""
    if raw[:4] in _TIFF:
        return tiff.decode(raw, 65535)
    if raw[:8] == png.SIGNATURE and png.header(raw)[2] == 16:
        return png.decode16(raw)
    if raw[:2] in (b"P5", b"P6"):
        v, bits = raster.pnm_samples(raw)
        out = np.full((*v.shape[:2], 4), 65535, np.uint16)
        out[..., :3] = v if bits == 16 else v.astype(np.uint16) * 257
        return out
    return decode(raw, []).astype(np.uint16) * np.uint16(257)


def decode_f32(raw: bytes) -> np.ndarray:
    """(height, width, 4) floats: float files as they are, others 0 to 1 from their full depth."""
    if raw[:4] in _TIFF:
        layout = tiff.Layout(*tiff.first(raw))
        if layout.format == 3 and layout.photometric in (1, 2):
            v = tiff.read_samples(raw, layout).astype(np.float32)
            out = np.ones((*v.shape[:2], 4), np.float32)
            out[..., :3] = v[..., :3] if v.shape[2] >= 3 else v[..., :1]
            if v.shape[2] in (2, 4):
                out[..., 3] = v[..., -1]
            return out
    return (decode_u16(raw) / np.float32(65535)).astype(np.float32)


def target(w: int, h: int, box_w: int, box_h: int, cover: bool = False) -> tuple[int, int]:
    """Size within (or over) a box; never larger than the source, a side of 0 does not bind."""
    ratios = [b / s for b, s in ((box_w, w), (box_h, h)) if b > 0]
    s = (max if cover else min)(ratios) if ratios else 1.0
    if s >= 1:
        return w, h
    return tuple(min(n, max(1, int(n * s + 0.5))) for n in (w, h))


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n): share of each source cell in each target cell."""
    edges = np.arange(m + 1) * (n / m)
    low, high = edges[:-1, None], edges[1:, None]
    cell = np.arange(n)[None, :]
    out = np.clip(np.minimum(cell + 1, high) - np.maximum(cell, low), 0, None)
    return (out / out.sum(axis=1, keepdims=True)).astype(np.float32)


def shrink(p: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean over areas, bytes."""
    if p.shape[:2] == (h, w):
        return p
    rows = np.tensordot(_weights(p.shape[0], h), p.astype(np.float32), (1, 0))
    out = np.tensordot(_weights(p.shape[1], w), rows, (1, 1)).swapaxes(0, 1)
    return np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def thumbnail(raw: bytes) -> np.ndarray:
    """The embedded thumbnail, bars cut off (2% tolerance), upright."""
    cr3 = boxes.is_cr3(raw)
    body = boxes.cr3_jpegs(raw).get("thumbnail") if cr3 else exif.thumbnail(raw)
    if body is None:
        raise ValueError("no thumbnail")
    p = jpeg.decode(body)
    try:
        fw, fh, *_ = probe(raw, [])
    except ValueError:
        fw, fh = p.shape[1], p.shape[0]
    h, w = p.shape[:2]
    want = fw / fh
    if abs(w / h - want) > 0.02 * want:
        cw, ch = (min(w, max(1, int(h * want + 0.5))), h) if w / h > want else (w, min(h, max(1, int(w / want + 0.5))))
        p = p[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]
    return exif.upright(p, exif.orientation(raw))


def decode_scaled(raw: bytes, box_w: int, box_h: int, cover: bool = False, embedded: bool = False, codecs: list[Codec] | None = None) -> tuple[np.ndarray, str]:
    """(upright pixels for a box, the way taken): `thumbnail`, `preview`, `jpeg m/8` or `full`.

    An embedded picture is used, if asked for, where it is at least as large as the result.
    """
    w, h, _, kind = probe(raw, codecs)
    turn = exif.orientation(raw)
    up = (h, w) if turn >= 5 else (w, h)
    dw, dh = target(*up, box_w, box_h, cover)
    if embedded and (dw, dh) != up:
        try:
            p = thumbnail(raw)
            if p.shape[1] >= dw and p.shape[0] >= dh:
                return shrink(p, dw, dh), "thumbnail"
        except (ValueError, IndexError):
            pass
        if kind == "cr3" and (body := boxes.cr3_jpegs(raw).get("preview")):
            pw, ph, _ = jpeg.size(body)
            if pw >= dw and ph >= dh:
                return shrink(jpeg.decode(body), dw, dh), "preview"
    if kind in ("jpeg", "cr3"):
        body = raw if kind == "jpeg" else _cr3(raw)
        a, b = (dh, dw) if turn >= 5 else (dw, dh)
        m = next((m for m in range(1, 9) if jpeg.scaled(w, m) >= a and jpeg.scaled(h, m) >= b), 8)
        return shrink(exif.upright(jpeg.decode(body, m), turn), dw, dh), f"jpeg {m}/8"
    return shrink(exif.upright(decode(raw, codecs), turn), dw, dh), "full"


def frames(raw: bytes, codecs: list[Codec] | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(pixels, delay in ms); a still image is one frame."""
    if gif.frame_count(raw) > 0:
        yield from gif.frames(raw)
    else:
        yield decode(raw, codecs), 0


# ---- DataFrame operators

_PIXELS = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("data", "binary", pa.binary())]


def _pixels(p: np.ndarray) -> tuple:
    return p.shape[1], p.shape[0], p.tobytes()


def _weigh(row: tuple) -> int:
    return sum(v.nbytes if isinstance(v, np.ndarray) else len(v) if isinstance(v, (bytes, str)) else 8 for v in row)


def _each(df: DataFrame, id_col: str, content: str, many: Callable[[bytes], Iterator[tuple]], fields: list) -> DataFrame:
    """(id, fields, error): the rows that `many` gives for each file; on failure one row with the reason after those given."""
    id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    names = ["id", *(f[0] for f in fields), "error"]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            held = 0

            def flush():
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, f[2]) for c, f in zip(cols[1:], fields)), pa.array(cols[-1], pa.string())], names)

            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                made = many(raw.as_py() or b"")
                while True:
                    try:
                        row = (key, *next(made), None)
                    except StopIteration:
                        break
                    except Exception as e:  # noqa: BLE001
                        row = (key, *(None,) * len(fields), str(e) or type(e).__name__)
                        made = iter(())
                    rows.append(row)
                    held += _weigh(row)
                    if held >= BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

    schema = ", ".join([f"id {id_type}", *(f"{n} {s}" for n, s, _ in fields), "error string"])
    return df.select(F.col(id_col).alias("id"), F.col(content).alias("content")).mapInArrow(run, schema)


def _single(one: Callable[[bytes], tuple]) -> Callable[[bytes], Iterator[tuple]]:
    def many(raw: bytes):
        yield one(raw)

    return many


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length, ...) of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def probe_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, channels, format, error) from headers."""
    codecs = list(_registered)
    return _each(df, id_col, content, _single(lambda r: probe(r, codecs)), [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("channels", "int", pa.int32()), ("format", "string", pa.string())])


def decode_rows(df: DataFrame, id_col: str = "path", content: str = "content", oriented: bool = False) -> DataFrame:
    """(id, width, height, data, error): four bytes a pixel, as stored or upright."""
    codecs = list(_registered)
    return _each(df, id_col, content, _single(lambda r: _pixels(exif.upright(decode(r, codecs), exif.orientation(r)) if oriented else decode(r, codecs))), _PIXELS)


def decode_u16_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, data array<int>, error): 16 bits a sample."""
    return _each(df, id_col, content, _single(lambda r: ((p := decode_u16(r)).shape[1], p.shape[0], p.ravel().astype(np.int32))), [*_PIXELS[:2], ("data", "array<int>", pa.list_(pa.int32()))])


def decode_f32_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, data array<float>, error)."""
    return _each(df, id_col, content, _single(lambda r: ((p := decode_f32(r)).shape[1], p.shape[0], p.ravel())), [*_PIXELS[:2], ("data", "array<float>", pa.list_(pa.float32()))])


_FRAME = [("frame", "int", pa.int32()), ("delay_ms", "int", pa.int32()), ("plays", "int", pa.int32()), *_PIXELS, ("truncated", "boolean", pa.bool_())]


def frame_rows(df: DataFrame, id_col: str = "path", content: str = "content", max_frames: int = 0, max_bytes: int = 0) -> DataFrame:
    """One row a frame. Stops before the frame that would pass a limit (0: none); the last row given then says `truncated`.

    A fault after the first frame also ends the file with `truncated`; before it, it is an error.
    """
    codecs = list(_registered)

    def many(raw: bytes):
        loop = gif.plays(raw) if raw[:3] == b"GIF" and gif.frame_count(raw) else 1
        made, used, prior, k, cut = frames(raw, codecs), 0, None, 0, False
        while True:
            try:
                p, delay = next(made)
            except StopIteration:
                break
            except Exception:  # noqa: BLE001
                if prior is None:
                    raise
                cut = True
                break
            if (max_frames and k >= max_frames) or (max_bytes and used + p.nbytes > max_bytes):
                if prior is None:
                    raise ValueError("the first frame is over the limit")
                cut = True
                break
            if prior is not None:
                yield (*prior, False)
            prior, k, used = (k, delay, loop, *_pixels(p)), k + 1, used + p.nbytes
        if prior is not None:
            yield (*prior, cut)

    return _each(df, id_col, content, many, _FRAME)


def bounded_rows(df: DataFrame, max_width: int, max_height: int, max_bytes: int, id_col: str = "path", content: str = "content") -> DataFrame:
    """As `frame_rows`, but size and frame count are checked against the limits before anything is decoded."""
    codecs = list(_registered)

    def many(raw: bytes):
        w, h, _, kind = probe(raw, codecs)
        n = gif.frame_count(raw) if kind == "gif" else 1
        if kind == "gif" and not n:
            raise ValueError("malformed")
        if w > max_width or h > max_height:
            raise ValueError("image is over the size limit")
        if w * h * 4 * n > max_bytes:
            raise ValueError("image is over the byte limit")
        loop = gif.plays(raw) if kind == "gif" else 1
        for k, (p, delay) in enumerate(frames(raw, codecs)):
            yield k, delay, loop, *_pixels(p), False

    return _each(df, id_col, content, many, _FRAME)


def scaled_rows(df: DataFrame, box_w: int, box_h: int, cover: bool = False, embedded: bool = False, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, data, way, error): upright, for a box, by the cheapest way."""
    codecs = list(_registered)

    def one(raw: bytes) -> tuple:
        p, way = decode_scaled(raw, box_w, box_h, cover, embedded, codecs)
        return (*_pixels(p), way)

    return _each(df, id_col, content, _single(one), [*_PIXELS, ("way", "string", pa.string())])


def gif_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, frames, plays, error) without decoding; a malformed file has 0 frames, and plays is 0 for ever."""
    fields = [("frames", "int", pa.int32()), ("plays", "int", pa.int32())]
    return _each(df, id_col, content, _single(lambda r: ((n := gif.frame_count(r)), gif.plays(r) if n else 1)), fields)


def exif_block_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, block, thumbnail, error): the TIFF block of the metadata and the bytes of the thumbnail in it, null if there is none."""
    return _each(df, id_col, content, _single(lambda r: (exif.find(r), exif.thumbnail(r))), [("block", "binary", pa.binary()), ("thumbnail", "binary", pa.binary())])


def smallest_thumbnail(sizes: DataFrame, least: int) -> DataFrame:
    """Of each id's (id, item, width, height) the smallest whose short side is `least` or more, else the largest; ties go to the smaller item."""
    area, enough = F.col("width") * F.col("height"), F.least("width", "height") >= least
    w = Window.partitionBy("id").orderBy(F.when(enough, 0).otherwise(1), F.when(enough, area).otherwise(-area), "item")
    return sizes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def thumbnail_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, width, height, data, error) of embedded thumbnails."""
    return _each(df, id_col, content, _single(lambda r: _pixels(thumbnail(r))), _PIXELS)


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def exif_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, camera, exposure and place fields, error)."""
    return _each(df, id_col, content, _single(exif.record), [(n, t, _ARROW[t]) for n, t in exif.FIELDS])


def orientation_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, orientation 1 to 8, error)."""
    return _each(df, id_col, content, _single(lambda r: (exif.orientation(r),)), [("orientation", "int", pa.int32())])


def geotiff_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, size, samples, scale, tiepoints, transform, nodata, epsg, error)."""
    ints, lists = ["width", "height", "channels", "bits", "format"], ["scale", "tiepoints", "transform"]
    fields = [(n, "int", pa.int32()) for n in ints] + [(n, "array<double>", pa.list_(pa.float64())) for n in lists] + [("nodata", "double", pa.float64()), ("epsg", "int", pa.int32())]
    return _each(df, id_col, content, _single(lambda r: tuple((g := tiff.geo(r))[f[0]] for f in fields)), fields)


def geotiff_window(df: DataFrame, x: int, y: int, width: int, height: int, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, y, channels, data array<float>, error): a row of the window each, from the chunks that meet it."""

    def many(raw: bytes):
        v = tiff.geo_samples(raw, (x, y, width, height))
        for k, line in enumerate(v):
            yield y + k, v.shape[2], line.ravel()

    return _each(df, id_col, content, many, [("y", "int", pa.int32()), ("channels", "int", pa.int32()), ("data", "array<float>", pa.list_(pa.float32()))])


def heif_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, size, coding, bits, rotation, mirror, has_alpha, items, brands, thumbnails, error) without decoding."""
    thumb = pa.struct([("item", pa.int32()), ("width", pa.int32()), ("height", pa.int32())])
    fields = [(n, "int", pa.int32()) for n in ("width", "height", "bits", "rotation", "mirror", "items")] + [("coding", "string", pa.string()), ("has_alpha", "boolean", pa.bool_()), ("brands", "array<string>", pa.list_(pa.string())), ("thumbnails", "array<struct<item: int, width: int, height: int>>", pa.list_(thumb))]
    return _each(df, id_col, content, _single(lambda r: tuple((g := boxes.heif_info(r))[f[0]] for f in fields)), fields)


def ktx2_rows(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, level, width, height, format, has_alpha, srgb, data, error): a row a mip level; data is null where the payload needs a transcoder."""

    def many(raw: bytes):
        g = ktx2.info(raw)
        for k, (w, h, *_) in enumerate(g["levels"]):
            yield k, w, h, g["coding"], g["has_alpha"], g["srgb"], ktx2.decode(raw, k).tobytes() if g["coding"] == "plain" else None

    fields = [("level", "int", pa.int32()), *_PIXELS[:2], ("format", "string", pa.string()), ("has_alpha", "boolean", pa.bool_()), ("srgb", "boolean", pa.bool_()), _PIXELS[2]]
    return _each(df, id_col, content, many, fields)


def encode_jpeg_rows(df: DataFrame, id_col: str, data: str, width: int, channels: int, quality: int = 90) -> DataFrame:
    """(id, jpeg, error) of binary samples, row by row."""
    return _each(df, id_col, data, _single(lambda r: (jpeg.encode(np.frombuffer(r, np.uint8).reshape(-1, width, channels), quality),)), [("jpeg", "binary", pa.binary())])


def to_pixels(df: DataFrame) -> DataFrame:
    """(image_id, y, x, c, v) of rows (id, width, height, data binary): the layout of the other operators.

    Images are cut into lines and those into pixels, so that no row drags a whole image along.
    """
    stride = F.col("width") * 4
    d = df.where("data is not null").select(F.col("id").alias("image_id"), "width", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("data", y * stride + 1, stride))).alias("y", "line"))
    d = d.select("image_id", "y", "line", F.explode(F.sequence(F.lit(0), F.length("line") - 1)).alias("p"))
    v = F.conv(F.hex(F.substring("line", F.col("p") + 1, 1)), 16, 10).cast("long")
    return d.select("image_id", F.col("y").cast("long").alias("y"), F.floor(F.col("p") / 4).alias("x"), (F.col("p") % 4).cast("long").alias("c"), v.alias("v"))


#: What `can_decode` knows: format, MIME types, extensions, whether pixels are read.
SUPPORT = [
    ("jpeg", "image/jpeg image/jpg", "jpg jpeg jpe jfif", True), ("cr3", "image/x-canon-cr3", "cr3", True), ("heif", "image/heic image/heif", "heic heif hif", False), ("avif", "image/avif", "avif", False),
    ("ico", "image/x-icon image/vnd.microsoft.icon", "ico cur", True), ("tiff", "image/tiff", "tif tiff", True), ("gif", "image/gif", "gif", True), ("png", "image/png", "png", True),
    ("bmp", "image/bmp image/x-ms-bmp", "bmp dib", True), ("pnm", "image/x-portable-anymap image/x-portable-pixmap image/x-portable-graymap", "pnm ppm pgm", True), ("tga", "image/x-tga image/x-targa", "tga", True),
]


def can_decode(kind: Column) -> Column:
    """Whether a MIME type, an extension or a file name is of a format whose pixels are read; false if unknown or null."""
    names = [n for _, mimes, ends, read in SUPPORT if read for n in (mimes + " " + ends).split()]
    k = F.lower(F.trim(F.split(kind, ";")[0]))
    k = F.when(k.contains("/"), F.when(k.startswith("image/"), k).otherwise(F.element_at(F.split(k, "[./]"), -1))).otherwise(F.element_at(F.split(k, r"\."), -1))
    return F.coalesce(k.isin(names), F.lit(False))
