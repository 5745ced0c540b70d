"""Readers against files written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from lumenframe.sources import exif, gif, jpeg, png, raster, tiff

RGB = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)


def bmp24(p, down=False):
    h, w, _ = p.shape
    pad = -w * 3 % 4
    lines = [r[:, ::-1].tobytes() + b"\0" * pad for r in (p if down else p[::-1])]
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(lines)


@pytest.mark.parametrize("down", [False, True])
def test_bmp(down):
    raw = bmp24(RGB, down)
    assert raster.bmp_size(raw) == (7, 5, 3)
    got = raster.bmp(raw)
    assert (got[..., :3] == RGB).all() and (got[..., 3] == 255).all()


def test_bmp_palette_and_runs():
    head = lambda pack, depth: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 12) + struct.pack("<IiiHHIIiiII", 40, 5, 2, 1, depth, pack, 0, 0, 0, 3, 0)
    table = bytes([0, 0, 0, 0, 3, 2, 1, 0, 9, 8, 7, 0])
    want = np.array([[1, 1, 1, 2, 0], [2, 2, 0, 1, 2]])
    colours = np.array([[0, 0, 0], [1, 2, 3], [7, 8, 9]])
    runs = bytes([2, 2, 0, 3, 0, 1, 2, 0, 0, 0]) + bytes([3, 1, 1, 2, 1, 0, 0, 1])
    assert (raster.bmp(head(1, 8) + table + runs)[..., :3] == colours[want]).all()
    plain = bytes([0x22, 0x01, 0x20, 0]) + bytes([0x11, 0x12, 0x00, 0])
    assert (raster.bmp(head(0, 4) + table + plain)[..., :3] == colours[want]).all()


def test_tga():
    h, w, _ = RGB.shape
    head = lambda kind, flags: struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, w, h, 24, flags)
    bgr = RGB[..., ::-1]
    assert (raster.tga(head(2, 0) + bgr[::-1].tobytes())[..., :3] == RGB).all()
    assert (raster.tga(head(2, 0x30) + bgr[:, ::-1].tobytes())[..., :3] == RGB).all()
    coded = b"".join(bytes([0x80]) + q.tobytes() for q in bgr[:4].reshape(-1, 3)) + bytes([6]) + bgr[4].tobytes()
    assert (raster.tga(head(10, 0x20) + coded)[..., :3] == RGB).all()
    with pytest.raises(ValueError):
        raster.tga(head(10, 0x20) + coded[:-5])


def test_pnm():
    assert (raster.pnm(b"P6 # note\n7 5\n255\n" + RGB.tobytes())[..., :3] == RGB).all()
    deep = (np.arange(35).reshape(5, 7) * 1000).astype(">u2")
    v, bits = raster.pnm_samples(b"P5\n7 5\n65535\n" + deep.tobytes())
    assert bits == 16 and (v[..., 0] == deep).all()


def test_ico_takes_the_largest():
    small = png.encode(RGB[:2, :2])
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-7 * 3 % 4) for r in RGB[::-1])
    mask = np.zeros((5, 32), np.uint8)
    mask[0, 1] = 1
    dib = struct.pack("<IiiHHIIiiII", 40, 7, 10, 1, 24, 0, 0, 0, 0, 0, 0) + rows + np.packbits(mask[::-1], axis=1).tobytes()
    head, at = struct.pack("<HHH", 0, 1, 2), 6 + 32
    for w, h, depth, body in ((2, 2, 32, small), (7, 5, 24, dib)):
        head += struct.pack("<BBBBHHII", w, h, 0, 0, 1, depth, len(body), at)
        at += len(body)
    got = raster.ico(head + small + dib)
    assert (got[..., :3] == RGB).all() and got[0, 1, 3] == 0 and (got[..., 3] == 0).sum() == 1


def lzw_gif(v, bits):
    """Clear codes before every index: all codes have the first width."""
    codes = [c for i in v for c in (1 << bits, int(i))] + [(1 << bits) + 1]
    n = sum(c << k * (bits + 1) for k, c in enumerate(codes))
    return n.to_bytes((len(codes) * (bits + 1) + 7) // 8, "little")


def block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def animation(w=4, h=3, loops=True):
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + table
    if loops:
        out += b"\x21\xff\x0bNETSCAPE2.0" + block(struct.pack("<BH", 1, 4))
    for k, (x, y, fw, fh, disposal, lace) in enumerate([(0, 0, 4, 3, 1, 1), (1, 1, 2, 1, 3, 0), (2, 0, 1, 1, 2, 0), (0, 0, 1, 1, 0, 0)]):
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | 1, 7 + k, 0) + b"\0"
        v = np.full((fh, fw), min(k + 1, 3))
        if k == 0:
            v[0, 0] = 0
        out += b"\x2c" + struct.pack("<HHHHB", x, y, fw, fh, 0x40 if lace else 0) + b"\2" + block(lzw_gif(v[[0, 2, 1]].ravel() if lace else v.ravel(), 2))
    return out + b";"


def test_gif_frames():
    raw = animation()
    got = list(gif.frames(raw))
    assert gif.frame_count(raw) == 4 and gif.plays(raw) == 5 and gif.plays(animation(loops=False)) == 1
    assert [d for _, d in got] == [70, 80, 90, 100]
    a, b, c, d = (p for p, _ in got)
    assert a[0, 0].tolist() == [0, 0, 0, 0] and a[2, 3].tolist() == [255, 0, 0, 255]
    assert b[1, 1].tolist() == [0, 255, 0, 255] and c[1, 1].tolist() == [255, 0, 0, 255]
    assert c[0, 2].tolist() == [0, 0, 255, 255] and d[0, 2].tolist() == [0, 0, 0, 0]
    assert gif.size(animation(0, 0))[:2] == (4, 3)
    assert gif.frame_count(raw[:-20]) == 0


def test_gif_codes_grow():
    v = np.random.default_rng(0).integers(0, 256, 6000)
    table, width, out, text = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    size = 258
    for i in v.tolist():
        more = text + bytes([i])
        if more in table:
            text = more
            continue
        out.append((table[text], width))
        if size < 4096:
            table[more] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        text = bytes([i])
    out += [(table[text], width), (257, width)]
    n = at = 0
    for c, k in out:
        n |= c << at
        at += k
    assert gif.unpack(n.to_bytes((at + 7) // 8, "little"), 8, 6000) == v.astype(np.uint8).tobytes()


def tif(p, e="<", tags=(), bits=8, codec=1, photometric=None, pack=lambda d: d, rows=2, big=False):
    """Strips of `rows` lines; p is (h, w, n)."""
    h, w, n = p.shape
    strips = [pack(p[y : y + rows].tobytes()) for y in range(0, h, rows)]
    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * n), 259: (3, [codec]), 262: (3, [photometric if photometric is not None else 2 if n > 2 else 1]), 277: (3, [n]), 278: (4, [rows]), 279: (4, [len(s) for s in strips])} | dict(tags)
    head = 16 if big else 8
    at, places = head, []
    for s in strips:
        places.append(at)
        at += len(s)
    fields[273] = (4, places)
    code = {1: "B", 3: "H", 4: "I", 12: "d"}
    extra, entries, room = b"", b"", 8 if big else 4
    word = "Q" if big else "I"
    after = at + (8 if big else 2) + len(fields) * (20 if big else 12) + room
    for t, (kind, v) in sorted(fields.items()):
        body = v if isinstance(v, bytes) else struct.pack(f"{e}{len(v)}{code[kind]}", *v)
        entries += struct.pack(e + "HH" + word, t, kind, len(v))
        if len(body) > room:
            entries += struct.pack(e + word, after + len(extra))
            extra += body
        else:
            entries += body.ljust(room, b"\0")
    start = (b"II" if e == "<" else b"MM") + (struct.pack(e + "HHHQ", 43, 8, 0, at) if big else struct.pack(e + "HI", 42, at))
    return start + b"".join(strips) + struct.pack(e + ("Q" if big else "H"), len(fields)) + entries + struct.pack(e + word, 0) + extra


@pytest.mark.parametrize("e", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_tiff_plain(e, big):
    raw = tif(RGB, e, big=big)
    assert tiff.size(raw) == (7, 5, 3)
    assert (tiff.decode(raw)[..., :3] == RGB).all()
    deep = (RGB.astype(np.uint16) * 257).astype(e + "u2")
    raw = tif(deep, e, bits=16, big=big)
    assert (tiff.decode(raw)[..., :3] == RGB).all() and (tiff.decode(raw, 65535)[..., :3] == deep).all()
    layout = tiff.Layout(*tiff.first(raw))
    assert (tiff.read_samples(raw, layout, (2, 1, 3, 3)) == deep[1:4, 2:5]).all()


def tiff_lzw(data):
    codes = [c for b in data for c in (256, b)] + [257]
    n = 0
    for c in codes:
        n = n << 9 | c
    return (n << (-9 * len(codes) % 8)).to_bytes((9 * len(codes) + 7) // 8, "big")


@pytest.mark.parametrize("codec, pack", [(8, zlib.compress), (32946, zlib.compress), (5, tiff_lzw), (32773, lambda d: b"".join(bytes([0, b]) for b in d))])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_codecs(codec, pack, predictor):
    p = RGB.copy()
    if predictor == 2:
        p[:, 1:] = RGB[:, 1:] - RGB[:, :-1]
    assert (tiff.decode(tif(p, codec=codec, pack=pack, tags={317: (3, [predictor])}))[..., :3] == RGB).all()


def test_tiff_jpeg():
    """Whole streams in each strip, and tables kept apart; YCbCr as JPEG has it, or samples stored as they are."""
    y, x = np.mgrid[:16, :24]
    p = np.stack([y * 9, x * 7, y + x], axis=-1).astype(np.uint8)
    pack = lambda d: jpeg.encode(np.frombuffer(d, np.uint8).reshape(-1, 24, 3), 98)
    got = tiff.decode(tif(p, codec=7, photometric=6, pack=pack, rows=8))
    assert np.abs(got[..., :3].astype(int) - p).max() <= 6
    whole = pack(p.tobytes())
    cut = whole.index(b"\xff\xc0")
    start, tables = whole[:2] + whole[cut:], whole[:cut] + b"\xff\xd9"
    raw = tif(p, codec=7, photometric=6, pack=lambda d: start, rows=16, tags={347: (7, tables)})
    assert (tiff.decode(raw)[..., :3] == jpeg.decode(whole)[..., :3]).all()
    as_is = tiff.decode(tif(p, codec=7, photometric=2, pack=lambda d: whole, rows=16))
    assert (as_is[..., :3] == jpeg.samples(whole)).all()
    assert tiff.read_samples(raw, tiff.Layout(*tiff.first(raw)), (3, 2, 4, 5)).shape == (5, 4, 3)


def test_tiff_lzw_widths():
    data = np.random.default_rng(1).integers(0, 8, 9000).astype(np.uint8).tobytes()
    table, width, out, text, size = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b"", 258
    for b in data:
        more = text + bytes([b])
        if more in table:
            text = more
            continue
        out.append((table[text], width))
        table[more], size, text = size, size + 1, bytes([b])
        if size == 4094:
            out.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        else:
            width = max(width, size.bit_length())  # one code early
    out += [(table[text], width)]
    n = bits = 0
    for c, k in out:
        n, bits = n << k | c, bits + k
    assert tiff.lzw((n << (-bits % 8)).to_bytes((bits + 7) // 8, "big"), len(data)) == data


def test_tiff_kinds():
    g = RGB[..., :1]
    assert (tiff.decode(tif(g, photometric=0))[..., :3] == 255 - g).all()
    f = np.array([[[0.0], [0.5], [1.0], [2.0], [np.nan]]], "<f4")
    raw = tif(f, bits=32, tags={339: (3, [3])}, rows=1)
    assert tiff.decode(raw)[0, :, 0].tolist() == [0, 128, 255, 255, 0]
    assert tiff.geo_samples(raw)[0, 3, 0] == 2
    planes = np.ascontiguousarray(f.view(np.uint8).reshape(1, 5, 4)[..., ::-1].transpose(0, 2, 1)).reshape(1, 20)
    coded = np.diff(planes.astype(int), prepend=0, axis=1).astype(np.uint8)
    raw = tif(coded.view("<f4").reshape(1, 5, 1), bits=32, tags={339: (3, [3]), 317: (3, [3])}, rows=1)
    assert np.array_equal(tiff.geo_samples(raw), f, equal_nan=True)
    palette = tif(np.array([[[1], [0]]], np.uint8), photometric=3, tags={320: (3, [0, 65535] + [0] * 254 + [257] * 256 + [0] * 256)}, rows=1)
    assert tiff.decode(palette)[0].tolist() == [[255, 1, 0, 255], [0, 1, 0, 255]]
    alpha = tif(np.array([[[50, 100, 0, 100]]], np.uint8), tags={338: (3, [1])}, rows=1)
    assert tiff.decode(alpha)[0, 0].tolist() == [128, 255, 0, 100]
    with pytest.raises(ValueError):
        tiff.decode(tif(g, codec=6))


def test_geotiff():
    keys = [1, 1, 0, 2, 2048, 0, 1, 4326, 3072, 0, 1, 32633]
    raw = tif(RGB, tags={33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 5.0, 6.0, 0.0]), 34735: (3, keys), 42113: (2, b"-9999 \0")})
    got = tiff.geo(raw)
    assert got["epsg"] == 32633 and got["nodata"] == -9999 and got["scale"] == [10, 10, 0] and got["tiepoints"][3:5] == [5, 6]


def exif_block():
    """One directory with orientation 6, a make and exposure fields."""
    out = b"MM\0*" + struct.pack(">I", 8)
    out += struct.pack(">H", 4) + struct.pack(">HHI4s", 0x10F, 2, 4, b"Abc\0") + struct.pack(">HHIHH", 0x112, 3, 1, 6, 0) + struct.pack(">HHII", 0x8769, 4, 1, 100) + struct.pack(">HHII", 0x8825, 4, 1, 200) + struct.pack(">I", 300)
    out = out.ljust(100, b"\0") + struct.pack(">H", 3) + struct.pack(">HHII", 0x829A, 5, 1, 150) + struct.pack(">HHIHH", 0x8827, 3, 1, 400, 0) + struct.pack(">HHII", 0x9003, 2, 20, 158) + b"\0" * 4
    out = out.ljust(150, b"\0") + struct.pack(">II", 1, 60) + b"2021:03:04 05:06:07\0"
    out = out.ljust(200, b"\0") + struct.pack(">H", 2) + struct.pack(">HHI4s", 1, 2, 2, b"S\0") + struct.pack(">HHII", 2, 5, 3, 250) + b"\0" * 4
    out = out.ljust(250, b"\0") + struct.pack(">IIIIII", 10, 1, 30, 1, 36, 1)
    out = out.ljust(300, b"\0") + struct.pack(">H", 2) + struct.pack(">HHII", 0x201, 4, 1, 340) + struct.pack(">HHII", 0x202, 4, 1, 4) + b"\0" * 4
    return out.ljust(340, b"\0") + b"\xff\xd8\xff\xd9"


def test_exif():
    block_ = exif_block()
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block_) + 8) + b"Exif\0\0" + block_ + b"\xff\xd9"
    chunk = b"eXIf" + block_
    webp = b"RIFF\0\0\0\0WEBPEXIF" + struct.pack("<I", len(block_)) + block_
    pic = png.encode(RGB)
    for raw in (jpeg, pic[:33] + struct.pack(">I", len(block_)) + chunk + struct.pack(">I", zlib.crc32(chunk)) + pic[33:], webp, block_):
        got = dict(zip([f for f, _ in exif.FIELDS], exif.record(raw)))
        assert got["make"] == "Abc" and got["exposure"] == "1/60" and got["iso"] == 400 and got["taken"] == "2021-03-04T05:06:07"
        assert got["latitude"] == pytest.approx(-10.51) and exif.orientation(raw) == 6 and exif.thumbnail(raw) == b"\xff\xd8\xff\xd9"
    assert exif.orientation(pic) == 1 and exif.thumbnail(b"") is None
    assert [exif.exposure_text(t) for t in (0.001, 0.25, 0.3, 0.5, 2)] == ["1/1000", "1/4", "0.3", "1/2", "2.0"]
    assert exif.iso_time("0000:00:00 00:00:00") is None and exif.iso_time("2020:13:01 00:00:00") is None
    assert exif.iso_time("2020:12:01 00:00:00", "12x") == "2020-12-01T00:00:00.12"
