"""The file operators as DataFrames."""

import numpy as np
import pytest

from lumenframe.sources import boxes, exif, images, jpeg, ktx2, png
from test_readers import RGB, animation, bmp24, exif_block, tif

HOSTILE = [None, b"", b"BM", b"GIF89a", b"II*\0\x08\0\0\0\xff\xff", b"\0\0\1\0\5\0", b"P6 9 9 255 ", b"\xff\xd8\xff\xc0\0\4aa", b"\0\0\0\x18ftypheic\0\0\0\0mif1"]


def table(spark, files):
    return spark.createDataFrame(list(enumerate(files)), "path long, content binary")


def test_formats_and_errors(spark):
    good = [bmp24(RGB), png.encode(RGB), tif(RGB), b"P6\n7 5\n255\n" + RGB.tobytes()]
    d = table(spark, good + HOSTILE).repartition(3)
    rows = images.decode_rows(d).orderBy("id").collect()
    assert len(rows) == len(good) + len(HOSTILE)
    for r in rows[: len(good)]:
        assert (np.frombuffer(r.data, np.uint8).reshape(5, 7, 4)[..., :3] == RGB).all()
    assert all(r.error and r.data is None for r in rows[len(good) :])
    assert [r.format for r in images.probe_rows(d).orderBy("id").collect()[:4]] == ["bmp", "png", "tiff", "pnm"]
    for f in (images.decode_u16_rows, images.decode_f32_rows, images.frame_rows, images.exif_rows, images.orientation_rows, images.geotiff_rows, images.heif_rows, images.thumbnail_rows):
        assert f(d).select("id").distinct().count() == len(rows), f.__name__
    assert images.decode_rows(d.limit(0)).count() == 0


def test_frames_and_limits(spark):
    d = table(spark, [animation(), png.encode(RGB), animation()[:-8]])
    rows = images.frame_rows(d).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.delay_ms, r.plays, r.truncated) for r in rows[:5]] == [(0, 0, 70, 5, False), (0, 1, 80, 5, False), (0, 2, 90, 5, False), (0, 3, 100, 5, False), (1, 0, 0, 1, False)]
    assert [r.truncated for r in images.frame_rows(d, max_frames=2).where("id = 0").orderBy("frame").collect()] == [False, True]
    assert images.frame_rows(d, max_bytes=100).where("id = 0").count() == 2
    assert "limit" in images.frame_rows(d, max_bytes=10).where("id = 0").first().error
    assert images.bounded_rows(d, 4, 3, 4 * 12 * 4).where("id = 0 and error is null").count() == 4
    assert "byte limit" in images.bounded_rows(d, 4, 3, 4 * 12 * 4 - 1).where("id = 0").first().error
    assert "size limit" in images.bounded_rows(d, 4, 3, 1 << 20).where("id = 1").first().error


def test_codecs(spark):
    magic = images.Codec("xyz", lambda r: r[:3] == b"xyz", lambda r: np.full((1, r[3], 4), 9, np.uint8))
    images.register_codec(magic)
    try:
        with pytest.raises(ValueError):
            images.register_codec(magic)
        r = images.decode_rows(table(spark, [b"xyz\5"])).first()
        assert (r.width, r.height, r.data) == (5, 1, b"\t" * 20)
        assert images.has_codec("xyz")
    finally:
        images.unregister_codec("xyz")
    assert images.decode_rows(table(spark, [b"xyz\5"])).first().error
    with pytest.raises(ValueError):
        images.register_codec(images.Codec("", None, None))


def test_orientations():
    p = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for k, v in want.items():
        assert exif.upright(p, k)[..., 0].tolist() == v


def test_scaled_takes_the_cheapest_way():
    y, x = np.mgrid[:64, :96]
    p = np.stack([y * 3, x * 2, y + x], axis=-1).astype(np.uint8)
    whole = jpeg.encode(p, 95)
    for box, way in ((24, "jpeg 2/8"), (96, "jpeg 8/8"), (0, "jpeg 8/8")):
        got, found = images.decode_scaled(whole, box, 0)
        assert found == way and got.shape[1] == (box or 96)
        assert np.abs(got[..., :3].astype(int) - images.shrink(p, got.shape[1], got.shape[0])).mean() < 3
    small, found = images.decode_scaled(png.encode(p), 48, 48, cover=True)
    assert found == "full" and small.shape[:2] == (48, 72)
    assert images.target(100, 50, 10, 10) == (10, 5) and images.target(100, 50, 10, 10, True) == (20, 10) and images.target(4, 4, 9, 9) == (4, 4)


def test_embedded_thumbnail():
    """Bars are cut off and the picture is turned upright."""
    thumb = np.zeros((24, 32, 3), np.uint8)
    thumb[4:20] = 200
    body = jpeg.encode(thumb, 100)
    block = exif_block()[:340] + body
    at = block.index(b"\x02\x02\0\4\0\0\0\1", 300) + 8
    block = block[:at] + len(body).to_bytes(4, "big") + block[at + 4 :]
    main = jpeg.encode(np.full((40, 80, 3), 200, np.uint8))
    raw = main[:2] + b"\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + main[2:]
    got = images.thumbnail(raw)
    assert got.shape == (32, 16, 4) and np.abs(got[..., :3].astype(int) - 200).max() < 40
    small, way = images.decode_scaled(raw, 8, 0, embedded=True)
    assert way == "thumbnail" and small.shape[:2] == (16, 8)
    assert images.decode_scaled(raw, 30, 0, embedded=True)[1].startswith("jpeg")


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def test_heif_description(spark):
    full = b"\0\0\0\0"
    infe = lambda i, kind: box(b"infe", b"\2\0\0\0", i.to_bytes(2, "big"), b"\0\0", kind, b"\0")
    ispe = lambda w, h: box(b"ispe", full, w.to_bytes(4, "big"), h.to_bytes(4, "big"))
    ipco = box(b"ipco", ispe(640, 480), ispe(160, 120), box(b"irot", b"\1"), box(b"pixi", full, b"\3\x0a\x0a\x0a"), box(b"auxC", full, b"urn:mpeg:hevc:2015:auxid:1\0"))
    ipma = box(b"ipma", full, (3).to_bytes(4, "big"), b"\0\1\3\x81\3\4", b"\0\2\1\2", b"\0\3\2\1\5")
    refs = box(b"iref", full, box(b"thmb", b"\0\2\0\1\0\1"), box(b"auxl", b"\0\3\0\1\0\1"))
    meta = box(b"meta", full, box(b"pitm", full, b"\0\1"), box(b"iinf", full, b"\0\3", infe(1, b"hvc1"), infe(2, b"hvc1"), infe(3, b"hvc1")), refs, box(b"iprp", ipco, ipma))
    raw = box(b"ftyp", b"heic", full, b"mif1heic") + meta
    r = images.heif_rows(table(spark, [raw])).first()
    assert (r.width, r.height, r.coding, r.bits, r.rotation, r.has_alpha, r.items, r.error) == (640, 480, "hvc1", 10, 90, True, 3, None)
    assert [tuple(t) for t in r.thumbnails] == [(2, 160, 120)]
    assert images.probe(raw) == (640, 480, 4, "heif")
    assert exif.orientation(raw) == 8
    assert [exif.turned(d, None) for d in (0, 90, 180, 270)] == [1, 8, 3, 6] and exif.turned(0, 0) == 4 and exif.turned(0, 1) == 2
    block = b"\0\0\0\6Exif\0\0" + exif_block()
    iloc = box(b"iloc", b"\1\0\0\0", b"\x44\0", b"\0\1", b"\0\4", b"\0\1", b"\0\0", b"\0\1", (0).to_bytes(4, "big"), len(block).to_bytes(4, "big"))
    photo = box(b"ftyp", b"heic", full, b"mif1heic") + box(b"meta", full, box(b"iinf", full, b"\0\1", infe(4, b"Exif")), iloc, box(b"idat", block))
    assert exif.record(photo)[0] == "Abc"
    assert boxes.pick_thumbnail([(160, 120), (320, 240), (640, 480)], 200) == 1 and boxes.pick_thumbnail([(16, 12), (32, 24)], 200) == 1


def test_cr3_previews():
    small, mid, full = (jpeg.encode(np.full((n, n, 3), n, np.uint8)) for n in (8, 16, 32))
    head = box(b"ftyp", b"crx ", b"\0\0\0\1", b"crx isom")

    def build(at):
        stbl = box(b"stbl", box(b"stsz", b"\0" * 4, len(full).to_bytes(4, "big"), b"\0\0\0\1"), box(b"co64", b"\0" * 4, b"\0\0\0\1", at.to_bytes(8, "big")))
        moov = box(b"moov", box(b"uuid", boxes.CR3_META, box(b"THMB", b"\0" * 16, small)), box(b"trak", box(b"mdia", box(b"minf", stbl))))
        return head + moov + box(b"uuid", boxes.CR3_PREVIEW, b"\0" * 8, box(b"PRVW", b"\0" * 16, mid)) + box(b"mdat", full)

    raw = build(len(build(0)) - len(full))
    shot = tif(RGB, tags={274: (3, [3]), 271: (2, b"Abc\0")})
    meta = head + box(b"moov", box(b"uuid", boxes.CR3_META, box(b"CMT1", shot), box(b"CMT2", tif(RGB, tags={0x8827: (3, [800])}))))
    got = dict(zip([f for f, _ in exif.FIELDS], exif.record(meta)))
    assert (got["make"], got["iso"], got["orientation"]) == ("Abc", 800, 3)
    assert boxes.cr3_jpegs(raw) == {"thumbnail": small, "preview": mid, "full": full}
    assert images.probe(raw)[:2] == (32, 32) and images.decode(raw).shape == (32, 32, 4)
    assert images.decode_scaled(raw, 12, 12, embedded=True)[1] == "preview"
    assert images.decode_scaled(raw, 8, 8, embedded=True)[1] == "thumbnail"


def test_can_decode(spark):
    kinds = ["image/png", "IMAGE/JPEG; q=1", "a/b/c.TIF", "jpg", "image/heic", "text/html", "x", "", None]
    d = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, k string").orderBy("i")
    assert [r.ok for r in d.select(images.can_decode(d.k).alias("ok")).collect()] == [True] * 4 + [False] * 5


@pytest.mark.parametrize("scheme", [0, 2, 3])
def test_ktx2(spark, scheme):
    import struct
    import zlib

    import zstandard

    pack = {0: bytes, 2: zstandard.ZstdCompressor().compress, 3: zlib.compress}[scheme]
    small = np.ascontiguousarray(RGB[:2, :3])
    bodies = [pack(RGB.tobytes()), pack(small.tobytes())]
    head = ktx2.SIGNATURE + struct.pack("<9I", 23, 1, 7, 5, 0, 0, 1, 2, scheme) + b"\0" * 32
    at = 80 + 48
    index = struct.pack("<6Q", at, len(bodies[0]), 105, at + len(bodies[0]), len(bodies[1]), 18)
    raw = head + index + b"".join(bodies)
    rows = images.ktx2_rows(table(spark, [raw, raw[:90], None])).orderBy("id", "level").collect()
    assert [(r.width, r.height, r.format) for r in rows[:2]] == [(7, 5, "plain"), (3, 2, "plain")] and rows[2].error and rows[3].error
    assert (np.frombuffer(rows[0].data, np.uint8).reshape(5, 7, 4)[..., :3] == RGB).all()
    assert (ktx2.decode(raw, 1)[..., :3] == small).all()
