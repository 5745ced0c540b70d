"""Queries over image files. The files are made from `embeddings` by Column expressions: 64 bytes are a 4x4 image of four channels."""

from __future__ import annotations

import atexit
import shutil
import struct
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import video
from ..operators import layout as L
from ..sources import images, png
from .queries import RGB, RGBA8, rgb, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def shared_folder(spark, kind):
    """A new folder's name where driver and executors can write: spark.checkpoint.dir, or on a local master a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumenframe-files-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def joined(values):
    """An array of bytes as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def samples(channels=range(4)):
    """The chosen channels of each of the 16 pixels, in that order."""
    pick = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.array(*[F.element_at("embedding", p * 4 + c + 1) for c in channels])))
    return F.transform(pick, lambda v: L.as_u8(v.cast("double") * 255 + 127.5).cast("long"))


def files(spark, sf, head: bytes, channels=range(4)):
    """(path, content): fixed header bytes and the samples."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("path"), F.concat(F.unhex(F.lit(head.hex())), joined(samples(channels))).alias("content"))


def bmp_head():
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 70) + struct.pack("<IiiHHIIiiIIIIII", 56, 4, -4, 1, 32, 3, 0, 0, 0, 0, 0, 0xFF0000, 0xFF00, 0xFF, 0xFF000000)


def tga_head():
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 4, 4, 32, 0x28)


def tiff_head(bits=8, extra=()):
    """A directory right after the header, the samples after that."""
    fields = sorted([(256, 3, 4), (257, 3, 4), (258, 3, bits), (259, 3, 1), (262, 3, 2), (277, 3, 4), (278, 3, 4), (279, 4, 64), (338, 3, 2), *extra])
    start = 8 + 2 + 12 * (len(fields) + 1) + 4
    fields = sorted([*fields, (273, 4, start)])
    out = b"II*\0" + struct.pack("<IH", 8, len(fields))
    return out + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in fields) + b"\0" * 4


PIXELS = f"WITH {RGBA8} SELECT image_id, y, x, c, v FROM pix"


def _decoded(name, head, channels, sql=PIXELS):
    @query(name, sql)
    def run(spark, sf):
        return images.to_pixels(images.decode_rows(files(spark, sf, head(), channels)))


_decoded("s1_decode_bmp", bmp_head, (2, 1, 0, 3))
_decoded("s1_decode_tga", tga_head, (2, 1, 0, 3))
_decoded("s1_decode_tiff", tiff_head, (0, 1, 2, 3))
_decoded("s1_decode_pnm", lambda: b"P6\n4 4\n255\n", (0, 1, 2), f"WITH {RGBA8} SELECT image_id, y, x, c, CASE WHEN c = 3 THEN 255 ELSE v END AS v FROM pix")


def pngs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("path"), joined(samples()).alias("content"))
    return png.encode_rows(e, "path", "content", 4, 4).select(F.col("id").alias("path"), F.col("png").alias("content"))


@query("w1_png_round_trip", PIXELS)
def w1(spark, sf):
    return images.to_pixels(images.decode_rows(pngs(spark, sf)))


@query("w2_jpeg_mean", "SELECT vec_id AS image_id, CAST(vec_id * 37 % 256 AS BIGINT) AS low, CAST(vec_id * 37 % 256 AS BIGINT) AS high, CAST(192 AS BIGINT) AS n FROM embeddings")
def w2(spark, sf):
    """Pictures of one grey each, written and read: a JPEG of quality 100 keeps a grey as it is."""
    grey = table(spark, sf, "embeddings").select(vid().alias("path"), F.unhex(F.repeat(F.lpad(F.hex(vid() * 37 % 256), 2, "0"), 64)).alias("content"))
    out = images.encode_jpeg_rows(grey, "path", "content", 8, 1, 100).select(F.col("id").alias("path"), F.col("jpeg").alias("content"))
    got = images.to_pixels(images.decode_rows(out)).where("c < 3")
    return got.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))


_U16 = f"WITH {RGBA8} SELECT image_id, y * 16 + x * 4 + c AS pos, v * 257 AS v FROM pix"


@query("s4_decode_u16", _U16)
def s4(spark, sf):
    d = images.decode_u16_rows(pngs(spark, sf)).select(F.col("id").alias("image_id"), F.posexplode("data").alias("pos", "v"))
    return d.select("image_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v"))


@query("s5_decode_f32", f"WITH {RGBA8} SELECT image_id, y * 16 + x * 4 + c AS pos, round(v / CAST(255 AS DOUBLE), 5) AS v FROM pix")
def s5(spark, sf):
    d = images.decode_f32_rows(pngs(spark, sf)).select(F.col("id").alias("image_id"), F.posexplode("data").alias("pos", "v"))
    return d.select("image_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query("s6_decode_oriented", f"WITH {RGBA8} SELECT image_id, x AS y, 3 - y AS x, c, v FROM pix")
def s6(spark, sf):
    return images.to_pixels(images.decode_rows(files(spark, sf, tiff_head(extra=[(274, 3, 6)])), oriented=True))


def le(value, n):
    """A whole number as n bytes, the least significant first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)]))


def raw(b: bytes):
    return F.unhex(F.lit(b.hex()))


def made(spark, sf, *parts):
    """(path, content) of the parts in a row, which may be bytes."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("path"), F.concat(*[raw(p) if isinstance(p, bytes) else p for p in parts]).alias("content"))


def vid():
    return F.col("vec_id")


@query("s2_read_files", "SELECT n_nationkey AS image_id, CAST(i AS BIGINT) AS x, CAST(ascii(substr(n_name, i + 1, 1)) AS BIGINT) AS v FROM nation, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)")
def s2(spark, sf):
    """A file of one line of grey pixels a nation, the first letters of its name, written to a folder and read from it."""
    folder = shared_folder(spark, "s2")
    n = table(spark, sf, "nation")
    n.select(F.concat(F.lit("P5 3 1 255 "), F.substring("n_name", 1, 3)).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    got = images.read_files(spark, folder, "part-*")
    got = got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("path"), "content")
    return images.to_pixels(images.decode_rows(got)).where("c = 0").select("image_id", "x", "v")


@query("s3_probe", "SELECT vec_id AS image_id, CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id % 7 + 1 ELSE vec_id % 300 + 1 END AS INTEGER) AS width, CAST(vec_id % 5 + 2 AS INTEGER) AS height, CAST(CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 4 END AS INTEGER) AS channels, CASE WHEN vec_id % 2 = 0 THEN 'pnm' ELSE 'gif' END AS format FROM embeddings")
def s3(spark, sf):
    pnm = F.concat(raw(b"P6\n"), F.concat_ws(" ", vid() % 7 + 1, vid() % 5 + 2).cast("binary"), raw(b"\n255\n"))
    gif = F.concat(raw(b"GIF89a"), le(vid() % 300 + 1, 2), le(vid() % 5 + 2, 2), raw(b"\0\0\0;"))
    return images.probe_rows(made(spark, sf, F.when(vid() % 2 == 0, pnm).otherwise(gif))).select(F.col("id").alias("image_id"), "width", "height", "channels", "format")


@query("s7_decode_bounded", "SELECT vec_id AS image_id, CASE WHEN vec_id % 8 > 4 THEN 'image is over the size limit' WHEN vec_id % 8 = 4 THEN 'image is over the byte limit' END AS error, CAST(CASE WHEN vec_id % 8 < 4 THEN vec_id % 8 + 1 ELSE 0 END AS INTEGER) AS width FROM embeddings")
def s7(spark, sf):
    pnm = made(spark, sf, b"P6\n", (vid() % 8 + 1).cast("string").cast("binary"), b" 1\n255\n", F.unhex(F.repeat(F.lit("0A141E"), (vid() % 8 + 1).cast("int"))))
    return images.bounded_rows(pnm, 5, 16, 16).select(F.col("id").alias("image_id"), "error", F.coalesce("width", F.lit(0)).alias("width"))


_GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x81, 0, 0) + bytes([0, 0, 0, 10, 20, 30, 40, 50, 60, 0, 0, 0])


def _frame(index, delay, flags=4, clear=0):
    """A frame of one pixel: clear, index, end in three-bit codes; index and delay may be Columns."""
    code = le(F.lit(4) + index * 8 + 5 * 64, 2)
    return F.concat(raw(b"\x21\xf9\x04" + bytes([flags])), le(delay, 2), raw(bytes([clear]) + b"\0\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02"), code, raw(b"\0"))


def _loops(count):
    return F.concat(raw(b"\x21\xff\x0bNETSCAPE2.0\x03\x01"), le(count, 2), raw(b"\0"))


def _animation(spark, sf):
    """One to three frames, of colours and delays by the id, played id % 4 times more; every fifth file is cut short."""
    one = lambda k: _frame((vid() + k) % 2 + 1, vid() % 50 + k)
    frames = F.concat(one(0), F.when(vid() % 3 > 0, one(1)).otherwise(raw(b"")), F.when(vid() % 3 > 1, one(2)).otherwise(raw(b"")))
    return made(spark, sf, _GIF, _loops(vid() % 4), frames, F.when(vid() % 5 == 4, raw(b"\x2c\0")).otherwise(raw(b";")))


@query("s8_frame_count", "SELECT vec_id AS image_id, CAST(CASE WHEN vec_id % 5 = 4 THEN 0 ELSE vec_id % 3 + 1 END AS INTEGER) AS frames FROM embeddings")
def s8(spark, sf):
    return images.gif_rows(_animation(spark, sf)).select(F.col("id").alias("image_id"), "frames")


_FRAMES = "SELECT vec_id AS image_id, f AS frame, CAST((vec_id % 50 + f) * 10 AS INTEGER) AS delay_ms, CASE WHEN (vec_id + f) % 2 = 0 THEN '0A141EFF' ELSE '28323CFF' END AS colour, vec_id FROM embeddings, (SELECT CAST(unnest(range(3)) AS INTEGER) AS f) WHERE f <= vec_id % 3 AND vec_id % 5 <> 4"


@query("s9_frames", f"SELECT image_id, frame, delay_ms, colour FROM ({_FRAMES})")
def s9(spark, sf):
    whole = _animation(spark, sf).where("path % 5 <> 4")
    return images.frame_rows(whole).select(F.col("id").alias("image_id"), "frame", "delay_ms", F.hex("data").alias("colour"))


@query("s10_next_frame", "SELECT vec_id AS image_id, f AS frame, CASE WHEN f = 2 OR vec_id % 2 = 1 THEN '0A141EFF' ELSE '28323CFF' END AS colour FROM embeddings, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS f)")
def s10(spark, sf):
    """Composed frames: the second is clear for odd ids and shows the first; it is taken away before the third, which is clear."""
    second = F.when(vid() % 2 == 1, _frame(F.lit(2), F.lit(1), 13, 2)).otherwise(_frame(F.lit(2), F.lit(1), 12))
    gif = made(spark, sf, _GIF, _frame(F.lit(1), F.lit(1)), second, _frame(F.lit(2), F.lit(1), 5, 2), b";")
    return images.frame_rows(gif).where("frame > 0").select(F.col("id").alias("image_id"), "frame", F.hex("data").alias("colour"))


@query("s11_frames_limited", f"SELECT image_id, frame, frame = 1 AND vec_id % 3 = 2 AS truncated FROM ({_FRAMES}) WHERE frame < 2")
def s11(spark, sf):
    whole = _animation(spark, sf).where("path % 5 <> 4")
    return images.frame_rows(whole, max_frames=2).select(F.col("id").alias("image_id"), "frame", "truncated")


def _registered(spark, sf, name, head):
    """Decoded by a codec that is registered while the plan is made; the plan carries it to the executors."""
    import numpy as np

    codec = images.Codec(name, lambda r, head=head: r.startswith(head), lambda r, n=len(head): np.frombuffer(r[n:], np.uint8).reshape(4, 4, 4))
    images.register_codec(codec)
    try:
        return images.to_pixels(images.decode_rows(files(spark, sf, head)))
    finally:
        images.unregister_codec(name)


@query("s12_registered_codec", PIXELS)
def s12(spark, sf):
    return _registered(spark, sf, "raw-4x4", b"RAW4")


@query("s25_av1_decoder", PIXELS)
def s25(spark, sf):
    return _registered(spark, sf, "av1-host", b"\0\0\0\x14ftypavif\0\0\0\0avif")


def _with_thumbnail(jpeg):
    """A JPEG file whose metadata hold a thumbnail: an empty first directory, then one with the thumbnail's place and length."""
    head = b"II*\0\x08\0\0\0" + struct.pack("<HI", 0, 14) + struct.pack("<HHHII", 2, 0x201, 4, 1, 44) + struct.pack("<HHI", 0x202, 4, 1)
    block = F.concat(raw(head), le(F.length(jpeg), 4), raw(b"\0\0\0\0"), jpeg)
    size = F.length(block) + 8
    return F.concat(raw(b"\xff\xd8\xff\xe1"), le(F.floor(size / 256), 1), le(size % 256, 1), raw(b"Exif\0\0"), block, raw(b"\xff\xd9"))


@query("s15_exif_thumbnail", "SELECT vec_id AS image_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(vec_id * 37 % 256 AS BIGINT) AS low, CAST(vec_id * 37 % 256 AS BIGINT) AS high FROM embeddings")
def s15(spark, sf):
    """Thumbnails of one grey each, which a JPEG of quality 100 keeps as it is."""
    grey = table(spark, sf, "embeddings").select(vid().alias("path"), F.unhex(F.repeat(F.lpad(F.hex(vid() * 37 % 256), 2, "0"), 64)).alias("content"))
    jpeg = images.encode_jpeg_rows(grey, "path", "content", 8, 1, 100)
    got = images.thumbnail_rows(jpeg.select(F.col("id").alias("path"), _with_thumbnail(F.col("jpeg")).alias("content")))
    size = got.select(F.col("id").alias("image_id"), "width", "height")
    return images.to_pixels(got).where("c < 3").groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).join(size, "image_id")


@query("s16_find_exif", "SELECT vec_id AS image_id, CASE WHEN vec_id % 2 = 0 THEN '49492A00' || hex(lpad(CAST(vec_id AS VARCHAR), 8, '0')) END AS block FROM embeddings")
def s16(spark, sf):
    digits = F.lpad(vid().cast("string"), 8, "0").cast("binary")
    jpeg = F.concat(raw(b"\xff\xd8\xff\xe1\0\x14Exif\0\0II*\0"), digits, raw(b"\xff\xd9"))
    other = F.concat(raw(b"\xff\xd8\xff\xe0\0\x0e"), F.lit("JFIF").cast("binary"), digits, raw(b"\xff\xd9"))
    got = images.exif_block_rows(made(spark, sf, F.when(vid() % 2 == 0, jpeg).otherwise(other)))
    return got.select(F.col("id").alias("image_id"), F.hex("block").alias("block"))


@query("s17_find_exif_thumbnail", "SELECT vec_id AS image_id, 'FFD8' || hex(lpad(CAST(vec_id AS VARCHAR), 8, '0')) || 'FFD9' AS thumbnail FROM embeddings")
def s17(spark, sf):
    got = images.exif_block_rows(made(spark, sf, _with_thumbnail(F.concat(raw(b"\xff\xd8"), F.lpad(vid().cast("string"), 8, "0").cast("binary"), raw(b"\xff\xd9")))))
    return got.select(F.col("id").alias("image_id"), F.hex("thumbnail").alias("thumbnail"))


_HALF = f"WITH {RGBA8} SELECT image_id, y // 2 AS y, x // 2 AS x, c, CAST(floor(avg(v) + 0.5) AS BIGINT) AS v FROM pix GROUP BY image_id, y // 2, x // 2, c"


@query("s13_decode_scaled", _HALF)
def s13(spark, sf):
    return images.to_pixels(images.scaled_rows(pngs(spark, sf), 2, 2))


def _tagged(spark, sf, tag, value):
    """A TIFF of 4x4 with one more tag, whose four bytes of kind and value are a Column."""
    head = tiff_head(extra=[(tag, 2, 0)])
    at = head.index(struct.pack("<HHII", tag, 2, 1, 0))
    return made(spark, sf, head[: at + 2], value, head[at + 12 :], joined(samples()))


@query("s18_exif", "SELECT vec_id AS image_id, 'M' || CAST(vec_id % 90 + 10 AS VARCHAR) AS make FROM embeddings")
def s18(spark, sf):
    value = F.concat(raw(struct.pack("<HI", 2, 4)), F.concat(F.lit("M"), (vid() % 90 + 10).cast("string")).cast("binary"), raw(b"\0"))
    return images.exif_rows(_tagged(spark, sf, 271, value)).select(F.col("id").alias("image_id"), "make")


@query("s19_orientation", "SELECT vec_id AS image_id, CAST(CASE WHEN vec_id % 11 BETWEEN 1 AND 8 THEN vec_id % 11 ELSE 1 END AS INTEGER) AS orientation FROM embeddings")
def s19(spark, sf):
    """0, 9 and 10 are no orientations, so upright."""
    value = F.concat(raw(struct.pack("<HI", 3, 1)), le(vid() % 11, 4))
    return images.orientation_rows(_tagged(spark, sf, 274, value)).select(F.col("id").alias("image_id"), "orientation")


def _labelled(spark, sf):
    """PNG files with one to three texts, of which some are not ASCII."""
    one = lambda k: F.struct(F.concat(F.lit("Key "), F.lit(str(k))).alias("keyword"), F.concat(F.when(vid() % 2 == 0, "\u00fc").otherwise("u"), (vid() + k).cast("string")).alias("text"))
    texts = F.slice(F.array(*map(one, range(3))), 1, (vid() % 3 + 1).cast("int"))
    e = table(spark, sf, "embeddings").select(vid().alias("path"), joined(samples()).alias("content"), texts.alias("texts"))
    return png.encode_rows(e, "path", "content", 4, 4, "texts").select(F.col("id").alias("path"), F.col("png").alias("content"))


@query("s20_png_text", "SELECT vec_id AS image_id, 'Key ' || k AS keyword, CASE WHEN vec_id % 2 = 0 THEN chr(252) ELSE 'u' END || CAST(vec_id + k AS VARCHAR) AS text FROM embeddings, (SELECT unnest(range(3)) AS k) WHERE k <= vec_id % 3")
def s20(spark, sf):
    got = png.text_rows(_labelled(spark, sf)).select(F.col("id").alias("image_id"), F.explode("texts").alias("t"))
    return got.select("image_id", "t.keyword", "t.text")


@query("w3_png_with_text", PIXELS)
def w3(spark, sf):
    """The texts do not touch the pixels."""
    return images.to_pixels(images.decode_rows(_labelled(spark, sf)))


@query("s21_geotiff_info", "SELECT vec_id AS image_id, CAST(4 AS INTEGER) AS width, CAST(4 AS INTEGER) AS channels, CAST(vec_id % 900 + 100 AS DOUBLE) AS nodata FROM embeddings")
def s21(spark, sf):
    value = F.concat(raw(struct.pack("<HI", 2, 4)), (vid() % 900 + 100).cast("string").cast("binary"), raw(b"\0"))
    return images.geotiff_rows(_tagged(spark, sf, 42113, value)).select(F.col("id").alias("image_id"), "width", "channels", "nodata")


@query("s22_geotiff_window", f"WITH {RGBA8} SELECT image_id, y, (x - 1) * 4 + c AS pos, CAST(v AS DOUBLE) AS v FROM pix WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 3")
def s22(spark, sf):
    d = images.geotiff_window(files(spark, sf, tiff_head()), 1, 1, 3, 2)
    d = d.select(F.col("id").alias("image_id"), F.col("y").cast("long").alias("y"), F.posexplode("data").alias("pos", "v"))
    return d.select("image_id", "y", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def _heif(width: int, height: int, turns: int) -> bytes:
    """A container with one coded image, its size and rotation, and no payload."""
    full = lambda kind, body, version=0: _box(kind, struct.pack(">I", version << 24) + body)
    entry = full(b"infe", struct.pack(">HH", 1, 0) + b"hvc1" + b"\0", 2)
    props = _box(b"ipco", full(b"ispe", struct.pack(">II", width, height)) + _box(b"irot", bytes([turns])))
    assoc = full(b"ipma", struct.pack(">IHBBB", 1, 1, 2, 0x81, 0x82))
    meta = full(b"meta", full(b"hdlr", b"\0" * 4 + b"pict" + b"\0" * 13) + full(b"pitm", struct.pack(">H", 1)) + full(b"iinf", struct.pack(">H", 1) + entry) + _box(b"iprp", props + assoc))
    return _box(b"ftyp", b"heic\0\0\0\0mif1heic") + meta


@query("s23_heif_info", "SELECT vec_id AS image_id, CAST(100 + 10 * (vec_id % 5) AS INTEGER) AS width, CAST(60 + vec_id % 5 AS INTEGER) AS height, CAST(vec_id % 5 % 4 * 90 AS INTEGER) AS rotation FROM embeddings")
def s23(spark, sf):
    five = F.array(*[raw(_heif(100 + 10 * k, 60 + k, k % 4)) for k in range(5)])
    got = images.heif_rows(made(spark, sf, F.element_at(five, (vid() % 5 + 1).cast("int"))))
    return got.select(F.col("id").alias("image_id"), "width", "height", "rotation")


_SIZES = "SELECT p_partkey AS id, k AS item, CAST(p_size * (k + 1) + 3 AS BIGINT) AS width, CAST(p_size * (3 - k) + 5 AS BIGINT) AS height FROM part, (SELECT CAST(unnest(range(3)) AS INTEGER) AS k)"


@query("s24_heif_thumbnail", f"WITH t AS ({_SIZES}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY least(width, height) < 60, CASE WHEN least(width, height) < 60 THEN -1 ELSE 1 END * width * height, item) AS k FROM t) SELECT id, item, width, height FROM r WHERE k = 1")
def s24(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("item")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("s"), k)
    return images.smallest_thumbnail(p.select("id", "item", (F.col("s") * (F.col("item") + 1) + 3).alias("width"), (F.col("s") * (3 - F.col("item")) + 5).alias("height")), 60)


@query("s27_ktx2", PIXELS)
def s27(spark, sf):
    """A texture of plain texels and one level; block-coded ones need a transcoder."""
    head = b"\xabKTX 20\xbb\r\n\x1a\n" + struct.pack("<9I", 37, 1, 4, 4, 0, 0, 1, 1, 0) + b"\0" * 32 + struct.pack("<3Q", 104, 64, 64)
    return images.to_pixels(images.ktx2_rows(files(spark, sf, head)))


@query("s26_can_decode", "SELECT page_id, lower(regexp_extract(url, '([^./]*)$', 1)) IN ('jpg', 'jpeg', 'jpe', 'jfif', 'cr3', 'ico', 'cur', 'tif', 'tiff', 'gif', 'png', 'bmp', 'dib', 'pnm', 'ppm', 'pgm', 'tga') AS ok FROM pages")
def s26(spark, sf):
    return table(spark, sf, "pages").select("page_id", images.can_decode(F.col("url")).alias("ok"))


_YUV = "SELECT image_id, p, r * 255 AS y, g * 255 - 128 AS u, b * 255 - 128 AS w FROM rgb"
_TO8 = lambda e: f"CAST(floor(round(least(greatest({e}, 0), 1) * 255, 9) + 0.5) AS BIGINT)"
_LUMA = "((y - 16) / CAST(219 AS DOUBLE))"


@query("y1_yuv_to_rgb", f"WITH {RGB}, s AS ({_YUV}) SELECT image_id, p, {_TO8(f'{_LUMA} + 1.402 * w / 224')} AS r, {_TO8(f'{_LUMA} - 1.772 * 0.114 / 0.587 * u / 224 - 1.402 * 0.299 / 0.587 * w / 224')} AS g, {_TO8(f'{_LUMA} + 1.772 * u / 224')} AS b FROM s")
def y1(spark, sf):
    r, g, b = video.yuv_to_rgb(F.col("r") * 255, F.col("g") * 255, F.col("b") * 255)
    return rgb(spark, sf).select("image_id", "p", video.level(r).alias("r"), video.level(g).alias("g"), video.level(b).alias("b"))


@query("y2_yuv_to_alpha", f"WITH {RGB} SELECT image_id, p, {_TO8('(r * 255 - 16) / CAST(219 AS DOUBLE)')} AS a FROM rgb")
def y2(spark, sf):
    return rgb(spark, sf).select("image_id", "p", video.alpha_plane(F.col("r") * 255).alias("a"))


@query("y3_pq_to_nits", f"WITH {RGB}, s AS (SELECT image_id, p, CASE WHEN r <= 0 THEN 0 ELSE pow(r, 32 / CAST(2523 AS DOUBLE)) END AS x FROM rgb) SELECT image_id, p, round(10000 * pow(greatest(x - 0.8359375, 0) / (CAST(18.8515625 AS DOUBLE) - 18.6875 * x), 16384 / CAST(2610 AS DOUBLE)), 3) AS nits FROM s")
def y3(spark, sf):
    return rgb(spark, sf).select("image_id", "p", F.round(video.pq_to_nits(F.col("r")), 3).alias("nits"))


#: Linear BT.2020 to BT.709.
_TO709 = [
    [1.6604910021084338, -0.5876411387885494, -0.07284986331988462],
    [-0.12455047452159049, 1.13289989712596, -0.008349422604369518],
    [-0.01815076335490532, -0.10057889800800755, 1.1187296613629125],
]
_PQ = "10000 * pow(greatest(pow({x}, 32 / CAST(2523 AS DOUBLE)) - 0.8359375, 0) / (CAST(18.8515625 AS DOUBLE) - 18.6875 * pow({x}, 32 / CAST(2523 AS DOUBLE))), 16384 / CAST(2610 AS DOUBLE)) / 203"
_LEVEL = lambda e, n: f"floor(round(least(greatest({e}, 0), 1) * {n}, 9) + 0.5) / CAST({n} AS DOUBLE)"
_MIX = ", ".join(f"greatest({' + '.join(f'{k} * CAST({w!r} AS DOUBLE)' for k, w in zip('rgb', row))}, 0) AS {c}" for c, row in zip("rgb", _TO709))
_KNEE = "(((m - 0.75) / 0.25) * (((m - 0.75) / 0.25) / (t * t) + 1) / ((m - 0.75) / 0.25 + 1) * 0.25 + 0.75)"
_CODE = lambda e: f"CAST(floor(round(least(greatest(CASE WHEN {e} <= 0.0031308 THEN {e} * 12.92 ELSE pow({e}, 1 / CAST(2.4 AS DOUBLE)) * 1.055 - 0.055 END, 0), 1) * 255, 9) + 0.5) AS BIGINT)"
_HDR = f"""WITH {RGB}, a AS (SELECT image_id, p, {', '.join(f"{_LEVEL(c, 4095)} AS {c}" for c in 'rgb')} FROM rgb),
 n AS (SELECT image_id, p, {', '.join(f"{_PQ.format(x=c)} AS {c}" for c in 'rgb')} FROM a), w AS (SELECT image_id, p, {_MIX} FROM n),
 k AS (SELECT *, greatest(r, g, b) AS m, (1000 / CAST(203 AS DOUBLE) - 0.75) / 0.25 AS t FROM w),
 s AS (SELECT *, CASE WHEN m <= 0.75 THEN m ELSE least(1, {_KNEE}) END / CASE WHEN m > 0 THEN m ELSE 1 END AS f FROM k),
 l AS (SELECT image_id, p, {', '.join(f"{_LEVEL(f'{c} * f', 16383)} AS {c}" for c in 'rgb')} FROM s)
 SELECT image_id, p, {', '.join(f"{_CODE(c)} AS {c}" for c in 'rgb')} FROM l"""


@query("y4_hdr_to_srgb", _HDR)
def y4(spark, sf):
    return video.hdr_to_srgb(rgb(spark, sf))
