"""JPEG against the JVM's own reader and writer."""

import numpy as np
import pytest

from lumenframe.sources import jpeg

Y, X = np.mgrid[:37, :53]
SMOOTH = np.stack([Y * 6, X * 4, (X + Y) * 2], axis=-1).astype(np.uint8)


def jvm_read(spark, raw):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    h, w = image.getHeight(), image.getWidth()
    return np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])[..., None] >> np.array([16, 8, 0]) & 255


def jvm_write(spark, pixels, progressive):
    jvm = spark._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(pixels[y, x] @ np.array([65536, 256, 1])))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(jvm.java.lang.Class.forName("javax.imageio.ImageWriteParam").getField("MODE_DEFAULT").getInt(None))
    out = jvm.java.io.ByteArrayOutputStream()
    sink = jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out)
    writer.setOutput(sink)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    sink.flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_round_trip(n):
    p = np.concatenate([SMOOTH, SMOOTH[..., :1]], axis=-1)[..., :n]
    raw = jpeg.encode(p, 95)
    got = jpeg.decode(raw)
    assert jpeg.size(raw) == (53, 37, 1 if n < 3 else 3) and got.shape == (37, 53, 4)
    assert np.abs(got[..., :3].astype(int) - (p[..., :1] if n < 3 else p[..., :3])).max() <= 6


def test_jvm_reads_what_is_written(spark):
    noisy = np.random.default_rng(0).integers(0, 256, (19, 30, 3)).astype(np.uint8)
    for p in (SMOOTH, noisy):
        for quality in (0, 30, 100):
            raw = jpeg.encode(p, quality)
            assert np.abs(jvm_read(spark, raw) - jpeg.decode(raw)[..., :3].astype(int)).max() <= 3


@pytest.mark.parametrize("progressive", [False, True])
def test_what_the_jvm_writes(spark, progressive):
    raw = jvm_write(spark, SMOOTH, progressive)
    assert (b"\xff\xc2" in raw) == progressive
    assert np.abs(jpeg.decode(raw)[..., :3].astype(int) - SMOOTH).mean() < 4
    for m in range(1, 9):
        assert jpeg.decode(raw, m).shape == (-(-37 * m // 8), -(-53 * m // 8), 4)
    small = jpeg.decode(raw, 4)[:18, :26, :3].astype(float)
    mean = SMOOTH[:36, :52].reshape(18, 2, 26, 2, 3).mean((1, 3))
    assert np.abs(small - mean).mean() < 4


def test_cut_and_damaged():
    raw = jpeg.encode(SMOOTH)
    for bad in (raw[:200], raw[:20], b"", raw[:400] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode(bad)
