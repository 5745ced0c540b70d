"""Video samples against the formulas written again in numpy, and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import video


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).first()


def rgb(spark, y, u, v, **kw):
    return list(one(spark, *[video.level(c) for c in video.yuv_to_rgb(*(F.lit(float(x)) for x in (y, u, v)), **kw)]))


def test_known_colours(spark):
    assert rgb(spark, 16, 128, 128) == [0, 0, 0] and rgb(spark, 235, 128, 128) == [255, 255, 255]
    assert rgb(spark, 255, 128, 128, full=True) == [255, 255, 255]
    assert rgb(spark, 81, 90, 240) == [254, 0, 0] and rgb(spark, 63, 102, 240, matrix=1) == [255, 1, 0]
    assert rgb(spark, 940, 512, 512, bits=10) == [255, 255, 255]
    assert rgb(spark, 10, 20, 30, full=True, matrix=0) == [30, 10, 20]
    assert rgb(spark, 100, 128, 128, full=True, matrix=8) == [100, 100, 100]
    assert rgb(spark, 235, 128, 128, matrix=12, primaries=9) == [255, 255, 255]
    assert one(spark, video.alpha_plane(F.lit(235)), video.alpha_plane(F.lit(300)), video.alpha_plane(F.lit(128), full=True))[:] == (255, 255, 128)


def test_primaries():
    assert video.xyz_of(1)[1] == pytest.approx([0.2126, 0.7152, 0.0722], abs=1e-4)
    assert video.xyz_of(9)[1] == pytest.approx([0.2627, 0.6780, 0.0593], abs=1e-4)
    assert (video.xyz_of(99) == video.xyz_of(1)).all()


def test_transfer(spark):
    got = one(spark, *[video.pq_to_nits(F.lit(e)) for e in (0.0, 0.5, 1.0)], *[video.hlg_to_scene(F.lit(e)) for e in (0.0, 0.5, 1.0)])
    assert got[:] == pytest.approx((0, 92.246, 10000, 0, 1 / 12, 1), rel=1e-4)
    peak = 1000 / 203
    assert one(spark, *[video.compress(F.lit(m), peak) for m in (0.5, 0.75, peak, 20.0)])[:] == pytest.approx((0.5, 0.75, 1, 1))


def test_hdr(spark):
    """Neutral stays neutral, black and beyond-peak are the ends, colours outside the target are cut."""
    rows = [(i, e, e, e) for i, e in enumerate((0.0, 0.2, 0.4, 0.6, 1.0))] + [(5, 0.0, 0.5, 0.0), (6, 0.5, 0.5, 0.5), (7, None, 0.1, 0.2)]
    d = spark.createDataFrame(rows, "i int, r double, g double, b double").coalesce(1)
    for transfer in (16, 18):
        got = [r[1:] for r in video.hdr_to_srgb(d, transfer=transfer).orderBy("i").collect()]
        assert got[0] == (0, 0, 0) and all(max(g) - min(g) <= 1 for g in got[:5]) and got[:5] == sorted(got[:5])
        assert min(got[4]) >= 254 or transfer == 18
        assert got[5][0] == 0 and got[7] == (None, None, None)
    e = np.round(0.5 * 4095) / 4095
    p = e ** (1 / (2523 / 32))
    light = (max(p - 3424 / 4096, 0) / (2413 / 128 - 2392 / 128 * p)) ** (16384 / 2610) * 10000 / 203
    want = 255 * (1.055 * light ** (1 / 2.4) - 0.055)
    assert video.hdr_to_srgb(d, primaries=1).where("i = 6").first()[1:] == pytest.approx([want] * 3, abs=0.6)
