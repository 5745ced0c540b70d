import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import kernels as K
from lumenframe.operators import analysis as X
from lumenframe.operators import geometry as G
from lumenframe.operators import kernels as R
from lumenframe.operators import tiling as T

NAN, INF = float("nan"), float("inf")


def field(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "image_id long, pos long, v double")


def test_histogram_truncates_towards_zero(spark):
    f = field(spark, [-3, 0, 1, 4, 2.5, -0.5])
    assert [r.n for r in R.reduce_histogram(f, 4, 0.0, 4.0).orderBy("bin").collect()] == [2, 1, 1, 0]
    assert [r.n for r in R.reduce_histogram(field(spark, [NAN, INF, -INF, 3e38]), 4, 0.0, 4.0).orderBy("bin").collect()] == [0] * 4


def test_minmax_skips_nan_unless_first(spark):
    r = R.reduce_minmax(field(spark, [2, NAN, -1]), ["image_id"]).first()
    assert (r["min"], r["max"]) == (-1, 2)
    r = R.reduce_minmax(field(spark, [NAN, 2]), ["image_id"]).first()
    assert math.isnan(r["min"]) and math.isnan(r["max"])


def test_min_max_of_two_are_asymmetric(spark):
    d = spark.createDataFrame([(NAN, 1.0), (1.0, NAN)], "a double, b double")
    got = d.select(K.minimum(F.col("a"), F.col("b")).alias("lo"), K.maximum(F.col("a"), F.col("b")).alias("hi")).collect()
    assert math.isnan(got[0].lo) and math.isnan(got[0].hi) and got[1].lo == 1 and got[1].hi == 1


def test_clamp_passes_nan_and_log_edges(spark):
    d = field(spark, [NAN, -1, 0, math.e])
    got = d.orderBy("pos").select(K.affine_clamp(F.col("v"), 1, 0, -0.5, 0.5).alias("c"), K.log(F.col("v")).alias("l")).collect()
    assert math.isnan(got[0].c) and [r.c for r in got[1:]] == [-0.5, 0.0, 0.5]
    assert math.isnan(got[1].l) and got[2].l == -INF and got[3].l == pytest.approx(1)


def test_lookup_wraps_and_reads_zero_for_nan(spark):
    d = field(spark, [1.5, NAN, -0.25, 2.0])
    got = [r.i for r in d.orderBy("pos").select(K.lookup_index(F.col("v"), 256, 0.0, 1.0, wrap=True).alias("i")).collect()]
    assert got == [126, 0, 192, 254]


@pytest.mark.parametrize("kind", G.FILTERS)
@pytest.mark.parametrize("sizes", [(8, 5), (5, 8), (7, 7), (1, 4), (9, 1)])
def test_weights_keep_constants(kind, sizes):
    total = {}
    for d, s, w in G.axis_taps(*sizes, kind):
        assert 0 <= s < sizes[0]
        total[d] = total.get(d, 0) + w
    assert sorted(total) == list(range(sizes[1])) and all(abs(t - 1) < 1e-9 for t in total.values())


def test_fixed_weights_sum_exactly():
    for d in range(3):
        assert sum(w for e, _, w in G.fixed_taps(7, 3) if e == d) == 16384


def test_rotation_is_counter_clockwise(spark):
    p = spark.createDataFrame([(0, y, x, 0, y * 2 + x) for y in range(3) for x in range(2)], "image_id long, y long, x long, c long, v long")
    got = G.rotate_90(p, (2, 3), 1).orderBy("y", "x").collect()
    assert [r.v for r in got] == [1, 3, 5, 0, 2, 4]
    back = G.rotate_90(G.rotate_90(p, (2, 3), 1), (3, 2), 3)
    assert sorted(back.collect()) == sorted(p.collect())


def test_color_circles(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.2, 0.7, 0.4), (0.5, 0.5, 0.5)]
    d = spark.createDataFrame(rows, "r double, g double, b double")
    for there, back, names in ((K.rgb_to_hsv, K.hsv_to_rgb, "hsv"), (K.rgb_to_hsl, K.hsl_to_rgb, "hsl")):
        got = d.select(there(*map(F.col, "rgb")).alias("k")).select(back(*[F.col(f"k.{n}") for n in names]).alias("z")).select("z.*").collect()
        for a, b in zip(rows, got):
            assert tuple(b) == pytest.approx(a)


@pytest.mark.parametrize("n,tile,step", [(20, 8, 6), (37, 16, 10), (15, 15, 15), (5, 8, 6)])
def test_tiles_rebuild(spark, n, tile, step):
    p = spark.createDataFrame([(0, y, x, 0, float(x * 2 + y * 3)) for y in range(n) for x in range(n)], "image_id long, y long, x long, c long, v double")
    out = T.normalize_accumulator(T.accumulate(T.split(p, n, n, tile, step), n, n, tile, step)).collect()
    assert len(out) == n * n and all(abs(r.v - (r.x * 2 + r.y * 3)) < 1e-6 for r in out)


def texture(w, h, dx=0.0, dy=0.0):
    y, x = np.mgrid[:h, :w].astype(float)
    x, y = x - dx, y - dy
    return 128 + 42 * np.sin(0.11 * x + 0.04 * y) + 38 * np.sin(0.14 * y - 0.05 * x) + 22 * np.sin(0.33 * x + 0.27 * y) + 14 * np.sin(0.45 * y - 0.38 * x)


def test_motion_and_alignment_recover_a_shift():
    a, b = (np.clip(np.floor(texture(320, 240, *s) + 0.5), 0, 255).astype(int) for s in ((0, 0), (3.4, -1.7)))
    m = [r for r in X.motion_pair(a, b, 16, 8, 4) if r[7] == 0]
    assert m and sum(abs(r[2] - 3.4) < 0.15 and abs(r[3] + 1.7) < 0.15 for r in m) >= 0.9 * len(m)
    got = X.align_pair(texture(320, 240) / 255, texture(320, 240, 2.5, -1.5) / 255)
    assert abs(got["tx"] - 2.5) < 0.1 and abs(got["ty"] + 1.5) < 0.1 and abs(got["scale"] - 1) < 0.01 and got["converged"] and got["iterations"] > 0


def test_alignment_options():
    ref, mov = texture(96, 96) / 255, texture(96, 96, 2, -1) / 255
    mask = np.zeros((96, 96))
    mask[20:70, 30:80] = 1
    spoiled = mov.copy()
    spoiled[:10] = 0
    got = X.align_pair(ref, spoiled, mask)
    assert abs(got["tx"] - 2) < 0.05 and abs(got["ty"] + 1) < 0.05 and got["coverage"] == 1
    few = X.align_pair(ref, mov, np.eye(96)[:, :96] * (np.arange(96) < 15), init=(1.1, 0.2, 3.0, 4.0))
    assert (few["scale"], few["tx"], few["ty"], few["converged"], few["iterations"]) == (1.1, 3.0, 4.0, False, 0)
    near = X.align_pair(ref, mov, init=(1.0, 0.0, 1.5, -0.5), search=0, levels=0, similarity=False, photometric=False)
    assert abs(near["tx"] - 2) < 0.05 and (near["scale"], near["rotation"], near["gain"], near["bias"]) == (1, 0, 1, 0)
    darker = X.align_pair(ref, mov * 0.5 + 0.1)
    assert abs(darker["gain"] - 2) < 0.02 and abs(darker["bias"] + 0.2) < 0.02


def test_ssim_of_cells_without_a_window(spark):
    rows = [(0, y, x, (7 * y + 3 * x * x) % 50) for y in range(9) for x in range(9)]
    a = spark.createDataFrame(rows, "image_id long, y long, x long, v long")
    got = {(r.cell_y, r.cell_x): r.ssim for r in X.ssim_cells(a, a, 9, 9, 3, 3).collect()}
    assert len(got) == 9 and all(abs(v - 1) < 1e-12 for v in got.values())


def test_flat_images_have_no_sharpness(spark):
    p = spark.createDataFrame([(0, y, x, 7) for y in range(5) for x in range(5)], "image_id long, y long, x long, v long")
    r = X.sharpness(p).first()
    assert (r.laplacian_variance, r.tenengrad, r.luma_mean, r.pixels) == (0, 0, 7, 9)
