"""How the work is laid out: no table of samples is broadcast, however small Spark takes it for; solvers use all cores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import analysis as X
from lumenframe.operators import geometry as G
from lumenframe.operators import layout as L
from lumenframe.plans import queries as P


def broadcast_scans(df):
    """The lines of the plan that read a table below a broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda s: next((i for i, ch in enumerate(s) if ch.isalpha() or ch == "*"), 0)
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                out += [below] if "parquet" in below else []
    return out


def no_samples_broadcast(spark, sf, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b")
    assert broadcast_scans(P.QUERIES[name](spark, sf)) == []


def test_bicubic_warp_broadcasts_no_samples(spark, sf):
    no_samples_broadcast(spark, sf, "g19_warp_bicubic")


def test_bilinear_warp_broadcasts_no_samples(spark, sf):
    no_samples_broadcast(spark, sf, "g19_warp_bilinear")


def test_nearest_warp_broadcasts_no_samples(spark, sf):
    no_samples_broadcast(spark, sf, "g19_warp_nearest")


@pytest.mark.parametrize("name", ["g10_letterbox_u8", "g11_pad_u8", "x1_compare", "x2_ssim", "x6_coarse_motion", "x9_measure"])
def test_the_same_step_broadcasts_no_samples(spark, sf, name):
    no_samples_broadcast(spark, sf, name)


@pytest.mark.parametrize("kind", ["nearest", "bilinear", "bicubic"])
def test_warp_with_many_taps(spark, sf, kind, monkeypatch):
    warp = lambda: G.warp_affine_u8(P.plane8(spark, sf).where("image_id < 5"), (8, 8), (7, 6), P.MATRIX, 1, kind, [77])
    few = warp()
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    many = warp()
    assert broadcast_scans(many) == []
    assert sorted(few.collect()) == sorted(many.collect())


def test_warp_of_what_lies_outside_is_the_fill(spark, sf):
    got = G.warp_affine_u8(P.plane8(spark, sf).where("image_id < 3"), (8, 8), (7, 6), [1, 0, 100, 0, 1, 100], 1, "bilinear", [77])
    assert got.groupBy("v").agg(F.count("*")).collect() == [(77, 3 * 42)]


def test_alignment_uses_all_cores_however_few_files(spark, sf):
    assert P.QUERIES["x8_align"](spark, sf).rdd.getNumPartitions() >= 32


def test_samples_by_flat_places_are_the_bilinear_ones():
    rng = np.random.default_rng(0)
    p, q = rng.random((2, 9, 7))
    x, y = rng.random(500) * 7, rng.random(500) * 9
    x[:4], y[:4] = (0, 7, 0, 7), (0, 0, 9, 9)
    for one, got in zip((p, q), X._taken([X._edged(p), X._edged(q)], 7, x, y)):
        want, on = X._bilinear(one, x, y)
        assert on.all() and (got == want).all()
