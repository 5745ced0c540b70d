"""Column functions for coded video samples: YCbCr to RGB by H.273 code points, PQ and HLG to displayable bytes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import linear_to_srgb

# Chromaticities of H.273 ColourPrimaries (red, green, blue, white; x and y each).
BT709 = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290)
PRIMARIES = {
    1: BT709,
    4: (0.67, 0.33, 0.21, 0.71, 0.14, 0.08, 0.310, 0.316),
    5: (0.64, 0.33, 0.29, 0.60, 0.15, 0.06, 0.3127, 0.3290),
    6: (0.630, 0.340, 0.310, 0.595, 0.155, 0.070, 0.3127, 0.3290),
    7: (0.630, 0.340, 0.310, 0.595, 0.155, 0.070, 0.3127, 0.3290),
    8: (0.681, 0.319, 0.243, 0.692, 0.145, 0.049, 0.310, 0.316),
    9: (0.708, 0.292, 0.170, 0.797, 0.131, 0.046, 0.3127, 0.3290),
    11: (0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.314, 0.351),
    12: (0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.3127, 0.3290),
    22: (0.630, 0.340, 0.295, 0.605, 0.155, 0.077, 0.3127, 0.3290),
}
# Luma weights of red and blue by H.273 MatrixCoefficients; others count as 0.299 and 0.114.
WEIGHTS = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 7: (0.212, 0.087), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}
#: Reference white of ITU-R BT.2408 in nits, and where compression starts, relative to white.
WHITE, KNEE = 203.0, 0.75


def xyz_of(primaries: int) -> np.ndarray:
    """(3, 3): linear RGB to XYZ; white maps to its own chromaticity with Y = 1."""
    xy = np.array(PRIMARIES.get(primaries, BT709)).reshape(4, 2)
    columns = np.stack([xy[:, 0] / xy[:, 1], np.ones(4), (1 - xy.sum(axis=1)) / xy[:, 1]])
    return columns[:, :3] * np.linalg.solve(columns[:, :3], columns[:, 3])


def ranged(v: Column, bits: int, full: bool, chroma: bool = False) -> Column:
    """A coded sample as 0..1, or -0.5..0.5 for chroma."""
    step = 1 << (bits - 8)
    if full:
        return (v - (1 << (bits - 1) if chroma else 0)) / float((1 << bits) - 1)
    return (v - (128 if chroma else 16) * step) / float((224 if chroma else 219) * step)


def yuv_to_rgb(y: Column, u: Column, v: Column, bits: int = 8, full: bool = False, matrix: int = 2, primaries: int = 2) -> tuple[Column, Column, Column]:
    """Red, green and blue signals, not clamped. Chroma must have the luma plane's size (resample it first)."""
    luma = ranged(y, bits, full)
    if matrix == 0:  # green, blue, red
        return ranged(v, bits, full), luma, ranged(u, bits, full)
    cb, cr = ranged(u, bits, full, True), ranged(v, bits, full, True)
    if matrix == 8:
        return luma - cb + cr, luma + cb, luma - cb - cr
    if matrix in (12, 13):
        kr, _, kb = xyz_of(primaries)[1]
    else:
        kr, kb = WEIGHTS.get(matrix, (0.299, 0.114))
    r, b = luma + cr * float(2 - 2 * kr), luma + cb * float(2 - 2 * kb)
    return r, (luma - r * float(kr) - b * float(kb)) / float(1 - kr - kb), b


def unit(v: Column) -> Column:
    """Clamped to 0..1; null stays null."""
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def _positive(v: Column) -> Column:
    return F.when(v < 0, 0.0).otherwise(v)


def level(v: Column, top: int = 255) -> Column:
    """The nearest of top + 1 levels; rounded to nine digits first so that halves go up."""
    return F.floor(F.round(unit(v) * top, 9) + 0.5).cast("long")


def alpha_plane(v: Column, bits: int = 8, full: bool = False) -> Column:
    """A coded alpha sample as a byte."""
    return level(ranged(v, bits, full))


def pq_to_nits(e: Column) -> Column:
    """SMPTE ST 2084."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(_positive(e), F.lit(1 / m2))
    return F.pow(_positive(p - c1) / (F.lit(c2) - p * c3), F.lit(1 / m1)) * 10000.0


def hlg_to_scene(e: Column) -> Column:
    """Inverse of the BT.2100 HLG curve: signal to scene light, both 0..1."""
    a = 0.17883277
    b, c = 1 - 4 * a, 0.5 - a * math.log(4 * a)
    x = unit(e)
    return F.when(x <= 0.5, x * x / 3.0).otherwise((F.exp((x - c) / a) + b) / 12.0)


def compress(m: Column, peak: float) -> Column:
    """Tone curve of the largest channel: itself up to the knee, from there to 1 at the peak (extended Reinhard)."""
    if peak <= 1:
        return F.when(m > 1, 1.0).otherwise(m)
    x, top = (m - KNEE) / (1 - KNEE), (peak - KNEE) / (1 - KNEE)
    bent = x * (x / (top * top) + 1) / (x + 1) * (1 - KNEE) + KNEE
    return F.when(m <= KNEE, m).when(bent > 1, 1.0).otherwise(bent)


def hdr_to_srgb(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", transfer: int = 16, primaries: int = 9, max_cll: int = 0) -> DataFrame:
    """Replaces PQ (16) or HLG (18) signals by sRGB bytes, null where a channel that counts is null; the signal is read at 12 bits, light is coded from 14.

    The steps are projections of their own: each value is computed once, however often the next step uses it.
    """
    primaries = 9 if primaries == 2 else primaries
    own, names = xyz_of(primaries), (r, g, b)
    light = lambda c: pq_to_nits(c) / WHITE if transfer == 16 else hlg_to_scene(c)
    df = df.withColumns({n: level(F.col(n), 4095) / 4095.0 for n in names})
    df = df.withColumns({n: light(F.col(n)) for n in names})
    if transfer != 16:
        df = df.withColumn("_luma", sum(F.col(n) * float(w) for n, w in zip(names, own[1])))
        df = df.withColumn("_gain", F.when(F.col("_luma") > 0, F.pow("_luma", F.lit(0.2)) * (1000.0 / WHITE)).otherwise(F.lit(0.0)))
        df = df.withColumns({n: F.col(n) * F.col("_gain") for n in names}).drop("_luma", "_gain")
    if primaries != 1:
        df = df.withColumns({n: _positive(sum(F.col(k) * float(w) for k, w in zip(names, row))) for n, row in zip(names, np.linalg.solve(xyz_of(1), own))})
    df = df.withColumn("_top", F.greatest(*names))
    safe = F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))
    df = df.withColumn("_scale", compress(F.col("_top"), max(max_cll or 1000.0, WHITE) / WHITE) / safe)
    df = df.withColumns({n: level(F.col(n) * F.col("_scale"), 16383) / 16383.0 for n in names}).drop("_top", "_scale")
    return df.withColumns({n: level(linear_to_srgb(F.col(n))) for n in names})
