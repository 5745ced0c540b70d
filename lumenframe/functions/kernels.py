"""Element-wise functions of columns, with float rules: what is no number compares false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _below(a: Column, b: Column) -> Column:
    """a < b as floats compare: false if either is no number."""
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def affine(v: Column, a: float, b: float) -> Column:
    return v * F.lit(a) + F.lit(b)


def affine_clamp(v: Column, a: float, b: float, lo: float, hi: float) -> Column:
    x = affine(v, a, b)
    x = F.when(_below(x, F.lit(lo)), F.lit(lo)).otherwise(x)
    return F.when(_below(F.lit(hi), x), F.lit(hi)).otherwise(x)


def absolute(v: Column) -> Column:
    return F.abs(v)


def log(v: Column) -> Column:
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def sqrt(v: Column) -> Column:
    return F.sqrt(v)


def exp(v: Column) -> Column:
    return F.exp(v)


def power(v: Column, e: float) -> Column:
    return F.pow(v, F.lit(e))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def minimum(a: Column, b: Column) -> Column:
    """b only where it is below a: a NaN in a stays, one in b is ignored."""
    return F.when(_below(b, a), b).otherwise(a)


def maximum(a: Column, b: Column) -> Column:
    return F.when(_below(a, b), b).otherwise(a)


def lerp(a: Column, b: Column, t: float) -> Column:
    return a * F.lit(1.0 - t) + b * F.lit(t)


def weighted_sum(a: Column, b: Column, wa: float, wb: float) -> Column:
    return a * F.lit(wa) + b * F.lit(wb)


def lookup_index(v: Column, n: int, lo: float, hi: float, wrap: bool = False) -> Column:
    """The entry of a table of n for v in [lo, hi]; what is no number reads entry 0."""
    scale = (n - 1) / (hi - lo) if hi > lo else 0.0
    f = (v - F.lit(lo)) * F.lit(scale)
    if wrap:
        f = F.when(F.isnan(f) | (F.abs(f) == F.lit(INF)), F.lit(0.0)).otherwise(f)
        f = F.pmod(f, F.lit(float(n)))
    f = F.when(F.isnan(f), F.lit(0.0)).otherwise(F.least(F.greatest(f, F.lit(0.0)), F.lit(float(n - 1))))
    return F.floor(f).cast("long")


def gamma(v: Column, g: float) -> Column:
    return F.when(v > 0, F.pow(v, F.lit(1.0 / g if g else 1.0))).otherwise(v)


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((r * 77 + g * 150 + b * 29).cast("long"), 8)


def luma_rounded(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((r * 77 + g * 150 + b * 29 + 128).cast("long"), 8)


def motion_luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((r * 54 + g * 183 + b * 19).cast("long"), 8)


def align_luma(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0


def premultiply(v: Column, a: Column) -> Column:
    return F.floor((v * a + 127) / 255).cast("long")


def unpremultiply(v: Column, a: Column) -> Column:
    return F.when(a == 0, F.lit(0)).when(a.isNotNull() & v.isNotNull(), F.least(F.lit(255), F.floor((v * 255 + F.floor(a / 2)) / F.when(a == 0, 1).otherwise(a)))).cast("long")


def _hue(r: Column, g: Column, b: Column, top: Column, d: Column) -> Column:
    safe = F.when(d > 0, d).otherwise(F.lit(1.0))
    sector = F.when(top == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    return F.when(d > 0, sector / 6.0).otherwise(F.lit(0.0))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(top > 0, (top - low) / F.when(top > 0, top).otherwise(1.0)).otherwise(F.lit(0.0))
    return F.struct(_hue(r, g, b, top, top - low).alias("h"), s.alias("s"), top.alias("v"))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    under = F.when(light > 0.5, F.lit(2.0) - top - low).otherwise(top + low)
    s = F.when(d > 0, d / F.when(d > 0, under).otherwise(1.0)).otherwise(F.lit(0.0))
    return F.struct(_hue(r, g, b, top, d).alias("h"), s.alias("s"), light.alias("l"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Each channel falls from v by v * s * its distance from the hue's flat top."""
    turn = F.when(F.isnan(h) | (F.abs(h) == INF), F.lit(0.0)).otherwise(h - F.floor(h)) * 6.0

    def channel(shift: float) -> Column:
        k = F.pmod(turn + shift, F.lit(6.0))
        fall = F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))
        return F.when(s <= 0, v).otherwise(v - v * s * fall)

    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    """Through value and saturation: the same hue circle with other end points."""
    v = light + s * F.least(light, F.lit(1.0) - light)
    sv = F.when(v == 0, F.lit(0.0)).otherwise((F.lit(1.0) - light / F.when(v == 0, 1.0).otherwise(v)) * 2.0)
    rgb = hsv_to_rgb(h, sv, v)
    return F.struct(*[F.when(s <= 0, light).otherwise(rgb[c]).alias(c) for c in "rgb"])


def target_size(w: Column, h: Column, box_w: int, box_h: int, cover: bool = False) -> Column:
    """Struct (tw, th): the size for a box, never larger than the source."""
    sx = F.lit(float(box_w)) / w if box_w > 0 else None
    sy = F.lit(float(box_h)) / h if box_h > 0 else None
    both = [s for s in (sx, sy) if s is not None]
    s = F.lit(1.0) if not both else both[0] if len(both) == 1 else (F.greatest if cover else F.least)(*both)
    side = lambda n: F.when(s >= 1, n).otherwise(F.least(n, F.greatest(F.lit(1), F.floor(n * s + 0.5)))).cast("long")
    return F.struct(side(w).alias("tw"), side(h).alias("th"))


def crop_to_aspect(full_w: Column, full_h: Column, w: Column, h: Column) -> Column:
    """Struct (x, y, w, h): the centred part with the full image's aspect, or all within 2 %."""
    want, have = full_w / full_h, w / h
    fits = F.abs(have - want) <= want * 0.02
    nh = F.when(~fits & (want > have), F.greatest(F.lit(1), F.floor(w / want + 0.5))).otherwise(h).cast("long")
    nw = F.when(~fits & (want <= have), F.greatest(F.lit(1), F.floor(h * want + 0.5))).otherwise(w).cast("long")
    return F.struct(F.floor((w - nw) / 2).alias("x"), F.floor((h - nh) / 2).alias("y"), nw.alias("w"), nh.alias("h"))


def similarity_matrix(scale: Column, rotation: Column, tx: Column, ty: Column, cx: float, cy: float) -> Column:
    """Struct m0..m5 of a scaling and rotation about (cx, cy) and a shift."""
    a, b = scale * F.cos(rotation), scale * F.sin(rotation)
    return F.struct(a.alias("m0"), (-b).alias("m1"), (-a * cx + b * cy + cx + tx).alias("m2"), b.alias("m3"), a.alias("m4"), (-b * cx - a * cy + cy + ty).alias("m5"))
