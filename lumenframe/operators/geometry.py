"""Resizing, cropping, padding, turning and warping of pixels.

A resampling is two small tables of taps (destination, source, weight), one an
axis, joined with the pixels and summed: columns first, then rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import premultiply, unpremultiply
from . import layout
from .layout import as_u8, small_table, sorted_join

FILTERS = ("nearest", "bilinear", "bicubic", "lanczos3", "area")


def _clamp(i: int, n: int) -> int:
    return min(max(i, 0), n - 1)


def _cubic(t: float) -> float:
    """Catmull-Rom."""
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def _lanczos(t: float) -> float:
    if abs(t) >= 3:
        return 0.0
    return 1.0 if abs(t) < 1e-7 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2


def axis_taps(src: int, dst: int, kind: str) -> list[tuple[int, int, float]]:
    """(destination, source, weight), sources once each; centres of samples are at halves."""
    scale = src / dst
    rows = []
    for d in range(dst):
        centre = (d + 0.5) * scale - 0.5
        if src == dst and kind != "area":
            taps = [(d, 1.0)]
        elif kind == "nearest":
            taps = [(_clamp(int((d + 0.5) * scale), src), 1.0)]
        elif kind == "bilinear" or (kind == "area" and dst > src):
            lo = math.floor(centre)
            taps = [(_clamp(lo, src), 1 - (centre - lo)), (_clamp(lo + 1, src), centre - lo)]
        elif kind == "bicubic":
            lo = math.floor(centre)
            taps = [(_clamp(lo + k, src), _cubic(lo + k - centre)) for k in range(-1, 3)]
        elif kind == "lanczos3":
            wide = max(1.0, scale)
            lo = math.floor(centre - 3 * wide) + 1
            raw = [(_clamp(lo + k, src), _lanczos((lo + k - centre) / wide)) for k in range(2 * math.ceil(3 * wide))]
            total = sum(w for _, w in raw)
            taps = [(s, w / total) for s, w in raw]
        else:
            a, b = d * scale, (d + 1) * scale
            raw = [(s, min(s + 1, b) - max(s, a)) for s in range(int(a), min(src, math.ceil(b - 1e-12)))]
            total = sum(w for _, w in raw)
            taps = [(s, w / total) for s, w in raw]
        merged: dict[int, float] = {}
        for s, w in taps:
            merged[s] = merged.get(s, 0.0) + w
        rows += [(d, s, w) for s, w in merged.items() if w]
    return rows


def _along(pixels: DataFrame, axis: str, taps: list, total) -> DataFrame:
    t = small_table(pixels, [(s, d, w) for d, s, w in taps], f"{axis} long, _d long, _w {'long' if isinstance(taps[0][2], int) else 'double'}")
    keys = [F.col("_d").alias(k) if k == axis else F.col(k) for k in ("y", "x")]
    return pixels.join(t, axis).groupBy("image_id", *keys, "c").agg(total(F.sum(F.col("v") * F.col("_w"))).alias("v"))


def resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], kind: str = "bilinear") -> DataFrame:
    """size and to are (width, height). Equal sizes give the pixels back unchanged."""
    if kind not in FILTERS:
        raise ValueError(f"no such filter: {kind}")
    if size == to:
        return pixels
    out = _along(pixels, "x", axis_taps(size[0], to[0], kind), lambda s: s) if size[0] != to[0] else pixels
    return _along(out, "y", axis_taps(size[1], to[1], kind), lambda s: s) if size[1] != to[1] else out


def fixed_taps(src: int, dst: int) -> list[tuple[int, int, int]]:
    """Area weights in 1/16384, summing to exactly that; the largest takes the rest."""
    out: list[tuple[int, int, int]] = []
    by: dict[int, list[tuple[int, int]]] = {}
    for d, s, w in axis_taps(src, dst, "area"):
        by.setdefault(d, []).append((s, int(math.floor(w * 16384 + 0.5))))
    for d, row in by.items():
        best = max(range(len(row)), key=lambda k: (row[k][1], -k))
        row[best] = (row[best][0], row[best][1] + 16384 - sum(w for _, w in row))
        out += [(d, s, w) for s, w in row]
    return out


def resize_area_u8(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Integer arithmetic throughout: six bits of fraction between the passes."""
    wide = _along(pixels, "x", fixed_taps(size[0], to[0]), lambda s: F.shiftright(s + 32, 6))
    return _along(wide, "y", fixed_taps(size[1], to[1]), lambda s: F.shiftright(s + (1 << 21), 22))


def resize_u8(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], kind: str = "bilinear") -> DataFrame:
    if kind == "area" and to[0] <= size[0] and to[1] <= size[1]:
        return resize_area_u8(pixels, size, to)
    return resize(pixels, size, to, kind).withColumn("v", as_u8(F.round("v", 6)))


def grid(pixels: DataFrame, width: int, height: int, channels: int) -> DataFrame:
    """Every place of every image."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(width * height * channels - 1))).alias("_p")
    g = pixels.select("image_id").distinct().select("image_id", cells)
    return g.select("image_id", F.floor(F.col("_p") / (width * channels)).alias("y"), F.floor(F.col("_p") / channels % width).alias("x"), (F.col("_p") % channels).cast("long").alias("c"))


def pad(pixels: DataFrame, to: tuple[int, int], channels: int, off: tuple[int, int], fill: list[int], images: DataFrame | None = None) -> DataFrame:
    """Pixels moved by off onto a filled canvas, one for each image (of `images`, where given); what is outside is cut."""
    moved = pixels.select("image_id", (F.col("y") + off[1]).alias("y"), (F.col("x") + off[0]).alias("x"), "c", "v")
    colour = F.element_at(F.array(*[F.lit(f) for f in [*fill, *[0] * channels][:channels]]), (F.col("c") + 1).cast("int"))
    return grid(pixels if images is None else images, *to, channels).join(sorted_join(moved), ["image_id", "y", "x", "c"], "left").select("image_id", "y", "x", "c", F.coalesce("v", colour).alias("v"))


def crop(pixels: DataFrame, size: tuple[int, int], at: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """A part of the image; beyond the edges the edge repeats."""
    xs = small_table(pixels, [(_clamp(at[0] + d, size[0]), d) for d in range(to[0])], "x long, dx long")
    ys = small_table(pixels, [(_clamp(at[1] + d, size[1]), d) for d in range(to[1])], "y long, dy long")
    return pixels.join(xs, "x").join(ys, "y").select("image_id", F.col("dy").alias("y"), F.col("dx").alias("x"), "c", "v")


def center_crop(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    return crop(pixels, size, (int((size[0] - to[0]) / 2), int((size[1] - to[1]) / 2)), to)


def letterbox_rect(size: tuple[int, int], to: tuple[int, int]) -> tuple[int, int, int, int]:
    s = min(to[0] / size[0], to[1] / size[1])
    w, h = (min(t, max(1, int(math.floor(n * s + 0.5)))) for n, t in zip(size, to))
    return (to[0] - w) // 2, (to[1] - h) // 2, w, h


def letterbox_u8(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], channels: int, fill: list[int], kind: str = "bilinear") -> DataFrame:
    x, y, w, h = letterbox_rect(size, to)
    return pad(resize_u8(pixels, size, (w, h), kind), to, channels, (x, y), fill)


def _moved(pixels: DataFrame, y, x) -> DataFrame:
    return pixels.select("image_id", y.alias("y"), x.alias("x"), "c", "v")


def flip_horizontal(pixels: DataFrame, width: int) -> DataFrame:
    return _moved(pixels, F.col("y"), F.lit(width - 1) - F.col("x"))


def flip_vertical(pixels: DataFrame, height: int) -> DataFrame:
    return _moved(pixels, F.lit(height - 1) - F.col("y"), F.col("x"))


def rotate_90(pixels: DataFrame, size: tuple[int, int], turns: int = 1) -> DataFrame:
    """Counter-clockwise quarter turns."""
    w, h, y, x = *size, F.col("y"), F.col("x")
    return _moved(pixels, *[(y, x), (F.lit(w - 1) - x, y), (F.lit(h - 1) - y, F.lit(w - 1) - x), (x, F.lit(h - 1) - y)][turns % 4])


def orient(pixels: DataFrame, size: tuple[int, int], orientation) -> DataFrame:
    """The stored pixels as they are to be seen, by an orientation of 1 to 8 (a Column)."""
    w, h, y, x = *size, F.col("y"), F.col("x")
    my, mx = F.lit(h - 1) - y, F.lit(w - 1) - x
    places = {2: (y, mx), 3: (my, mx), 4: (my, x), 5: (x, y), 6: (x, my), 7: (mx, my), 8: (mx, y)}
    ny, nx = y, x
    for k, (a, b) in places.items():
        ny, nx = F.when(orientation == k, a).otherwise(ny), F.when(orientation == k, b).otherwise(nx)
    return _moved(pixels, ny, nx)


def warp_affine_u8(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], m: list[float], channels: int, kind: str = "bilinear", fill: list[int] | None = None) -> DataFrame:
    """Every destination's centre is mapped by m (2x3) into the source; outside of it the fill shows.

    The destinations, each with its taps, are made by Spark and are the same for all
    images: up to BROADCAST_ROWS taps they are broadcast once. Beyond that they are made
    for each image and joined with the pixels on image and place, so neither the driver
    nor one key holds a whole picture.
    """
    spark, cells = pixels.sparkSession, to[0] * to[1]
    once = cells * {"nearest": 1, "bilinear": 4}.get(kind, 16) <= layout.BROADCAST_ROWS
    by, on = ([], ["y", "x"]) if once else (["image_id"], ["image_id", "y", "x"])
    px, py = F.col("dx") + 0.5, F.col("dy") + 0.5
    g = spark.range(0, cells, 1, 1).withColumnRenamed("id", "_p") if once else pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_p"))
    g = g.select(*by, F.floor(F.col("_p") / to[0]).alias("dy"), (F.col("_p") % to[0]).cast("long").alias("dx"))
    g = g.select(*by, "dy", "dx", (px * m[0] + py * m[1] + m[2]).alias("sx"), (px * m[3] + py * m[4] + m[5]).alias("sy"))
    g = g.where(F.col("sx").between(0, size[0]) & F.col("sy").between(0, size[1]))
    edge = lambda e, n: F.least(F.greatest(e.cast("long"), F.lit(0)), F.lit(n - 1))
    if kind == "nearest":
        taps = g.select(*by, "dy", "dx", edge(F.floor("sy"), size[1]).alias("y"), edge(F.floor("sx"), size[0]).alias("x"), F.lit(1.0).alias("w"))
    else:
        near = [0, 1] if kind == "bilinear" else [-1, 0, 1, 2]
        off = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in near for i in near])).alias("o")
        u, v = F.col("sx") - 0.5, F.col("sy") - 0.5
        g = g.select(*by, "dy", "dx", u.alias("u"), v.alias("v"), off).select(*by, "dy", "dx", "u", "v", (F.floor("u") + F.col("o.i")).alias("qx"), (F.floor("v") + F.col("o.j")).alias("qy"))

        def weigh(t):
            t = F.abs(t)
            return 1 - t if kind == "bilinear" else F.when(t < 1, t * t * t * 1.5 - t * t * 2.5 + 1).otherwise(t * t * t * -0.5 + t * t * 2.5 - t * 4 + 2)

        taps = g.select(*by, "dy", "dx", edge(F.col("qy"), size[1]).alias("y"), edge(F.col("qx"), size[0]).alias("x"), (weigh(F.col("qy") - F.col("v")) * weigh(F.col("qx") - F.col("u"))).alias("w"))
    hit = pixels.join(F.broadcast(taps) if once else sorted_join(taps), on).groupBy("image_id", F.col("dy").alias("y"), F.col("dx").alias("x"), "c").agg(as_u8(F.round(F.sum(F.col("v") * F.col("w")), 6)).alias("v"))
    return pad(hit, to, channels, (0, 0), fill or [0] * channels, pixels)


def premultiplied(pixels: DataFrame, back: bool = False) -> DataFrame:
    """Colours times alpha (channel 3), or back."""
    rows = pixels.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    f = unpremultiply if back else premultiply
    new = F.array(*[F.struct(F.lit(k).cast("long").alias("c"), (f(F.col(f"v{k}"), F.col("v3")) if k < 3 else F.col("v3")).alias("v")) for k in range(4)])
    return rows.select("image_id", "y", "x", F.inline(new))


def resize_rgba8_alpha(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], kind: str = "bilinear") -> DataFrame:
    return premultiplied(resize_u8(premultiplied(pixels), size, to, kind), back=True)


def letterbox_rgba8_alpha(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], fill: list[int], kind: str = "bilinear") -> DataFrame:
    x, y, w, h = letterbox_rect(size, to)
    return pad(resize_rgba8_alpha(pixels, size, (w, h), kind), to, 4, (x, y), fill)
