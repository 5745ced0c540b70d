"""Feathered tiles: windows, splitting, blending."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import small_table


def _ramp(n: int, lead: int, trail: int) -> list[float]:
    lead = min(max(lead, 0), n)
    trail = min(max(trail, 0), n - lead)
    rise = lambda k, ov: 0.5 - 0.5 * math.cos(math.pi * (k + 0.5) / ov)
    return [rise(i, lead) if i < lead else rise(n - 1 - i, trail) if i >= n - trail else 1.0 for i in range(n)]


def feather_window(width: int, height: int, left: int, right: int, top: int, bottom: int) -> list[tuple[int, int, float]]:
    """(y, x, w): raised cosines over the overlaps, one elsewhere."""
    xs, ys = _ramp(width, left, right), _ramp(height, top, bottom)
    return [(y, x, ys[y] * xs[x]) for y in range(height) for x in range(width)]


def tile_axis(n: int, tile: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """(tile's number, start, length, overlap before, overlap after); overlaps only where a neighbour is."""
    starts, at = [0], 0
    while at + tile < n:
        at += step
        starts.append(at)
    ends = [min(s + tile, n) for s in starts]
    return [(k, s, e - s, ends[k - 1] - s if k else 0, e - starts[k + 1] if k + 1 < len(starts) else 0) for k, (s, e) in enumerate(zip(starts, ends))]


def split(pixels: DataFrame, width: int, height: int, tile: int, step: int) -> DataFrame:
    """(image_id, ty, tx, y, x, c, v): tiles with places of their own; a pixel goes to each tile that covers it."""
    along = lambda n, a: small_table(pixels, [(s + i, k, i) for k, s, m, *_ in tile_axis(n, tile, step) for i in range(m)], f"{a} long, t{a} long, o{a} long")
    hit = pixels.join(along(width, "x"), "x").join(along(height, "y"), "y")
    return hit.select("image_id", "ty", "tx", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "v")


def accumulate(tiles: DataFrame, width: int, height: int, tile: int, step: int) -> DataFrame:
    """(image_id, y, x, c, acc, weight): tiles summed in their places under feathered windows."""

    def along(n: int, a: str) -> DataFrame:
        rows = [(k, i, s + i, w) for k, s, m, lead, trail in tile_axis(n, tile, step) for i, w in enumerate(_ramp(m, lead, trail))]
        return small_table(tiles, rows, f"t{a} long, {a} long, p{a} long, w{a} double")

    hit = tiles.join(along(width, "x"), ["tx", "x"]).join(along(height, "y"), ["ty", "y"])
    w = F.col("wx") * F.col("wy")
    return hit.groupBy("image_id", F.col("py").alias("y"), F.col("px").alias("x"), "c").agg(F.sum(F.col("v") * w).alias("acc"), F.sum(w).alias("weight"))


def normalize_accumulator(sums: DataFrame, eps: float = 1e-6) -> DataFrame:
    return sums.select("image_id", "y", "x", "c", (F.col("acc") / F.greatest(F.col("weight"), F.lit(eps))).alias("v"))
