"""Reductions, gradients, lookups and stencils over fields and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import lookup_index
from .layout import small_table


def strided(field: DataFrame, stride: int) -> DataFrame:
    return field.where(F.col("pos") % max(1, stride) == 0)


def reduce_minmax(field: DataFrame, by: list[str], stride: int = 1) -> DataFrame:
    """(min, max): values that are no number are skipped, unless the first is one, which then stays."""
    s = strided(field, stride)
    first, v = F.min_by("v", "pos"), F.when(~F.isnan("v"), F.col("v"))
    keep = lambda x: F.when(F.isnan(first), first).otherwise(x)
    return s.groupBy(*by).agg(keep(F.min(v)).alias("min"), keep(F.max(v)).alias("max"))


def reduce_sum(field: DataFrame, by: list[str], stride: int = 1) -> DataFrame:
    return strided(field, stride).groupBy(*by).agg(F.sum("v").alias("sum"))


def reduce_mean(field: DataFrame, by: list[str], stride: int = 1) -> DataFrame:
    return strided(field, stride).groupBy(*by).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))


def reduce_histogram(field: DataFrame, bins: int, lo: float, hi: float, by: list[str] | None = None, stride: int = 1) -> DataFrame:
    """Counts of all bins, empty ones too. Bins are cut towards zero, so (-1, 0) of a bin counts in the first; hi is out."""
    by = by or []
    place = (F.col("v") - F.lit(lo)) * F.lit(bins / (hi - lo) if hi > lo else 0.0)
    hit = strided(field, stride).withColumn("_f", place).where(~F.isnan("_f") & (F.col("_f") > -1) & (F.col("_f") < bins))
    counts = hit.groupBy(*by, F.greatest(F.floor("_f"), F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = small_table(field, [(i,) for i in range(bins)], "bin long")
    groups = field.select(*by).distinct() if by else None
    grid = groups.crossJoin(grid) if groups is not None else grid
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def gradient(spark, stops: list[tuple], n: int) -> DataFrame:
    """(idx, r, g, b, a): a table of n colours between stops (t, r, g, b, a); an alpha below 0 is opaque."""
    grid = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") / max(1, n - 1)).alias("t"))
    if n < 2 or len(stops) < 2:
        return grid.select("idx", *[F.lit(0).cast("long").alias(c) for c in "rgba"])
    fixed = [(t, r, g, b, 255.0 if a < 0 else a) for t, r, g, b, a in stops]
    # One row an interval, open at its left; beyond the ends the end colours hold.
    rows = [(-1e30, fixed[0][0], fixed[0], fixed[0])] + [(p[0], q[0], p, q) for p, q in zip(fixed, fixed[1:])] + [(fixed[-1][0], 1e30, fixed[-1], fixed[-1])]
    flat = [(k, lo, hi, *map(float, p[1:]), *map(float, q[1:])) for k, (lo, hi, p, q) in enumerate(rows)]
    cols = "k int, lo double, hi double, " + ", ".join(f"{c}{i} double" for i in (0, 1) for c in "rgba")
    spans = small_table(grid, flat, cols)
    hit = grid.join(spans, (F.col("t") <= F.col("hi")) & ((F.col("t") > F.col("lo")) | (F.col("k") == 0)) & ((F.col("t") < fixed[-1][0]) | (F.col("k") == len(rows) - 1)) | ((F.col("t") >= fixed[-1][0]) & (F.col("k") == len(rows) - 1)))
    u = F.when((F.col("k") > 0) & (F.col("k") < len(rows) - 1) & (F.col("hi") - F.col("lo") > 1e-9), (F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))).otherwise(F.lit(0.0))
    byte = lambda c: F.floor(F.least(F.greatest(F.col(c + "0") + (F.col(c + "1") - F.col(c + "0")) * u, F.lit(0.0)), F.lit(255.0))).cast("long").alias(c)
    return hit.select("idx", *[byte(c) for c in "rgba"])


def lookup(field: DataFrame, lut: DataFrame, n: int, lo: float, hi: float, wrap: bool = False) -> DataFrame:
    """field with the colours of a table (idx, r, g, b, a) of n rows."""
    table = F.broadcast(lut) if n <= 100_000 else lut
    return field.withColumn("idx", lookup_index(F.col("v"), n, lo, hi, wrap)).join(table, "idx")


def _edge(i: int, n: int, edge: str) -> int | None:
    if edge == "wrap":
        return i % n
    if edge == "clamp":
        return min(max(i, 0), n - 1)
    return i if 0 <= i < n else None


def stencil(pixels: DataFrame, width: int, height: int, kernel: list[list[float]], divisor: float = 1.0, bias: float = 0.0, edge: str = "clamp") -> DataFrame:
    """Correlation with an odd kernel, channel by channel.

    Two small tables say which destination columns and rows a source column and
    row serve with which kernel column and row; pixels join them, then sum.
    """
    kh, kw = len(kernel), len(kernel[0])

    def reach(n: int, k: int) -> list[tuple]:
        return [(s, d, j) for d in range(n) for j in range(k) if (s := _edge(d + j - k // 2, n, edge)) is not None]

    xs = small_table(pixels, reach(width, kw), "x long, dx long, kx int")
    ys = small_table(pixels, reach(height, kh), "y long, dy long, ky int")
    ks = small_table(pixels, [(j, i, float(kernel[j][i])) for j in range(kh) for i in range(kw)], "ky int, kx int, w double")
    hit = pixels.join(ys, "y").join(xs, "x").join(ks, ["ky", "kx"])
    total = hit.groupBy("image_id", F.col("dy").alias("y"), F.col("dx").alias("x"), "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return total.select("image_id", "y", "x", "c", (F.col("s") * F.lit(1.0 / divisor if divisor else 1.0) + F.lit(bias)).alias("v"))
