"""Channels, layouts, matrices and normalization of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import as_u8, small_table

# The published means and deviations of three model families.
PRESETS = {
    "clip": ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)),
    "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "sam": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
}


def presets(spark) -> DataFrame:
    return spark.createDataFrame([(n, c, m[c], s[c]) for n, (m, s) in PRESETS.items() for c in range(3)], "name string, c long, mean double, std double")


def drop_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.where("c < 3")


def add_alpha(pixels: DataFrame, alpha: int = 255) -> DataFrame:
    """One more row for each pixel, from its first channel: no shuffle."""
    return pixels.select("image_id", "y", "x", F.inline(F.when(F.col("c") == 0, F.array(F.struct("c", "v"), F.struct(F.lit(3).cast("long").alias("c"), F.lit(alpha).cast("long").alias("v")))).otherwise(F.array(F.struct("c", "v")))))


def by_pixel(pixels: DataFrame, channels: int) -> DataFrame:
    """(image_id, y, x, v0, v1, ...)."""
    return pixels.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"v{k}") for k in range(channels)])


def weigh_channels(pixels: DataFrame, weights: list[int]) -> DataFrame:
    """(image_id, y, x, s): the weighed sum of the first channels."""
    w = F.lit(0)
    for k, n in enumerate(weights):
        w = F.when(F.col("c") == k, F.lit(n)).otherwise(w)
    return pixels.where(F.col("c") < len(weights)).groupBy("image_id", "y", "x").agg(F.sum(F.col("v") * w).alias("s"))


def to_gray(pixels: DataFrame) -> DataFrame:
    return weigh_channels(pixels, [77, 150, 29]).select("image_id", "y", "x", F.shiftright("s", 8).alias("v"))


def color_matrix(pixels: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 3x3 or 3x4 matrix over channels 0..2; further channels pass. Each sample goes to the three sums it is part of."""
    rows = [(j, i, matrix[i][j]) for i in range(3) for j in range(3)] + [(3, 3, 1.0)]
    m = small_table(pixels, rows, "c long, out long, w double")
    bias = F.lit(0.0)
    for i in range(3):
        bias = F.when(F.col("out") == i, F.lit(float(matrix[i][3] if len(matrix[i]) > 3 else 0.0))).otherwise(bias)
    total = pixels.join(m, "c").groupBy("image_id", "y", "x", "out").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return total.select("image_id", "y", "x", F.col("out").alias("c"), (F.col("s") + bias).alias("v"))


def normalize(pixels: DataFrame, mean, std) -> DataFrame:
    """(v - mean) / std by channel; a deviation of 0 gives 0."""
    stats = small_table(pixels, [(c, float(m), 1.0 / s if s else 0.0) for c, (m, s) in enumerate(zip(mean, std))], "c long, mean double, inv double")
    return pixels.join(stats, "c").select("image_id", "y", "x", "c", ((F.col("v") - F.col("mean")) * F.col("inv")).alias("v"))


def u8_to_f32(v: Column, scale: float = 1.0, bias: float = 0.0) -> Column:
    return v * F.lit(scale) + F.lit(bias)


def f32_to_u8(v: Column, scale: float = 1.0, bias: float = 0.0) -> Column:
    return as_u8(v * F.lit(scale) + F.lit(bias))
