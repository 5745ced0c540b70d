"""Layouts: an image as one row with an array, or as one row a sample (image_id, y, x, c, v)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables that drivers make (taps, kernels, lookup tables) are broadcast up to so many rows.
BROADCAST_ROWS = 100_000


def small_table(df: DataFrame, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A driver-made table; broadcast only if its size is known to be small."""
    rows = list(rows)
    out = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def sorted_join(pixels: DataFrame) -> DataFrame:
    """A table of samples as a side of a join that sorts: Spark takes what it explodes for as small as its source and would broadcast it."""
    return pixels.hint("merge")


def field(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(image_id, pos, v) of a flat array."""
    out = df.select(F.col(id_col).alias("image_id"), F.posexplode(array_col).alias("pos", "v"))
    return out.select("image_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def to_pixels(flat: DataFrame, width: int, channels: int = 1) -> DataFrame:
    """Row-major interleaved positions to coordinates."""
    p = F.col("pos")
    return flat.select("image_id", F.floor(p / (width * channels)).alias("y"), F.floor(p / channels % width).alias("x"), (p % channels).alias("c"), "v")


def hwc(width: int, channels: int) -> Column:
    return (F.col("y") * width + F.col("x")) * channels + F.col("c")


def chw(width: int, height: int) -> Column:
    return (F.col("c") * height + F.col("y")) * width + F.col("x")


def to_arrays(pixels: DataFrame, position: Column) -> DataFrame:
    """(image_id, data): samples in the order of position."""
    packed = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(position.alias("pos"), "v"))).alias("s"))
    return packed.select("image_id", F.transform("s", lambda x: x["v"]).alias("data"))


def as_u8(v: Column) -> Column:
    """Clamped to 0..255 and rounded half up; what is no number gives 0."""
    return F.when(F.isnan(v), 0).otherwise(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5)).cast("long")
