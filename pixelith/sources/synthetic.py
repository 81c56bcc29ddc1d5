"""Images by formula, for tests and benchmarks: pixels of any size from spark.range, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 65535


def image(spark: SparkSession, height: int, width: int, value: Column, planes: int = 1, image_id: int = 0) -> DataFrame:
    """image_id, row, col, plane, value; value is an expression of row, col and plane."""
    at = spark.range(height * width * planes).select(F.expr(f"cast(id div {width * planes} as int)").alias("row"), F.expr(f"cast(id div {planes} % {width} as int)").alias("col"), F.expr(f"cast(id % {planes} as int)").alias("plane"))
    return at.select(F.lit(image_id).cast("long").alias("image_id"), "row", "col", "plane", value.cast("int").alias("value"))


def gradient(spark: SparkSession, height: int, width: int, most: int = MOST, planes: int = 3) -> DataFrame:
    """Rises along the row, from 0 to most."""
    return image(spark, height, width, F.floor(F.col("col") * F.lit(float(most)) / max(width - 1, 1) + 0.5), planes)


def circle(spark: SparkSession, size: int, fraction: float = 0.5, most: int = MOST, planes: int = 3) -> DataFrame:
    """A black disc on white, its diameter a fraction of the size."""
    c, r = size / 2, size * fraction / 2
    inside = F.pow(F.col("row") + 0.5 - c, 2) + F.pow(F.col("col") + 0.5 - c, 2) <= r * r
    return image(spark, size, size, F.when(inside, 0).otherwise(most), planes)


def checkerboard(spark: SparkSession, height: int, width: int, square: int, most: int = MOST, planes: int = 3) -> DataFrame:
    even = F.expr(f"(row div {square} + col div {square}) % 2 = 0")
    return image(spark, height, width, F.when(even, most).otherwise(0), planes)


def bordered(spark: SparkSession, raw: int, margin: int, inner: int, border: int, most: int = MOST, planes: int = 3) -> DataFrame:
    """A dark margin, a white frame of `border` pixels, black inside: what is left of it tells a crop apart."""
    r, c = F.col("row") - margin, F.col("col") - margin
    inside = (r >= 0) & (r < inner) & (c >= 0) & (c < inner)
    frame = (r < border) | (c < border) | (r >= inner - border) | (c >= inner - border)
    return image(spark, raw, raw, F.when(~inside, int(0.15 * most + 0.5)).when(frame, most).otherwise(0), planes)


def stripes(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(7 row + 13 col) in 12 bits."""
    return image(spark, height, width, (F.col("row") * 7 + F.col("col") * 13).bitwiseAND(0x0FFF))
