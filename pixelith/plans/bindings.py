"""Images bound to the given tables, as DataFrames and as DuckDB SQL.

Mosaic images: 100 vectors of `embeddings` are an image, a vector is a scanline. Plane images: the numbers of a
vector are pixels of 3 planes, the last of which has one plane only. RGB pixels: rows of `lineitem`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelith import reachable, small_methods

HEIGHT, WIDTH = 100, 64
BOUNDS = (0, 0, HEIGHT, WIDTH)
BLACK, WHITE = 64.0, 4095.0
#: Linear values are put on this grid where sums must not depend on their order.
GRID = 1048576.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    small_methods(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x: Column, scale: float = 1e6) -> Column:
    """A whole number for comparing."""
    return F.floor(x * F.lit(float(scale)) + 0.5).cast("long")


def mosaic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, row, plane, vals: raw numbers of the mosaic images."""
    e = read(spark, sf_dir, "embeddings")
    dn = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 2048.0).cast("int"))
    return e.select(F.expr("vec_id div 100").alias("image_id"), F.expr("cast(vec_id % 100 as int)").alias("row"), F.lit(0).alias("plane"), dn.alias("vals"))


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mosaic_lines(spark, sf_dir)
    return lines.select("image_id", "row", F.posexplode("vals").alias("col", "value"), "plane")


def plane_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mosaic_lines(spark, sf_dir)
    flat = lines.select("image_id", "row", F.posexplode("vals").alias("pos", "value"))
    return flat.select("image_id", "row", F.expr("pos div 3").cast("int").alias("col"), F.expr("pos % 3").cast("int").alias("plane"), "value")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("r"), (F.col("l_extendedprice") / 105000.0).alias("g"), (F.col("l_discount") * 10.0).alias("b"))


def d(x: float) -> str:
    """A DuckDB literal of exactly this double."""
    return f"'{float(x)!r}'::DOUBLE"


def arr(values) -> str:
    return "[" + ", ".join(d(v) for v in values) + "]"


def sql_q(expr: str, scale: float = 1e6) -> str:
    return f"CAST(floor(({expr}) * {d(scale)} + {d(0.5)}) AS BIGINT)"


MOSAIC = """rb1 AS (SELECT vec_id // 100 AS image_id, CAST(vec_id % 100 AS INT) AS "row", CAST(pos AS INT) AS col, 0 AS plane,
 CAST(floor((CAST(v AS DOUBLE) + '1.0'::DOUBLE) * '2048.0'::DOUBLE) AS INT) AS value
 FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))"""
PLANES = MOSAIC + """, rb2 AS (SELECT image_id, "row", CAST(col // 3 AS INT) AS col, CAST(col % 3 AS INT) AS plane, value FROM rb1)"""
LINEAR = MOSAIC + f""", lin AS (SELECT image_id, "row", col, plane, least((value - {d(BLACK)}) * {d(1.0 / (WHITE - BLACK))}, {d(1.0)}) AS x FROM rb1)"""
DYADIC = LINEAR + f""", dy AS (SELECT image_id, "row", col, plane, floor(x * {d(GRID)}) / {d(GRID)} AS x FROM lin)"""
RGB = f"""rb3 AS (SELECT l_orderkey, l_linenumber, l_quantity / {d(50)} AS r, l_extendedprice / {d(105000)} AS g, l_discount * {d(10)} AS b FROM lineitem)"""
