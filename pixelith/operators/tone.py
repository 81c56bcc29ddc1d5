"""Colour operators that need several steps: each step is a projection of its own, so that every intermediate value is
worked out once, in compiled code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelith import small_methods
from pixelith.functions.pixels import hsv_to_rgb, num, pick, rgb_to_hsv


def hue_sat(pixels: DataFrame, deltas: Sequence[tuple[float, float, float]], divisions: tuple[int, int, int], other: Sequence[tuple[float, float, float]] | None = None, weight: Column | None = None) -> DataFrame:
    """functions.pixels.hue_sat_map() on the columns r, g, b; other columns pass through.

    With other, the table is weight * deltas + (1 - weight) * other, for a weight that each row has: the tables of two
    illuminants, and how near each picture's light is to the first.
    """
    small_methods(pixels.sparkSession)
    nh, ns, nv = divisions
    keep = [c for c in pixels.columns if c not in ("r", "g", "b")]
    h, s, v = rgb_to_hsv(*[F.greatest(F.col(c), num(0.0)) for c in "rgb"])
    df = pixels.select(*keep, h.alias("_h"), s.alias("_s"), v.alias("_v"))
    scaled = {"_hs": F.col("_h") * num(0.0 if nh < 2 else nh / 6.0), "_ss": F.col("_s") * num(ns - 1), "_vs": F.col("_v") * num(max(nv - 1, 0))}
    df = df.withColumns(scaled)

    def cell(x: str, most: int) -> Column:
        return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(max(0, most))).cast("int")

    df = df.withColumns({"_h0": cell("_hs", nh - 1), "_s0": cell("_ss", ns - 2), "_v0": cell("_vs", nv - 2)})
    after = {"_h1": F.when(F.col("_h0") >= nh - 1, 0).otherwise(F.col("_h0") + 1), "_s1": F.least(F.col("_s0") + 1, F.lit(ns - 1)), "_v1": F.least(F.col("_v0") + 1, F.lit(max(nv - 1, 0)))}
    df = df.withColumns(after | {"_fh": F.col("_hs") - F.col("_h0"), "_fs": F.col("_ss") - F.col("_s0"), "_fv": F.col("_vs") - F.col("_v0")})
    fh, fs, fv = F.col("_fh"), F.col("_fs"), F.col("_fv")
    planes = [("_v0", num(1.0) - fv), ("_v1", fv)] if nv >= 2 else [("_v0", None)]

    def entry(k: int) -> Column:
        one = looked_up([d[k] for d in deltas])
        return one if other is None else weight * one + (num(1.0) - weight) * looked_up([d[k] for d in other])

    def looked_up(flat: list[float]) -> Column:
        def side(at: str) -> Column:
            total = None
            for plane, weight in planes:
                cells = [pick(flat, (F.col(plane) * nh + F.col(hue)) * ns + F.col(at)) for hue in ("_h0", "_h1")]
                one = (num(1.0) - fh) * cells[0] + fh * cells[1]
                part = one if weight is None else weight * one
                total = part if total is None else total + part
            return total

        return (num(1.0) - fs) * side("_s0") + fs * side("_s1")

    moved = [(F.col("_h") + entry(0) * num(6.0 / 360.0)).alias("_h"), F.least(F.col("_s") * entry(1), num(1.0)).alias("_s"), F.greatest(F.col("_v") * entry(2), num(0.0)).alias("_v")]
    df = df.select(*keep, *moved)
    return df.select(*keep, *[c.alias(n) for c, n in zip(hsv_to_rgb(F.col("_h"), F.col("_s"), F.col("_v")), "rgb", strict=True)])
