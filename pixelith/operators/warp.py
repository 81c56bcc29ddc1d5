"""Lens warps: where a pixel comes from is a Column expression; resampling gathers 4 x 4 windows by bands of source rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelith.functions.pixels import clamp, num
from pixelith.operators.raster import BAND, to_scanlines

#: Bicubic coefficient, window and sub-positions of the resampling (fixed values).
A, WINDOW, STEPS = -0.75, 4, 32


@dataclass(frozen=True)
class Rectilinear:
    """Radial k0 + k2 r^2 + k4 r^4 + k6 r^6 and two tangential terms."""

    radial: Sequence[float]
    tangential: Sequence[float] = (0.0, 0.0)
    center: tuple[float, float] = (0.5, 0.5)

    @property
    def plain(self) -> bool:
        return list(self.radial) == [1.0, 0.0, 0.0, 0.0]

    def ratio(self, r2: Column) -> Column:
        x = clamp(r2, 0, 1)
        k = self.radial
        return num(k[0]) + x * (num(k[1]) + x * (num(k[2]) + x * num(k[3])))


@dataclass(frozen=True)
class Rectilinear2(Rectilinear):
    """A polynomial in r of up to 15 terms on a valid range, or its reciprocal."""

    valid: tuple[float, float] = (0.0, 1.0)
    reciprocal: bool = False

    @property
    def plain(self) -> bool:
        return self.radial[0] == 1.0 and not any(self.radial[1:])

    def ratio(self, r2: Column) -> Column:
        r = F.sqrt(clamp(r2, self.valid[0] ** 2, self.valid[1] ** 2))
        total = num(self.radial[-1])
        for k in reversed(self.radial[:-1]):
            total = total * r + num(k)
        return num(1.0) / total if self.reciprocal else total


@dataclass(frozen=True)
class Fisheye(Rectilinear):
    """t = atan r, t (k0 + k1 t^2 + k2 t^4 + k3 t^6) / r; never the identity."""

    @property
    def plain(self) -> bool:
        return False

    def ratio(self, r2: Column) -> Column:
        r = F.sqrt(r2)
        t = F.atan(r)
        t2 = t * t
        k = self.radial
        return F.when(r2 < 1e-12, num(1.0)).otherwise(t * (num(k[0]) + t2 * (num(k[1]) + t2 * (num(k[2]) + t2 * num(k[3])))) / F.when(r > 0, r))


def source_position(row: Column, col: Column, bounds: tuple[int, int, int, int], p: Rectilinear) -> tuple[Column, Column]:
    """Row and column that a pixel comes from, not yet held inside the image. Pixels are square."""
    t, l, b, r = bounds
    ch, cv = l + (r - l) * p.center[0], t + (b - t) * p.center[1]
    reach = max(math.hypot(cv - y, ch - x) for y in (t, b) for x in (l, r))
    dv, dh = row - num(cv), col - num(ch)
    nv, nh = dv * num(1.0 / reach), dh * num(1.0 / reach)
    r2 = F.least(nv * nv + nh * nh, num(1.0))
    k0, k1 = p.tangential
    bent = bool(k0 or k1)
    tan_v = num(k0) * (r2 + num(2.0) * (nv * nv)) + num(2.0 * k1) * nh * nv
    tan_h = num(k1) * (r2 + num(2.0) * (nh * nh)) + num(2.0 * k0) * nh * nv
    if not bent:
        ratio = p.ratio(r2)
        return num(cv) + dv * ratio, num(ch) + dh * ratio
    if p.plain:
        return num(cv) + (dv + num(reach) * tan_v), num(ch) + (dh + num(reach) * tan_h)
    ratio = p.ratio(r2)
    return num(cv) + num(reach) * (nv * ratio + tan_v), num(ch) + num(reach) * (nh * ratio + tan_h)


def kernel(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    far = ((A * x - 5 * A) * x + 8 * A) * x - 4 * A
    near = ((A + 2) * x - (A + 3)) * x * x + 1
    return np.where(x >= 2, 0.0, np.where(x >= 1, far, near))


def weights() -> np.ndarray:
    """STEPS x WINDOW weights of an axis, before normalisation."""
    return kernel(np.arange(WINDOW)[None] - 1 - np.arange(STEPS)[:, None] / STEPS)


def window_start(position: Column, low: int, high: int) -> tuple[Column, Column]:
    """First line of the window and the sub-position, from a position inside the image; windows stay in [low, high]."""
    whole = F.floor(position)
    part = F.floor((position - whole) * STEPS)
    first = whole - 1
    out = (first < low) | (first > high)
    return F.least(F.greatest(first, F.lit(low)), F.lit(high)).cast("int"), F.when(out, 0).otherwise(part).cast("int")


def warp(pixels: DataFrame, bounds: tuple[int, int, int, int], p: Rectilinear, by_plane: dict[int, Rectilinear] | None = None) -> DataFrame:
    """Resamples image_id, row, col, plane, value. by_plane: parameters of a plane that differ from p.

    A pixel goes to the band of rows in which its window begins, as the scanlines of that band and the WINDOW - 1 after it
    do. So a task has some scanlines and the pixels that look at them, whatever the size of the image; positions come
    with the pixels, already worked out. Scanlines that the table lacks have no weight; a pixel that sees only such ones
    has no row, and one whose weights sum to 0 is null.
    """
    t, l, b, r = bounds
    if b - WINDOW - 1 < t or r - WINDOW - 1 < l:
        raise ValueError("image smaller than the window")
    if p.plain and not any(p.tangential) and not by_plane:
        return pixels
    row = col = None
    for plane, q in [*(by_plane or {}).items(), (None, p)]:
        v, h = source_position(F.col("row"), F.col("col"), bounds, q)
        if plane is not None:
            row = F.when(F.col("plane") == plane, v) if row is None else row.when(F.col("plane") == plane, v)
            col = F.when(F.col("plane") == plane, h) if col is None else col.when(F.col("plane") == plane, h)
        else:
            row, col = (v, h) if row is None else (row.otherwise(v), col.otherwise(h))
    r0, rf = window_start(clamp(row, t, b - 1), t, b - WINDOW - 1)
    c0, cf = window_start(clamp(col, l, r - 1), l, r - WINDOW - 1)
    targets = pixels.select("image_id", "plane", "row", "col", r0.alias("r0"), rf.alias("rf"), c0.alias("c0"), cf.alias("cf")).withColumn("band", F.floor(F.col("r0") / BAND).cast("int"))
    lines = to_scanlines(pixels.withColumn("value", F.col("value").cast("double")))
    home = F.floor(F.col("row") / BAND).cast("int")
    lines = lines.withColumn("band", F.explode(F.array_distinct(F.array(home, F.floor((F.col("row") - (WINDOW - 1)) / BAND).cast("int")))))
    axis = weights()
    names = ("image_id", "row", "col", "plane", "value")

    def resample(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n == "image_id" else pa.float64() if n == "value" else pa.int32()) for n in names})
        first = key[2].as_py() * BAND
        image, there = np.zeros((BAND + WINDOW - 1, r - l)), np.zeros(BAND + WINDOW - 1, bool)
        for row, vals in zip(right.column("line").to_pylist(), right.column("vals"), strict=True):
            image[row - first], there[row - first] = vals.values.to_numpy(), True
        g = {c: left.column(c).to_numpy() for c in ("r0", "rf", "c0", "cf")}
        value, seen_any = np.empty(left.num_rows), np.empty(left.num_rows, bool)
        for a in range(0, left.num_rows, 1 << 16):
            some = slice(a, a + (1 << 16))
            rows, cols = g["r0"][some][:, None] - first + np.arange(WINDOW), g["c0"][some][:, None] - l + np.arange(WINDOW)
            wr, wc = axis[g["rf"][some]] * there[rows], axis[g["cf"][some]]
            seen = image[rows[:, :, None], cols[:, None, :]]
            weight = wr.sum(axis=1) * wc.sum(axis=1)
            value[some] = np.einsum("nij,ni,nj->n", seen, wr, wc) / np.where(weight == 0, np.nan, weight)
            seen_any[some] = there[rows].any(axis=1)
        out = pa.table({"image_id": left.column("image_id"), "row": left.column("row"), "col": left.column("col"), "plane": left.column("plane"), "value": pa.array(value, from_pandas=True)})
        return out if seen_any.all() else out.filter(pa.array(seen_any))

    # columns that both sides have from one table need new names, or one side's would be taken for the other's
    lines = lines.select(F.col("image_id").alias("_image"), F.col("plane").alias("_plane"), F.col("band").alias("_band"), F.col("row").alias("line"), "vals")
    return targets.groupBy("image_id", "plane", "band").cogroup(lines.groupBy("_image", "_plane", "_band")).applyInArrow(resample, "image_id long, row int, col int, plane int, value double")
