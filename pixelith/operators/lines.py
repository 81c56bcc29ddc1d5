"""The stages on scanlines: a row holds a line of samples as an array of 32-bit floats, and numpy works on whole batches.

For photographs of many megapixels this form has a row a line instead of a row a sample. Planar: image_id, row, plane,
vals. Wide: image_id, row, r, g, b, each an array. The formulas are those of functions.pixels; numbers are 32-bit, so
their last bits differ from the 64-bit ones there. Maps need no shuffle; the stencil has one, by band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith import reachable
from pixelith.functions.pixels import LUMA, SHADOW_LIFT, TOE
from pixelith.operators.raster import with_band

#: Bytes of a batch that goes to a Python worker.
BATCH = 8 << 20
LINE = pa.list_(pa.float32())
KINDS = {"float": LINE, "int": pa.list_(pa.int32())}


def limits(df: DataFrame) -> None:
    spark = df.sparkSession
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lines, one after the other, and where each line ends. Nulls are not expected."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return values, ends - ends[0]


def as_lines(values: np.ndarray, ends: np.ndarray, kind: pa.DataType = LINE) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind.value_type))


def mapped(df: DataFrame, columns: Sequence[str], f: Callable[..., Sequence[np.ndarray]], element: str = "float") -> DataFrame:
    """The lines of `columns` through f, which takes and gives the numbers of a batch; with_places(f) also gets row and col."""
    limits(df)
    schema = df.schema
    for i, field in enumerate(schema.fields):
        if field.name in columns:
            schema.fields[i] = df.select(F.col(field.name).cast(f"array<{element}>")).schema[0]
    kind = KINDS[element]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [flat(batch.column(c).cast(LINE)) for c in columns]
            ends = lines[0][1]
            places = ()
            if getattr(f, "places", False):
                sizes = np.diff(ends)
                row = np.repeat(batch.column("row").to_numpy(), sizes)
                places = (row, np.arange(ends[-1]) - np.repeat(ends[:-1], sizes))
            out = f(*[values for values, _ in lines], *places)
            new = dict(zip(columns, (as_lines(v, ends, kind) for v in out), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def with_places(f: Callable[..., Sequence[np.ndarray]]) -> Callable[..., Sequence[np.ndarray]]:
    f.places = True
    return f


Kernel = Callable[..., Sequence[np.ndarray]]


def fused(*kernels: Kernel) -> Kernel:
    """One kernel after the other, on arrays that stay in the worker."""

    def run(*arrays: np.ndarray) -> Sequence[np.ndarray]:
        for k in kernels:
            arrays = k(*arrays)
        return arrays

    return run


def linear_kernel(black: float, white: float) -> Kernel:
    if white <= black:
        raise ValueError("white level is not above black level")
    scale = np.float32(1.0 / (white - black))
    return lambda v: [np.minimum((v - np.float32(black)) * scale, np.float32(1))]


def linearize(lines: DataFrame, *, black: float, white: float) -> DataFrame:
    """(sample - black) / (white - black), no more than 1."""
    return mapped(lines, ["vals"], linear_kernel(black, white))


def polynomial(lines: DataFrame, coefficients: Sequence[float]) -> DataFrame:
    """c0 + x * (c1 + |x| * (c2 + ...)), held in [-1, 1]."""
    c = [np.float32(x) for x in coefficients]

    def run(v: np.ndarray) -> list[np.ndarray]:
        size, total = np.abs(v), np.full_like(v, c[-1] if len(c) > 1 else 0)
        for k in reversed(c[1:-1]):
            total = k + size * total
        return [np.clip(c[0] + v * total, -1, 1)]

    return mapped(lines, ["vals"], run)


def vignette(lines: DataFrame, bounds: tuple[int, int, int, int], center: tuple[float, float], k: Sequence[float]) -> DataFrame:
    """x times 1 + k0 r^2 + ... + k4 r^10, no more than 1; center: (horizontal, vertical) fractions of the bounds."""
    if not any(k):
        return lines
    top, left, bottom, right = bounds
    cr, cc = top + center[1] * (bottom - top), left + center[0] * (right - left)
    reach = max(abs(cr - top), abs(cr - bottom)) ** 2 + max(abs(cc - left), abs(cc - right)) ** 2

    @with_places
    def run(v: np.ndarray, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        dv, dh = (row + np.float32(0.5 - cr)).astype(np.float32), (col + np.float32(0.5 - cc)).astype(np.float32)
        r2 = np.minimum((dv * dv + dh * dh) * np.float32(1 / reach), np.float32(1))
        total = np.zeros_like(r2)
        for c in reversed(list(k)):
            total = r2 * (np.float32(c) + total)
        return [np.minimum(v * (total + np.float32(1)), np.float32(1))]

    return mapped(lines, ["vals"], run)


def matrix_kernel(m: Sequence[Sequence[float]], exposure: float = 0.0) -> Kernel:
    w = (np.array(m) * 2.0**exposure).astype(np.float32)
    return lambda r, g, b: [x[0] * r + x[1] * g + x[2] * b for x in w]


def matrix(wide: DataFrame, m: Sequence[Sequence[float]], exposure: float = 0.0) -> DataFrame:
    """The 3 x 3 product, times 2 ** exposure."""
    return mapped(wide, ["r", "g", "b"], matrix_kernel(m, exposure))


def curve_kernel(knots: Sequence[tuple[float, float]]) -> Kernel:
    x, y = (np.array(v) for v in zip(*knots, strict=True))
    return lambda *rgb: [np.interp(v, x, y).astype(np.float32) for v in rgb]


def tone_curve(wide: DataFrame, knots: Sequence[tuple[float, float]]) -> DataFrame:
    """Linear between the knots, constant outside."""
    return mapped(wide, ["r", "g", "b"], curve_kernel(knots))


def hue_kernel(deltas: Sequence[tuple[float, float, float]], divisions: tuple[int, int, int]) -> Kernel:
    nh, ns, nv = divisions
    table = np.array(deltas, np.float32)

    def place(x: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The lower cell of each position, and how far it is on the way to the next."""
        low = np.clip(np.floor(x), 0, last).astype(np.int32)
        return low, (x - low).astype(np.float32)

    def run(*rgb: np.ndarray) -> list[np.ndarray]:
        r, g, b = (np.maximum(v, np.float32(0)) for v in rgb)
        value = np.maximum(np.maximum(r, g), b)
        gap = value - np.minimum(np.minimum(r, g), b)
        grey = gap <= 0
        over = np.where(grey, np.float32(1), gap)
        red = (g - b) / over
        hue = np.where(r == value, np.where(red < 0, red + 6, red), np.where(g == value, 2 + (b - r) / over, 4 + (r - g) / over))
        hue = np.where(grey, np.float32(0), hue).astype(np.float32)
        sat = np.where(grey, np.float32(0), gap / np.where(grey, np.float32(1), value))
        (h0, fh), (s0, fs) = place(hue * np.float32(0 if nh < 2 else nh / 6), nh - 1), place(sat * np.float32(ns - 1), max(0, ns - 2))
        h1, s1 = np.where(h0 >= nh - 1, 0, h0 + 1), np.minimum(s0 + 1, ns - 1)
        planes = [(0, None)]
        if nv >= 2:
            v0, fv = place(value * np.float32(nv - 1), nv - 2)
            planes = [(v0, 1 - fv), (np.minimum(v0 + 1, nv - 1), fv)]
        total = np.zeros((len(value), 3), np.float32)
        for v, wv in planes:
            for h, wh in ((h0, 1 - fh), (h1, fh)):
                for s, ws in ((s0, 1 - fs), (s1, fs)):
                    weight = wh * ws if wv is None else wv * wh * ws
                    total += weight[:, None] * table[(v * nh + h) * ns + s]
        hue = (hue + total[:, 0] * np.float32(6 / 360)) % np.float32(6)
        sat, value = np.minimum(sat * total[:, 1], np.float32(1)), np.maximum(value * total[:, 2], np.float32(0))
        # each channel of a hue is the value, less so much as it lies off the channel's own third of the circle
        out = []
        for k in (5, 3, 1):
            off = (hue + k) % 6
            out.append(value * (1 - sat * np.clip(np.minimum(off, 4 - off), 0, 1)))
        return out

    return run


def hue_sat(wide: DataFrame, deltas: Sequence[tuple[float, float, float]], divisions: tuple[int, int, int]) -> DataFrame:
    """Shifts hue and scales saturation and value by a table, as functions.pixels.hue_sat_map() does."""
    return mapped(wide, ["r", "g", "b"], hue_kernel(deltas, divisions))


def tone_kernel(*rgb: np.ndarray) -> Sequence[np.ndarray]:
    lift, toe = np.float32(SHADOW_LIFT), np.float32(TOE)
    y = sum(np.float32(w) * v for w, v in zip(LUMA, rgb, strict=True))
    safe = np.where(y > 0, y, np.float32(1))
    new = np.where(y > 0, lift + (1 - lift) / (1 + toe / (safe * safe)), lift)
    dark = y <= 1e-8
    scale = new / np.where(dark, np.float32(1), y)
    return [np.where(dark, new, np.maximum(v * scale, np.float32(0))) for v in rgb]


def tone_map(wide: DataFrame) -> DataFrame:
    """The default curve on luminance; each channel follows, not below 0."""
    return mapped(wide, ["r", "g", "b"], tone_kernel)


def code_kernel(steps: int = 1 << 14) -> Kernel:
    """0 to 255 from linear numbers: where each code begins is known before gamma, and the code rises with the sample, so a
    table finds it, but for a step in which the next code begins."""
    g = (np.arange(1, 256) - 0.5) / 255
    starts = np.where(g <= 0.0031308 * 12.92, g / 12.92, ((g + 0.055) / 1.055) ** 2.4)
    low = np.searchsorted(starts, np.arange(steps + 1) / steps, "right").astype(np.int32)
    after = np.concatenate([starts, [np.inf]])

    def run(*rgb: np.ndarray) -> list[np.ndarray]:
        out = []
        for v in rgb:
            x = np.clip(v, np.float32(0), np.float32(1))
            code = low[(x * np.float32(steps)).astype(np.int32)]
            out.append(code + (x >= after[code]))
        return out

    return run


def quantize(wide: DataFrame) -> DataFrame:
    """0 to 255 from gamma-coded [0, 1]."""
    return mapped(wide, ["r", "g", "b"], code_kernel(), "int")


def render(lines: DataFrame, *, black: float, white: float, m: Sequence[Sequence[float]], exposure: float = 0.0, knots: Sequence[tuple[float, float]] | None = None, pattern: Sequence[int] = (0, 1, 1, 2)) -> DataFrame:
    """Mosaic to 8 bits in one pass over bands: linearize, demosaic, matrix, curve, tone map, codes; image_id, row, r, g, b."""
    after = [matrix_kernel(m, exposure), *([curve_kernel(knots)] if knots else []), tone_kernel, code_kernel()]
    return demosaic(lines, pattern, before=linear_kernel(black, white), after=fused(*after), element="int")


def demosaic(lines: DataFrame, pattern: Sequence[int] = (0, 1, 1, 2), *, before: Kernel | None = None, after: Kernel | None = None, element: str = "float") -> DataFrame:
    """raster.demosaic() on scanlines: image_id, row, r, g, b. A band of rows with a halo of one is a task's group; beyond an
    edge the image goes on with period 2. Lines of one image have one length. before and after: kernels on the samples and
    on the three planes, run in the same pass."""
    if len(pattern) != 4:
        raise ValueError("a pattern has 2 x 2 colours")
    limits(lines)
    kind = KINDS[element]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        rows, own = group.column("row").to_numpy(), group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        values, _ = flat(group.column("vals"))
        if before is not None:
            values = before(values)[0]
        image = values.reshape(len(rows), -1)
        kept = np.flatnonzero(own)
        if not len(kept):
            empty = pa.array([], kind)
            return pa.table({"image_id": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), "r": empty, "g": empty, "b": empty})
        up, down = kept - 1, kept + 1
        up = np.where(kept == 0, np.minimum(kept + 1, len(rows) - 1), up)
        down = np.where(kept == len(rows) - 1, np.maximum(kept - 1, 0), down)
        width = image.shape[1]
        padded = np.empty((len(rows), width + 2), np.float32)
        padded[:, 1:-1] = image
        padded[:, 0], padded[:, -1] = image[:, min(1, width - 1)], image[:, max(width - 2, 0)]
        around = {-1: padded[up], 0: padded[kept], 1: padded[down]}
        out = [np.empty((len(kept), width), np.float32) for _ in range(3)]
        for odd in (0, 1):
            some = np.flatnonzero(rows[kept] % 2 == odd)
            for col in (0, 1):
                for wanted in range(3):
                    if pattern[odd * 2 + col] == wanted:
                        out[wanted][some, col::2] = around[0][some, 1 + col : 1 + width : 2]
                        continue
                    total, weight = 0, 0.0
                    for dr in (-1, 0, 1):
                        for dc in (-1, 0, 1):
                            if (dr or dc) and pattern[((odd + dr) % 2) * 2 + (col + dc) % 2] == wanted:
                                w = 0.25 if dr and dc else 0.5
                                total = total + np.float32(w) * around[dr][some, 1 + col + dc : 1 + width + dc : 2]
                                weight += w
                    out[wanted][some, col::2] = total / np.float32(weight) if weight else 0
        at = np.arange(len(kept) + 1) * width
        planes = [v.reshape(-1) for v in out] if after is None else after(*[v.reshape(-1) for v in out])
        return pa.table({"image_id": pa.array(np.full(len(kept), key[0].as_py()), pa.int64()), "row": pa.array(rows[kept], pa.int32()), **{n: as_lines(v, at, kind) for n, v in zip("rgb", planes, strict=True)}})

    banded = with_band(lines.select("image_id", "row", F.col("vals").cast("array<float>").alias("vals")), 1)
    return banded.groupBy("image_id", "band").applyInArrow(run, f"image_id long, row int, r array<{element}>, g array<{element}>, b array<{element}>")
