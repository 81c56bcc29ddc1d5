"""From container to picture: the stages of camera-raw processing.

Files whose plan is the same - sizes, black levels, corrections, curves, tables - make a group, and each group gets its
plan. What differs from shot to shot - white balance, colour matrix, exposure, how warm the light is - is worked out on
the executors and joined to the pixels as numbers, so a camera's pictures are one plan, however many there are. Samples
never come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelith import reachable, small_methods
from pixelith.functions import colour
from pixelith.functions import pixels as P
from pixelith.operators import raster as R
from pixelith.operators import tone
from pixelith.plans import opcodes as O
from pixelith.sources import metadata, tiff

#: Photometric codes that can be developed (fixed values).
CFA, LINEAR, RGB = 32803, 34892, 2
#: Colour temperatures of light sources (fixed values); others: 5000.
KELVIN = {0: 5000, 1: 5500, 2: 4000, 3: 2850, 10: 5500, 17: 2856, 18: 5503, 19: 6774, 20: 5503, 21: 6504, 22: 7504, 23: 5003, 24: 3200}
#: The largest sample of a mask by its type, and how much less is opaque all the same (fixed values).
MASKS = {"u1": (255.0, 0.5), "u2": (65535.0, 0.5), "f4": (1.0, 1e-6)}
#: Files whose numbers are broadcast, 100 bytes each; for more Spark picks the join.
BROADCAST_FILES = 50_000


class NotYet(ValueError):
    """What a file asks for is not supported."""


class Unsupported(ValueError):
    """A file needs a newer reader."""


@dataclass(frozen=True)
class Meta:
    """What the plan needs of a main image."""

    height: int
    width: int
    planes: int
    is_float: bool
    photometric: int
    linear: dict
    mosaic: dict | None
    active: tuple[int, int, int, int]
    crop: tuple[int, int, int, int] | None
    orientation: int
    opcodes: dict[int, bytes] = field(default_factory=dict)
    profile: dict = field(default_factory=dict)
    mask: tuple[int, int, str] | None = None

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        return 0, 0, self.height, self.width


def read_meta(data: bytes, reader: tuple[int, int, int, int] = tiff.READER) -> Meta:
    c = tiff.parse(data)
    o, first = c.order, c.ifds[0]
    needs = first.find(tiff.OLDEST_READER)
    if needs is not None and tuple(needs.payload[:4]) > tuple(reader):
        raise Unsupported(f"needs a reader of version {'.'.join(map(str, needs.payload[:4]))}")
    roles = tiff.roles(c)
    if "main" not in roles:
        raise tiff.FormatError("no main image")
    ifd = c.ifds[roles["main"][0]]
    shape, _ = tiff.layout(data, c, ifd)
    is_float = shape.kind[0] == "f"
    active = metadata.active_area(ifd, o) or (0, 0, shape.height, shape.width)
    lists = {n: ifd.find(metadata.T[f"opcodes_{n}"]) for n in (1, 2, 3)}
    mask = tiff.layout(data, c, c.ifds[roles["mask"][0]])[0] if "mask" in roles else None
    return Meta(
        shape.height, shape.width, shape.planes, is_float, ifd.scalar(262, o, 1), metadata.linearization(ifd, o, is_float), metadata.mosaic(ifd, o), active,
        metadata.default_crop(ifd, o, active), first.number(274, o, 1), {n: e.payload for n, e in lists.items() if e is not None and len(e.payload) > 4}, metadata.profile(first, o),
        (mask.height, mask.width, mask.kind) if mask else None,
    )


def stage_1(files: DataFrame, meta: Meta, on_error: str = "raise") -> tuple[DataFrame, tuple[int, int, int, int]]:
    """Samples as stored, fields put in order, the first list applied."""
    px = tiff.samples(files, on_error=on_error)
    if meta.mosaic and (meta.mosaic["rows"] > 1 or meta.mosaic["cols"] > 1):
        if meta.height % meta.mosaic["rows"] or meta.width % meta.mosaic["cols"]:
            raise tiff.FormatError("size is no multiple of the interleave")
        px = R.deinterleave(px, meta.mosaic["rows"], meta.mosaic["cols"], meta.height, meta.width)
    bounds = meta.bounds
    if 1 in meta.opcodes:
        px, bounds = O.apply(px, O.parse(meta.opcodes[1]), bounds, 1)
    return px, bounds


def linear_value(meta: Meta) -> Column:
    """Stage 2 of a sample: an expression of value, row, col and plane."""
    lin = meta.linear
    black, white = lin["black"], lin["white"]
    rows, cols = lin["dims"]
    delta = None
    for name, at in (("delta_v", "row"), ("delta_h", "col")):
        if lin[name]:
            step = F.coalesce(P.table_step(F.col(at), 0, 1, lin[name]), F.lit(0.0))
            delta = step if delta is None else delta + step
    repeat = rows > 1 or cols > 1
    out = None
    for p in range(meta.planes):
        floor = min(black) if repeat else black[min(p, len(black) - 1)]
        level = P.black_cell(F.col("row"), F.col("col"), black, rows, cols) if repeat else floor
        one = P.linearize(F.col("value"), black=level, white=white[min(p, len(white) - 1)], least_black=floor, lut=lin["lut"], delta=delta)
        out = F.when(F.col("plane") == p, one) if out is None else out.when(F.col("plane") == p, one)
    return out


def stage_2(px: DataFrame, meta: Meta, bounds: tuple[int, int, int, int]) -> tuple[DataFrame, tuple[int, int, int, int]]:
    px = px.withColumn("value", linear_value(meta))
    return O.apply(px, O.parse(meta.opcodes[2]), bounds, 2) if 2 in meta.opcodes else (px, bounds)


def stage_3(px: DataFrame, meta: Meta, bounds: tuple[int, int, int, int]) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """Three planes, and the third list."""
    if meta.photometric == CFA and meta.mosaic:
        if tuple(meta.mosaic["dims"]) != (2, 2):
            raise NotYet("a mosaic other than 2 x 2")
        wide = R.demosaic(R.to_scanlines(px), meta.mosaic["pattern"])
        px = wide.select("image_id", "row", "col", F.posexplode(F.array("r", "g", "b")).alias("plane", "value"))
    elif meta.photometric not in (LINEAR, RGB):
        raise NotYet(f"photometric {meta.photometric}")
    return O.apply(px, O.parse(meta.opcodes[3]), bounds, 3) if 3 in meta.opcodes else (px, bounds)


def calibrated(profile: dict) -> tuple[list[float], dict[str, list]]:
    """The temperatures of the calibrations, and of each kind the 3 x 3 matrices and the hue tables, None where one has none."""
    sides = profile.get("calibrations") or []
    tables = {n: [np.reshape(s[n], (3, 3)) if len(s[n]) == 9 else None for s in sides] for n in ("color", "forward", "calibration")}
    return [float(KELVIN.get(s["illuminant"], 5000)) for s in sides], tables


def shot_kelvin(profile: dict) -> float:
    """The temperature of the light: that of the white that the file tells, or what its neutral settles at; else 6500 K."""
    if profile.get("white_xy"):
        return colour.to_temperature(tuple(profile["white_xy"]))[0]
    temperatures, tables = calibrated(profile)
    if not temperatures or not profile.get("neutral"):
        return 6500.0
    try:
        return colour.settle_temperature(profile["neutral"], lambda kelvin: colour.camera_to_xyz(kelvin, temperatures, tables["color"], tables["forward"]))
    except ValueError:  # a singular matrix, or not three numbers
        return 6500.0


def camera_matrix(profile: dict) -> np.ndarray:
    """Camera to XYZ under D50: at the light's temperature, its neutral made even, its calibration undone. Without
    calibrations the camera's numbers count as XYZ. A file that tells a white has the neutral that the white gives."""
    temperatures, tables = calibrated(profile)
    if not temperatures:
        return np.eye(3)
    kelvin = shot_kelvin(profile)
    to_xyz = colour.camera_to_xyz(kelvin, temperatures, tables["color"], tables["forward"])
    neutral = profile.get("neutral") or None
    if neutral is None and profile.get("white_xy"):
        neutral = colour.neutral_of_white(to_xyz, tuple(profile["white_xy"]))
    if neutral is None or len(neutral) < 3 or min(neutral[:3]) <= 0:
        return to_xyz
    nearest = tables["calibration"][colour.bracket(kelvin, temperatures)[0]]
    return colour.white_balanced(to_xyz, neutral[:3], nearest, profile["balance"][:3] if len(profile["balance"]) >= 3 else None)


def hue_tables(profile: dict) -> list[list[tuple[float, float, float]]]:
    """The hue tables of the profile, one or two, as (hue, saturation, value) entries; none without proper dimensions."""
    dims = profile.get("hue_dims") or []
    sides = profile.get("calibrations") or []
    n = 3 * math.prod(dims) if len(dims) >= 2 else 0
    return [[tuple(s["hue"][i : i + 3]) for i in range(0, n, 3)] for s in sides if n and len(s["hue"]) == n]


def hue_weight(profile: dict) -> float:
    """How much of the first of two hue tables the light asks for."""
    temperatures, _ = calibrated(profile)
    if len(temperatures) < 2:
        return 1.0
    kelvin = shot_kelvin(profile)
    a, b = colour.bracket(kelvin, temperatures)
    w = colour.lower_weight(kelvin, temperatures[a], temperatures[b])
    return w if a == 0 else 1.0 - w if b == 0 else 0.0


def plan_of(meta: Meta) -> Meta:
    """What the plan needs: the metadata without the numbers of the shot."""
    p = meta.profile
    return replace(meta, orientation=1, profile={"curve": p.get("curve"), "hue_dims": p.get("hue_dims"), "hue": hue_tables(p)})


SHOTS = "file_id long, plan string, matrix array<double>, gain double, weight double, orientation int, kind string, error string"
UNSUPPORTED, BAD, MATRIX = "unsupported", "bad format", "matrix"


def settings(files: DataFrame) -> DataFrame:
    """Per file: a digest of all that its plan needs, read from the whole container, and the numbers of the shot: camera to
    XYZ (9, by row), 2 ** exposure, the weight of the first hue table, the orientation. A file that can't be read has its
    error, and the kind of it, instead."""

    def one(content) -> tuple:
        try:
            meta = read_meta(bytes(content or b""))
            matrix = [float(x) for x in camera_matrix(meta.profile).reshape(-1)]
            return hashlib.md5(repr(plan_of(meta)).encode()).hexdigest(), matrix, 2.0 ** meta.profile.get("exposure", 0.0), hue_weight(meta.profile), meta.orientation, None, None
        except Unsupported as e:
            return None, None, None, None, None, UNSUPPORTED, str(e)
        except tiff.BROKEN as e:
            return None, None, None, None, None, BAD, str(e)
        except ValueError as e:
            return None, None, None, None, None, MATRIX, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SHOTS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(i, *one(c)) for i, c in zip(b["file_id"], b["content"], strict=True)], columns=names).astype({"orientation": "Int32"})

    return files.select("file_id", "content").mapInPandas(run, SHOTS)


def masked(wide: DataFrame, mask: DataFrame, most: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Both cut to the rectangle of the mask that is wholly opaque; a picture whose mask has none stays as it is."""
    rects = R.opaque_rect(mask, most, tolerance)

    def cut(df: DataFrame) -> DataFrame:
        inside = F.col("top").isNull() | (F.col("row").between(F.col("top"), F.col("bottom") - 1) & F.col("col").between(F.col("left"), F.col("right") - 1))
        moved = {"row": (F.col("row") - F.coalesce("top", F.lit(0))).cast("int"), "col": (F.col("col") - F.coalesce("left", F.lit(0))).cast("int")}
        return df.join(rects, "image_id", "left").where(inside).withColumns(moved).drop("top", "left", "bottom", "right")

    return cut(wide), cut(mask)


def picture(px: DataFrame, meta: Meta, bounds: tuple[int, int, int, int], shots: DataFrame, *, mask: DataFrame | None = None, space: str = "srgb", hdr: bool = False) -> DataFrame:
    """image_id, row, col, r, g, b: 8 bits, or linear numbers with hdr. Cropped to the default crop, else the active area, and
    to what a mask leaves; the mask's soft edge goes to white. shots: image_id, matrix, gain and weight of each picture.

    Hue tables work in linear ProPhoto, before exposure and curve.
    """
    area = meta.crop or meta.active
    moved = area != bounds and bounds == meta.bounds
    if moved:
        px = R.crop(px, *area)
    wide = R.to_wide(px)
    alpha = None
    shape = (area[2] - area[0], area[3] - area[1]) if moved else (bounds[2] - bounds[0], bounds[3] - bounds[1])
    if mask is not None and meta.mask and meta.mask[2] in MASKS:
        if moved and meta.mask[:2] == (meta.height, meta.width):
            mask = R.crop(mask, *area)
        if (meta.mask[:2] == (meta.height, meta.width) and moved) or meta.mask[:2] == shape:
            wide, alpha = masked(wide, mask.where("plane = 0"), *MASKS[meta.mask[2]])
    known = ["image_id", "row", "col", "gain", "weight"]
    wide = wide.join(shots, "image_id")
    p = meta.profile
    tables = p["hue"]

    def by(m, scale: Column | None = None) -> list[Column]:
        """The columns r, g, b through a matrix of numbers or columns."""
        sums = [m[i][0] * F.col("r") + m[i][1] * F.col("g") + m[i][2] * F.col("b") for i in range(3)]
        return [(x if scale is None else x * scale).alias(n) for x, n in zip(sums, "rgb", strict=True)]

    def camera_to(m) -> list[list[Column]]:
        """A matrix of numbers after each picture's own."""
        own = [[F.col("matrix")[3 * i + j] for j in range(3)] for i in range(3)]
        return [[sum((P.num(m[i][k]) * own[k][j] for k in range(1, 3)), P.num(m[i][0]) * own[0][j]) for j in range(3)] for i in range(3)]

    if tables:
        wide = wide.select(*known, *by(camera_to(colour.to_output("prophoto"))))
        dims = p["hue_dims"]
        wide = tone.hue_sat(wide, tables[0], (dims[0], dims[1], dims[2] if len(dims) > 2 else 1), *((tables[1], F.col("weight")) if len(tables) > 1 else ()))
        back = colour.to_output(space) @ colour.invert(colour.to_output("prophoto"))
        wide = wide.select("image_id", "row", "col", *by([[P.num(x) for x in line] for line in back], F.col("gain")))
    else:
        wide = wide.select("image_id", "row", "col", *by(camera_to(colour.to_output(space)), F.col("gain")))
    if p.get("curve"):
        wide = wide.select("image_id", "row", "col", *[P.tone_curve(F.col(c), p["curve"]).alias(c) for c in "rgb"])
    if hdr:
        return wide
    mapped = P.tone_map([F.col(c) for c in "rgb"])
    wide = wide.select("image_id", "row", "col", *[c.alias(n) for c, n in zip(mapped, "rgb", strict=True)])
    wide = wide.select("image_id", "row", "col", *[P.quantize(F.col(c)).alias(c) for c in "rgb"])
    if alpha is None:
        return wide
    both = wide.join(alpha.select("image_id", "row", "col", F.col("value").alias("_alpha")), ["image_id", "row", "col"], "left")
    most = MASKS[meta.mask[2]][0]
    return both.select("image_id", "row", "col", *[P.on_white(F.col(c), F.coalesce("_alpha", F.lit(most)), most).alias(c) for c in "rgb"])


#: What kept() has cached last.
_KEPT: list[DataFrame] = []


def kept(known: DataFrame) -> DataFrame:
    """known, cached: some numbers for each file, read once for the groups, and by each group's plan. Spark takes readings of
    one folder at different times for the same, so a mark tells them apart; the cache of the call before is given up, and
    what still needs it reads its files again."""
    for old in _KEPT:
        old.unpersist()
    _KEPT[:] = [known.withColumn("_read", F.lit(uuid.uuid4().hex)).persist()]
    return _KEPT[0]


def develop(files: DataFrame, stage: int | None = None, *, on_error: str = "raise", **options) -> DataFrame:
    """The samples after a stage (1 to 3), or the picture, of (file_id, content).

    Files whose metadata is equal in all that the plan needs make one group, wherever in the file it lies, and each
    group gets its own plan; all groups are one union. The driver gets one row for each group, as many as there are
    kinds of camera settings. on_error: raise, or skip the files that can't be read (settings() has their errors).
    """
    reachable(files.sparkSession)
    small_methods(files.sparkSession)
    known = kept(settings(files))
    if on_error == "raise":
        wrong = known.where("error is not null").orderBy("file_id").select("kind", "error").first()
        if wrong:
            raise {UNSUPPORTED: Unsupported, BAD: tiff.FormatError}.get(wrong.kind, ValueError)(wrong.error)
    out = None
    for row in known.where("error is null").groupBy("plan").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n")).collect():
        sample = files.where(F.col("file_id") == row.file_id).select("content").first()
        meta = plan_of(read_meta(bytes(sample.content)))
        own = known.where(F.col("plan") == row.plan)
        some = files.join(own.select(F.col("file_id").alias("_id")), F.col("file_id").eqNullSafe(F.col("_id")), "left_semi")
        px, bounds = stage_1(some, meta, on_error)
        if stage is None or stage > 1:
            px, bounds = stage_2(px, meta, bounds)
        if stage is None or stage > 2:
            px, bounds = stage_3(px, meta, bounds)
        if stage is None:
            shots = own.select(F.col("file_id").alias("image_id"), "matrix", "gain", "weight")
            shots = F.broadcast(shots) if row.n <= BROADCAST_FILES else shots
            mask = tiff.samples(some, "mask", on_error) if meta.mask else None
            px = picture(px, meta, bounds, shots, mask=mask, **options)
        out = px if out is None else out.unionByName(px)
    if out is None:
        raise ValueError("no files")
    return out


def orientations(files: DataFrame) -> DataFrame:
    """image_id and the orientation code of each file, for tiff.build()."""
    return settings(files).where("error is null").select(F.col("file_id").alias("image_id"), "orientation")
