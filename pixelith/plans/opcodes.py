"""Correction lists: parsing and folding over a raster. The plan builder drops what changes nothing."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith.functions import pixels as P
from pixelith.operators import raster as R
from pixelith.operators import warp as W
from pixelith.sources import metadata, tiff

#: Identifiers of the corrections (fixed values of the public format).
IDS = {1: "warp_rectilinear", 2: "warp_fisheye", 3: "vignette", 4: "bad_constant", 5: "bad_list", 6: "trim", 7: "map_table", 8: "polynomial", 9: "gain_map", 10: "delta_row", 11: "delta_col", 12: "scale_row", 13: "scale_col", 14: "warp_rectilinear2"}
#: What each of the three lists may hold; anything else is passed over.
LISTS = {1: {4, 5, 6, 7}, 2: {3, 6, 8, 9, 10, 11, 12, 13}, 3: {1, 2, 3, 6, 8, 9, 10, 11, 12, 13, 14}}


class OpcodeError(ValueError):
    pass


@dataclass(frozen=True)
class Opcode:
    id: int
    version: tuple[int, int, int, int]
    flags: int
    body: bytes


def parse(data: bytes) -> list[Opcode]:
    """The entries of a list, always big-endian; its length must fit exactly."""
    if len(data) < 4:
        raise OpcodeError("cut list")
    count, at, out = struct.unpack_from(">I", data)[0], 4, []
    if count > 1_000_000:
        raise OpcodeError("too many entries")
    for _ in range(count):
        if at + 16 > len(data):
            raise OpcodeError("cut list")
        number, version, flags, size = struct.unpack_from(">I4sII", data, at)
        at += 16
        if at + size > len(data):
            raise OpcodeError("cut body")
        out.append(Opcode(number, tuple(version), flags, data[at : at + size]))
        at += size
    if at != len(data):
        raise OpcodeError("bytes after the list")
    return out


def pack(opcodes: list[tuple[int, bytes]]) -> bytes:
    return struct.pack(">I", len(opcodes)) + b"".join(struct.pack(">I4sII", n, bytes([1, 3, 0, 0]), 0, len(b)) + b for n, b in opcodes)


def entries(files: DataFrame) -> DataFrame:
    """file_id, list, ord, id, version, flags, size, error: the corrections in the three lists of each file's main image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for file_id, content in zip(b["file_id"], b["content"], strict=True):
                try:
                    c = tiff.parse(bytes(content or b""))
                    ifd = c.ifds[tiff.roles(c)["main"][0]]
                    for n in (1, 2, 3):
                        e = ifd.find(metadata.T[f"opcodes_{n}"])
                        if e is not None and len(e.payload) > 4:
                            rows += [(file_id, n, k, op.id, op.version[0] * 1000 + op.version[1] * 100 + op.version[2] * 10 + op.version[3], op.flags, len(op.body), None) for k, op in enumerate(parse(e.payload))]
                except (*tiff.BROKEN, OpcodeError, KeyError) as e:
                    rows.append((file_id, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file_id", "list", "ord", "id", "version", "flags", "size", "error"]).astype({n: "Int64" for n in ("list", "ord", "id", "version", "flags", "size")})

    return files.select("file_id", "content").mapInPandas(run, "file_id long, list int, ord int, id int, version int, flags long, size long, error string")


def area_of(body: bytes) -> dict:
    t, l, b, r, plane, planes, rp, cp = struct.unpack_from(">4i4I", body)
    if not rp or not cp or not planes:
        raise OpcodeError("area without planes or pitch")
    return {"rect": (t, l, b, r), "planes": (plane, planes), "pitch": (rp, cp)}


def reals(body: bytes, at: int, n: int, code: str = "d") -> list[float]:
    try:
        out = list(struct.unpack_from(f">{n}{code}", body, at))
    except struct.error:
        raise OpcodeError("cut body") from None
    if any(x != x or x in (float("inf"), -float("inf")) for x in out):
        raise OpcodeError("not a number")
    return out


def warp_of(op: Opcode) -> dict[int, W.Rectilinear]:
    """Parameters by plane; planes that the list doesn't have use the first one's."""
    planes = struct.unpack_from(">I", op.body)[0]
    if not 1 <= planes <= 4:
        raise OpcodeError("planes")
    size = {1: 6, 2: 4, 14: 19}[op.id]
    center = tuple(reals(op.body, 4 + planes * size * 8, 2))
    out = {}
    for p in range(planes):
        v = reals(op.body, 4 + p * size * 8, size)
        if op.id == 1:
            out[p] = W.Rectilinear(v[:4], tuple(v[4:6]), center)
        elif op.id == 2:
            out[p] = W.Fisheye(v, (0.0, 0.0), center)
        else:
            out[p] = W.Rectilinear2(v[:15], tuple(v[15:17]), center, tuple(v[17:19]), struct.unpack_from(">I", op.body, 20 + planes * size * 8)[0] != 0)
    return out


def apply(pixels: DataFrame, opcodes: list[Opcode], bounds: tuple[int, int, int, int], which: int) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """The raster after a list, and its bounds. Consecutive corrections of single samples become one projection."""
    for op in opcodes:
        if op.id not in LISTS[which]:
            continue
        row, col, plane, value, body = F.col("row"), F.col("col"), F.col("plane"), F.col("value"), op.body
        if op.id == 6:
            rect = struct.unpack(">4i", body[:16])
            pixels = R.trim_bounds(pixels, rect, bounds)
            bounds = (0, 0, rect[2] - rect[0], rect[3] - rect[1])
        elif op.id == 4:
            constant, phase = struct.unpack_from(">II", body)
            pixels = R.fix_constant(pixels, constant & 0xFFFF, phase)
        elif op.id == 5:
            phase, n, m = struct.unpack_from(">III", body)
            points = [struct.unpack_from(">2i", body, 12 + 8 * i) for i in range(n)]
            rects = [struct.unpack_from(">4i", body, 12 + 8 * n + 16 * i) for i in range(m)]
            pixels = R.fix_list(pixels, points, rects, phase)
        elif op.id in (1, 2, 14):
            by_plane = warp_of(op)
            pixels = W.warp(pixels, bounds, by_plane[0], {p: w for p, w in by_plane.items() if p})
        elif op.id == 3:
            k = reals(body, 0, 7)
            pixels = pixels.withColumn("value", P.vignette(value, row, col, bounds, (k[5], k[6]), k[:5]))
        else:
            spec = area_of(body)
            inside = R.area(bounds, spec["rect"], spec["planes"], spec["pitch"])
            if op.id == 7:
                n = struct.unpack_from(">I", body, 32)[0]
                if not 1 <= n <= 65536:
                    raise OpcodeError("table size")
                new = P.map_table(value, struct.unpack_from(f">{n}H", body, 36)).cast("double")
            elif op.id == 8:
                degree = struct.unpack_from(">I", body, 32)[0]
                if degree > 8:
                    raise OpcodeError("degree")
                new = P.polynomial(value, reals(body, 36, degree + 1))
            elif op.id == 9:
                nv, nh, sv, sh, ov, oh, planes = struct.unpack_from(">2I4dI", body, 32)
                if not (nv and nh and planes) or sv <= 0 or sh <= 0:
                    raise OpcodeError("grid")
                new = P.gain_map(value, row, col, plane, bounds, reals(body, 76, nv * nh * planes, "f"), (nv, nh, planes), (ov, oh), (sv, sh))
            else:
                values = reals(body, 36, struct.unpack_from(">I", body, 32)[0], "f")
                rect = spec["rect"] if spec["rect"][0] < spec["rect"][2] else bounds
                at, start, pitch = (row, rect[0], spec["pitch"][0]) if op.id in (10, 12) else (col, rect[1], spec["pitch"][1])
                step = P.table_step(at, start, pitch, values)
                new = F.when(step.isNull(), value).otherwise(P.clamp(value + step if op.id in (10, 11) else value * step, -1, 1))
            pixels = pixels.withColumn("value", F.when(inside, new).otherwise(value))
    return pixels, bounds
