"""TIFF containers of camera raw images: parsing, tag entries, roles, strips and tiles, writing.

Files come as rows (file_id, content) - spark.read.format('binaryFile') - and leave as entry rows, scanlines or sample
rows. A file is parsed by one task, many files share one, and each strip or tile is decoded by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelith.sources import codecs

#: Bytes of a value of each field type 1 to 19 (fixed values).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 14: 2, 15: 8, 16: 8, 17: 8, 18: 8, 19: 2}
#: struct codes of the types that are single numbers.
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Roles by sub-file type (fixed values).
ROLES = {0: "main", 1: "preview", 4: "mask", 5: "preview", 8: "depth", 9: "preview", 16: "enhanced", 32: "gain_map", 33: "preview", 0x10001: "preview", 0x10004: "semantic", 0x10005: "preview"}
MOST_CHAINED, MOST_SUBS, MOST_ENTRIES = 10, 125, 16384
SUB_IFDS = 330


#: Types of single whole numbers.
WHOLE = (1, 3, 4, 6, 8, 9, 13, 16, 17, 18)


class FormatError(ValueError):
    pass


@dataclass
class Entry:
    tag: int
    type: int
    count: int
    payload: bytes

    def values(self, order: str) -> list:
        """The numbers of the entry; rationals are (n, d) pairs; text and undefined bytes come as one value."""
        if self.type == 2:
            return [self.payload.split(b"\0")[0].decode("utf-8", "replace")]
        if self.type == 7:
            return [self.payload]
        if self.type in (5, 10):
            flat = struct.unpack(f"{order}{2 * self.count}{'I' if self.type == 5 else 'i'}", self.payload)
            return list(zip(flat[::2], flat[1::2], strict=True))
        if self.type not in CODES:
            raise FormatError(f"type {self.type}")
        return list(struct.unpack(f"{order}{self.count}{CODES[self.type]}", self.payload))

    def reals(self, order: str) -> list[float]:
        """The numbers as floats; a rational over 0 is 0."""
        return [(v[0] / v[1] if v[1] else 0.0) if isinstance(v, tuple) else float(v) for v in self.values(order)]


@dataclass
class Ifd:
    entries: list[Entry] = field(default_factory=list)
    parent: int | None = None

    def find(self, tag: int) -> Entry | None:
        """The last entry of a tag."""
        return next((e for e in reversed(self.entries) if e.tag == tag), None)

    def number(self, tag: int, order: str, default: int | None = None) -> int | None:
        """The first number of a tag; one without a whole number is an error."""
        e = self.find(tag)
        if e is None:
            return default
        if e.type not in WHOLE or not e.count:
            raise FormatError(f"tag {tag} has no whole number")
        return int(e.values(order)[0])

    def scalar(self, tag: int, order: str, default: int | None = None) -> int | None:
        """The number of a tag that must have exactly one."""
        e = self.find(tag)
        if e is not None and e.count != 1:
            raise FormatError(f"tag {tag} has {e.count} values")
        return self.number(tag, order, default)

    def role(self, order: str) -> str | None:
        return ROLES.get(self.scalar(254, order, 0))


@dataclass
class Container:
    order: str
    big: bool
    ifds: list[Ifd]  # each top-level one, then its sub-IFDs


def header(data: bytes) -> tuple[str, bool, int]:
    """Byte order, whether offsets have 64 bits, place of the first IFD."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise FormatError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        return order, False, struct.unpack_from(order + "I", data, 4)[0]
    if magic == 43 and len(data) >= 16 and struct.unpack_from(order + "HH", data, 4) == (8, 0):
        return order, True, struct.unpack_from(order + "Q", data, 8)[0]
    raise FormatError("no TIFF magic")


def read_ifd(data: bytes, at: int, order: str, big: bool) -> tuple[Ifd, int]:
    """An IFD and the place of the next one, 0 for none."""
    try:
        count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        if count > MOST_ENTRIES:
            raise FormatError("too many entries")
        at += 8 if big else 2
        ifd, size, inline = Ifd(), 20 if big else 12, 8 if big else 4
        for i in range(count):
            p = at + i * size
            tag, kind = struct.unpack_from(order + "HH", data, p)
            n = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)[0]
            length = SIZES.get(kind, 0) * n
            where = p + size - inline
            if length > inline:
                where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
            if where + length > len(data):
                raise FormatError("value outside the file")
            ifd.entries.append(Entry(tag, kind, n, bytes(data[where : where + length])))
        return ifd, struct.unpack_from(order + ("Q" if big else "I"), data, at + count * size)[0]
    except struct.error:
        raise FormatError("truncated IFD") from None


def parse(data: bytes) -> Container:
    order, big, at = header(data)
    if not 8 <= at < len(data):
        raise FormatError("first IFD outside the file")
    found, seen, hops = Container(order, big, []), set(), 0
    while at:
        if at in seen:
            raise FormatError("IFD chain goes in a circle")
        seen.add(at)
        hops += 1
        if hops > MOST_CHAINED:
            raise FormatError(f"more than {MOST_CHAINED} chained IFDs")
        ifd, at = read_ifd(data, at, order, big)
        found.ifds.append(ifd)
        parent = len(found.ifds) - 1
        subs = ifd.find(SUB_IFDS)
        if subs is not None:
            if subs.count > MOST_SUBS:
                raise FormatError("too many sub-IFDs")
            if subs.type not in WHOLE:
                raise FormatError("sub-IFDs are no offsets")
            for place in subs.values(order):
                if place <= 0:
                    continue
                if place in seen:
                    raise FormatError("IFD chain goes in a circle")
                seen.add(place)
                sub, _ = read_ifd(data, place, order, big)
                sub.parent = parent
                found.ifds.append(sub)
    return found


def roles(c: Container) -> dict[str, list[int]]:
    """Index of the IFDs of each role; of all but previews and semantic masks the first one counts."""
    out: dict[str, list[int]] = {}
    for i, ifd in enumerate(c.ifds):
        role = ifd.role(c.order)
        if role and (role in ("preview", "semantic") or role not in out):
            out.setdefault(role, []).append(i)
    return out


@dataclass(frozen=True)
class Layout:
    """How an image is stored: its size and type, and the place, size and corner of each strip or tile."""

    height: int
    width: int
    planes: int
    kind: str
    code: int
    predictor: int
    tile: tuple[int, int]
    parts: list[tuple[int, int, int, int]]  # offset, bytes, top, left

    def lines(self, top: int, tiled: bool) -> int:
        return self.tile[0] if tiled else min(self.tile[0], self.height - top)


def layout(data: bytes, c: Container, ifd: Ifd) -> tuple[Layout, bool]:
    """The layout of an IFD's image, and whether it is in tiles."""
    o = c.order
    width, height = ifd.scalar(256, o), ifd.scalar(257, o)
    if not width or not height or width < 0 or height < 0:
        raise FormatError("no size")
    planes, code = ifd.scalar(277, o, 1), ifd.scalar(259, o, 1)
    if ifd.scalar(284, o, 1) != 1:
        raise FormatError("separate planes are not supported")
    kind = codecs.sample_type(ifd.number(258, o, 1), ifd.number(339, o, 1))
    tiled = ifd.find(324) is not None
    empty = Entry(0, 4, 0, b"")
    offsets, sizes = ((ifd.find(t) or empty) for t in ((324, 325) if tiled else (273, 279)))
    if offsets.type not in WHOLE or sizes.type not in WHOLE:
        raise FormatError("places are no whole numbers")
    offsets, sizes = offsets.values(o), sizes.values(o)
    if tiled:
        tw, th = ifd.scalar(322, o, 0), ifd.scalar(323, o, 0)
        if tw <= 0 or th <= 0:
            raise FormatError("no tile size")
        across, down = -(-width // tw), -(-height // th)
    else:
        th = min(ifd.scalar(278, o, 0) or height, height)
        tw, across, down = width, 1, -(-height // th)
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise FormatError("strips or tiles don't match the size")
    if any(at + n > len(data) for at, n in zip(offsets, sizes, strict=True)):
        raise FormatError("strip outside the file")
    parts = [(at, n, i // across * th, i % across * tw) for i, (at, n) in enumerate(zip(offsets, sizes, strict=True))]
    return Layout(height, width, planes, kind, code, ifd.scalar(317, o, 1), (th, tw), parts), tiled


def read_image(data: bytes, c: Container, ifd: Ifd) -> np.ndarray:
    """height x width x planes samples of an IFD's strips or tiles."""
    l, tiled = layout(data, c, ifd)
    out = np.zeros((l.height, l.width, l.planes), l.kind)
    for at, n, y, x in l.parts:
        got = codecs.decode(l.code, data[at : at + n], l.lines(y, tiled), l.tile[1], l.planes, l.kind, c.order, l.predictor)
        out[y : y + l.tile[0], x : x + l.tile[1]] = got[: l.height - y, : l.width - x]
    return out


# --- writing ---------------------------------------------------------------------------------------------------


def entry(tag: int, kind: int, values, order: str = "<") -> Entry:
    """An entry from Python values: numbers, (n, d) pairs, text or bytes."""
    if kind == 2:
        raw = values.encode() + b"\0"
        return Entry(tag, 2, len(raw), raw)
    if kind == 7:
        return Entry(tag, 7, len(values), bytes(values))
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    if kind in (5, 10):
        flat = [x for v in values for x in v]
        return Entry(tag, kind, len(values), struct.pack(f"{order}{len(flat)}{'I' if kind == 5 else 'i'}", *flat))
    return Entry(tag, kind, len(values), struct.pack(f"{order}{len(values)}{CODES[kind]}", *values))


@dataclass
class Page:
    """An IFD to write: entries without strip places, its strips, and sub-pages."""

    entries: list[Entry]
    blobs: list[bytes] = field(default_factory=list)
    subs: list[Page] = field(default_factory=list)
    tiled: bool = False


def write(pages: list[Page], order: str = "<") -> bytes:
    """A 32-bit TIFF of chained pages. Entries are sorted by tag, values of up to 4 bytes are inline, all else is aligned to 2."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))

    def put(raw: bytes) -> int:
        if len(out) % 2:
            out.append(0)
        at = len(out)
        out.extend(raw)
        if len(out) > 0xFFFFFFFF:
            raise FormatError("over 4 GiB")
        return at

    def page(p: Page) -> tuple[int, int]:
        """Place of the IFD and of its next pointer."""
        entries = [e for e in p.entries if e.tag not in (273, 279, 324, 325, SUB_IFDS)]
        if p.blobs:
            places = [put(b) for b in p.blobs]
            entries.append(entry(324 if p.tiled else 273, 4, places, order))
            entries.append(entry(325 if p.tiled else 279, 4, [len(b) for b in p.blobs], order))
        if p.subs:
            entries.append(entry(SUB_IFDS, 4, [page(s)[0] for s in p.subs], order))
        entries.sort(key=lambda e: e.tag)
        body = struct.pack(order + "H", len(entries))
        for e in entries:
            value = e.payload.ljust(4, b"\0") if len(e.payload) <= 4 else struct.pack(order + "I", put(e.payload))
            body += struct.pack(order + "HHI", e.tag, e.type, e.count) + value
        at = put(body + b"\0\0\0\0")
        return at, at + len(body)

    pointer = 4
    for p in pages:
        at, after = page(p)
        struct.pack_into(order + "I", out, pointer, at)
        pointer = after
    return bytes(out)


def image_page(image: np.ndarray, *, order: str = "<", code: int = codecs.RAW, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, photometric: int | None = None, sub_type: int = 0, extra: list[Entry] | None = None) -> Page:
    """A page of a height x width x planes image, in strips or tiles."""
    height, width, planes = image.shape
    kind = image.dtype
    if code not in (codecs.RAW, codecs.DEFLATE, codecs.JPEG):
        raise FormatError("no encoder")

    def coded(part: np.ndarray) -> bytes:
        if code == codecs.JPEG:
            return codecs.encode_lossless_jpeg(part)
        return (codecs.encode_raw if code == codecs.RAW else codecs.encode_deflate)(part, order)

    fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
    entries = [entry(254, 4, sub_type, order), entry(256, 4, width, order), entry(257, 4, height, order), entry(258, 3, [kind.itemsize * 8] * planes, order), entry(259, 3, code, order), entry(262, 3, photometric if photometric is not None else (1 if planes < 3 else 2), order), entry(277, 3, planes, order), entry(284, 3, 1, order), entry(339, 3, [fmt] * planes, order)]
    blobs = []
    if tile:
        th, tw = tile
        entries += [entry(322, 4, tw, order), entry(323, 4, th, order)]
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = image[y : y + th, x : x + tw]
                blobs.append(coded(np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)), mode="edge")))
    else:
        step = rows_per_strip or height
        entries.append(entry(278, 4, step, order))
        blobs = [coded(image[y : y + step]) for y in range(0, height, step)]
    return Page(entries + (extra or []), blobs, tiled=bool(tile))


def rewrite(data: bytes) -> bytes:
    """The same container again: entries as they are, but for the places of strips, tiles and sub-IFDs."""
    c = parse(data)

    def page(i: int) -> Page:
        ifd = c.ifds[i]
        tiled = ifd.find(324) is not None
        at, size = ifd.find(324 if tiled else 273), ifd.find(325 if tiled else 279)
        blobs = [bytes(data[a : a + n]) for a, n in zip(at.values(c.order), size.values(c.order), strict=True)] if at and size else []
        return Page(ifd.entries, blobs, [page(j) for j, s in enumerate(c.ifds) if s.parent == i], tiled)

    return write([page(i) for i, ifd in enumerate(c.ifds) if ifd.parent is None], c.order)


def rewritten(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """(file_id, content): rewrite() of each file; one that can't be read fails the query, or is left out (skip)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    out.append((file_id, rewrite(bytes(content or b""))))
                except BROKEN:
                    if on_error == "raise":
                        raise
            yield pd.DataFrame(out, columns=["file_id", "content"])

    return files.select("file_id", "content").mapInPandas(run, "file_id long, content binary")


# --- Spark -----------------------------------------------------------------------------------------------------

ENTRIES = "file_id long, ifd_idx int, parent_idx int, role string, entry_ord int, tag int, type int, count long, payload binary, big_endian boolean, big_tiff boolean, error string"
#: What a broken file may raise; a file with any of these is a row with its error, where rows are asked for.
BROKEN = (FormatError, codecs.CodecError, struct.error, IndexError, OverflowError, UnicodeDecodeError, MemoryError)


def files(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """The files below a path: path, modificationTime, length, content. Metadata queries that skip content don't read it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def entries(files: DataFrame, on_error: str = "row") -> DataFrame:
    """The tag entries of (file_id, content). A file that can't be parsed gives one row with its error, or fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    c = parse(bytes(content or b""))
                    rows += [(file_id, i, ifd.parent, ifd.role(c.order), k, e.tag, e.type, e.count, e.payload, c.order == ">", c.big, None) for i, ifd in enumerate(c.ifds) for k, e in enumerate(ifd.entries)]
                except BROKEN as e:
                    if on_error != "row":
                        raise
                    rows.append((file_id, *[None] * (len(names) - 2), str(e)))
            yield pd.DataFrame(rows, columns=names).astype({"parent_idx": "Int32", "ifd_idx": "Int32", "entry_ord": "Int32", "tag": "Int32", "type": "Int32", "count": "Int64"})

    return files.select("file_id", "content").mapInPandas(run, ENTRIES)


PARTS = "file_id long, top int, left int, lines int, height int, width int, planes int, tile_width int, kind string, code int, predictor int, byte_order string, data binary, error string"
SEGMENTS = "file_id long, row int, left int, plane int, vals array<double>, error string"


def parts(files: DataFrame, role: str = "main") -> DataFrame:
    """The strips or tiles, still coded, of the images of a role: a row each, with all that decoding needs, or a row with the
    error of a file that can't be read. A file without the role has no row, but for the main image, where that is an error."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                data = bytes(content.as_buffer()) if content.is_valid else b""
                try:
                    c = parse(data)
                    wanted = roles(c).get(role, [])
                    if not wanted and role == "main":
                        raise FormatError("no main image")
                    rows = []
                    for i in wanted:
                        l, tiled = layout(data, c, c.ifds[i])
                        rows += [(file_id, y, x, l.lines(y, tiled), l.height, l.width, l.planes, l.tile[1], l.kind, l.code, l.predictor, c.order, data[at : at + n], None) for at, n, y, x in l.parts]
                except BROKEN as e:
                    rows = [(file_id, *[None] * (len(names) - 2), str(e))]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], names=names)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in PARTS.split(", ")]
    return files.select("file_id", "content").mapInArrow(run, PARTS)


def segments(files: DataFrame, role: str = "main") -> DataFrame:
    """file_id, row, left, plane, vals of the images of a role: the part of a scanline that a strip or tile has, or the error.

    Strips and tiles, coded as they are, are dealt to all tasks before they are decoded, so one large file is the work of
    many.
    """

    own = dict(codecs.REGISTERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.DECODERS.update(own)
        for batch in batches:
            for p in batch.to_pylist():
                error = p["error"]
                if error is None:
                    try:
                        got = codecs.decode(p["code"], p["data"], p["lines"], p["tile_width"], p["planes"], p["kind"], p["byte_order"], p["predictor"])
                    except BROKEN as e:
                        error = str(e)
                if error is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([p["file_id"]], pa.int64()), *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))], pa.array([error])], names=names)
                    continue
                image = got[: p["height"] - p["top"], : p["width"] - p["left"]].transpose(0, 2, 1).astype(np.float64)
                lines, planes, width = image.shape
                step = max(1, (1 << 20) // max(width * planes, 1))
                for y in range(0, lines, step):
                    some = image[y : y + step]
                    n = some.shape[0] * planes
                    vals = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(some.reshape(-1)))
                    row = np.repeat(np.arange(y, y + some.shape[0], dtype=np.int32) + p["top"], planes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p["file_id"])), pa.array(row), pa.array(np.full(n, p["left"], np.int32)), pa.array(np.tile(np.arange(planes, dtype=np.int32), some.shape[0])), vals, pa.nulls(n, pa.string())], names=names)

    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    coded = parts(files, role)
    return coded.repartition(F.xxhash64("file_id", "top", "left")).mapInArrow(run, SEGMENTS)


def checked(found: DataFrame, on_error: str) -> DataFrame:
    """The rows without an error. on_error: raise the first error, or skip the files that have one, whole."""
    if on_error == "raise":
        return found.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("file "), F.col("file_id"), F.lit(": "), F.col("error"))).cast("boolean"))).drop("error")
    return found.where("error is null").drop("error")


def samples(files: DataFrame, role: str = "main", on_error: str = "raise") -> DataFrame:
    """image_id, row, col, plane, value of the images of a role. Python makes scanlines; they are exploded here. Of a file
    with an error ("skip") the strips or tiles that can be decoded are left; failures() tells which files these are."""
    lines = checked(segments(files, role), on_error)
    return lines.select(F.col("file_id").alias("image_id"), "row", "left", "plane", F.posexplode("vals").alias("_at", "value")).select("image_id", "row", (F.col("left") + F.col("_at")).alias("col"), "plane", "value")


def scanlines(files: DataFrame, role: str = "main", on_error: str = "raise") -> DataFrame:
    """image_id, row, plane, vals: whole scanlines, tiles put side by side."""
    found = checked(segments(files, role), on_error)
    whole = found.groupBy(F.col("file_id").alias("image_id"), "row", "plane").agg(F.array_sort(F.collect_list(F.struct("left", "vals"))).alias("_v"))
    return whole.select("image_id", "row", "plane", F.flatten(F.transform("_v", lambda s: s["vals"])).alias("vals"))


def failures(files: DataFrame, role: str = "main") -> DataFrame:
    """file_id, error of the files that can't be read or decoded."""
    return segments(files, role).where("error is not null").groupBy("file_id").agg(F.min("error").alias("error"))


def build(pixels: DataFrame, kind: str = "u2", orientation: DataFrame | None = None, size: tuple[int, int] = (1, 1), **options) -> DataFrame:
    """(file_id, content): a TIFF for each image of image_id, row, col, plane, value. The format bounds an image.

    orientation: (image_id, orientation) of the images; codes 2 to 8 are written as a tag, as the pixels are not turned.
    size: the height and width that an image has at least; samples that the table lacks are 0.
    """

    def run(key: tuple[pa.Scalar, ...], lines: pa.Table) -> pa.Table:
        row, plane = lines.column("row").to_numpy(), lines.column("plane").to_numpy()
        cols = [c.values.to_numpy() for c in lines.column("cols")]
        image = np.zeros((max(int(row.max()) + 1, size[0]), max(size[1], *(int(c.max()) + 1 for c in cols)), int(plane.max()) + 1), kind)
        for r, p, c, v in zip(row.tolist(), plane.tolist(), cols, lines.column("vals"), strict=True):
            image[r, c, p] = v.values.to_numpy()
        order = options.get("order", "<")
        turned = lines.column("turned")[0].as_py() or 0
        extra = [*options.get("extra", ()), *([entry(274, 3, turned, order)] if 1 < turned <= 8 else [])]
        content = write([image_page(image, **(options | {"extra": extra}))], order)
        return pa.table({"file_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    at = F.array_sort(F.collect_list(F.struct("col", F.col("value").cast("double").alias("value"))))
    lines = pixels.groupBy("image_id", "row", "plane").agg(at.alias("_v")).select("image_id", "row", "plane", F.transform("_v", lambda s: s["col"].cast("int")).alias("cols"), F.transform("_v", lambda s: s["value"]).alias("vals"))
    if orientation is not None:
        lines = lines.join(orientation.select("image_id", F.col("orientation").cast("int").alias("turned")), "image_id", "left")
    else:
        lines = lines.withColumn("turned", F.lit(0))
    return lines.groupBy("image_id").applyInArrow(run, "file_id long, content binary")


def byte_at(content: Column, at: int, size: int, little: bool | Column = True) -> Column:
    """An unsigned number of up to 7 bytes at a place of a binary column, in the JVM. little: the byte order, if need be by row."""

    def number(reverse: bool) -> Column:
        total = None
        for i in range(size):
            one = F.conv(F.hex(F.substring(content, at + 1 + (size - 1 - i if reverse else i), 1)), 16, 10).cast("long")
            total = one if total is None else total * 256 + one
        return total

    if isinstance(little, bool):
        return number(little)
    return F.when(little, number(True)).otherwise(number(False))


def whole(payload: Column, type_: Column, big_endian: Column) -> Column:
    """The first number of a payload of bytes, shorts or longs, in the JVM; null for other types and for no bytes."""
    by_size = F.when(type_ == 1, byte_at(payload, 0, 1)).when(type_ == 3, byte_at(payload, 0, 2, ~big_endian)).when(type_.isin(4, 13), byte_at(payload, 0, 4, ~big_endian))
    return F.when(F.octet_length(payload) > 0, by_size)


def tags(entries_: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """A row per IFD with the payload of each wanted tag; of repeated tags the last entry counts."""
    picked = [F.max_by("payload", F.when(F.col("tag") == t, F.col("entry_ord"))).alias(n) for n, t in wanted.items()]
    return entries_.where(F.col("tag").isin(list(wanted.values()))).groupBy("file_id", "ifd_idx").agg(*picked)


def numbers(entries_: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """tags(), as whole numbers of the JVM."""
    value = whole(F.col("payload"), F.col("type"), F.col("big_endian"))
    picked = [F.max_by("_value", F.when(F.col("tag") == t, F.col("entry_ord"))).alias(n) for n, t in wanted.items()]
    return entries_.where(F.col("tag").isin(list(wanted.values()))).withColumn("_value", value).groupBy("file_id", "ifd_idx").agg(*picked)


#: The tag of the oldest reader that can read a file, and the version that this one is as good as (fixed values).
OLDEST_READER, READER = 50707, (1, 7, 1, 0)


def readable(entries_: DataFrame, reader: tuple[int, int, int, int] = READER) -> DataFrame:
    """file_id, needs (four numbers, null if the file doesn't tell) and readable: whether a reader of this version may read it."""
    needs = F.array(*[F.conv(F.hex(F.substring("payload", i, 1)), 16, 10).cast("int") for i in range(1, 5)])
    found = entries_.where("error is null").groupBy("file_id").agg(F.max_by("payload", F.when((F.col("tag") == OLDEST_READER) & (F.col("ifd_idx") == 0) & (F.octet_length("payload") >= 4), F.col("entry_ord"))).alias("payload"))
    out = found.select("file_id", F.when(F.col("payload").isNotNull(), needs).alias("needs"))
    return out.withColumn("readable", F.coalesce(F.col("needs") <= F.array(*[F.lit(v) for v in reader]), F.lit(True)))


def summary(entries_: DataFrame) -> DataFrame:
    """Per file: byte order, format, numbers of IFDs, top-level ones and entries, the roles, the first main image (index,
    size, compression, photometric, entries) and the indexes of previews and masks."""
    fine = entries_.where("error is null")
    wanted = {"width": 256, "height": 257, "compression": 259, "photometric": 262}
    one = fine.groupBy("file_id", "ifd_idx").agg(F.first("role").alias("role"), F.first("parent_idx").alias("parent_idx"), F.count(F.lit(1)).alias("n"), F.first("big_endian").alias("big_endian"), F.first("big_tiff").alias("big_tiff"))
    one = one.join(numbers(fine, wanted), ["file_id", "ifd_idx"], "left")
    main = [F.min_by(n, F.when(F.col("role") == "main", F.col("ifd_idx"))).alias(n) for n in wanted]

    def of(role: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("ifd_idx"))))

    return one.groupBy("file_id").agg(
        F.when(F.first("big_endian"), "MM").otherwise("II").alias("byte_order"), F.when(F.first("big_tiff"), 64).otherwise(32).alias("offset_bits"), F.count(F.lit(1)).alias("ifds"), F.count(F.when(F.col("parent_idx").isNull(), 1)).alias("top_level"), F.sum("n").alias("entries"), F.array_sort(F.collect_list("role")).alias("roles"),
        F.min(F.when(F.col("role") == "main", F.col("ifd_idx"))).alias("main"), *main, F.min_by("n", F.when(F.col("role") == "main", F.col("ifd_idx"))).alias("main_entries"), of("preview").alias("previews"), of("mask").alias("masks"),
    )
