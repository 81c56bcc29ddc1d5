"""Typed readers over parsed IFDs, text formatting of tag values, and IIM records."""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixelith.sources import tiff
from pixelith.sources.tiff import Entry, FormatError, Ifd

#: Tags of the readers (fixed values of the public format).
T = {
    "cfa_dims": 33421, "cfa_pattern": 33422, "lut": 50712, "black_dims": 50713, "black": 50714, "delta_h": 50715, "delta_v": 50716,
    "white": 50717, "crop_origin": 50719, "crop_size": 50720, "color_1": 50721, "color_2": 50722, "calibration_1": 50723,
    "calibration_2": 50724, "balance": 50727, "neutral": 50728, "white_xy": 50729, "exposure": 50730, "split": 50737, "illuminant_1": 50778,
    "illuminant_2": 50779, "active": 50829, "hue_dims": 50937, "hue_1": 50938, "hue_2": 50939, "curve": 50940, "forward_1": 50964,
    "forward_2": 50965, "row_interleave": 50975, "col_interleave": 52547, "opcodes_1": 51008, "opcodes_2": 51009, "opcodes_3": 51022,
}
#: Text and number tags of the exposure record (fixed values of the public format).
EXIF_TEXT = {"make": 271, "model": 272, "description": 270, "software": 305, "artist": 315, "copyright": 33432, "serial": 50735, "lens_make": 42035, "lens_model": 42036, "lens_serial": 42037, "date": 306, "date_original": 36867, "date_digitized": 36868, "offset": 36880, "offset_original": 36881, "offset_digitized": 36882}
EXIF_REAL = {"exposure_time": 33434, "f_number": 33437, "exposure_bias": 37380, "focal_length": 37386}
EXIF_NUMBER = {"iso": 34855, "flash": 37385, "metering": 37383, "program": 34850, "light_source": 37384, "white_balance": 41987, "focal_35mm": 41989, "color_space": 40961}
#: Datasets of IIM record 2: name and whether it repeats (fixed values of the public format).
IIM = {5: ("title", 0), 10: ("urgency", 0), 15: ("category", 0), 20: ("supplemental", 1), 25: ("keyword", 1), 40: ("instructions", 0), 55: ("date_created", 0), 60: ("time_created", 0), 62: ("digital_date", 0), 63: ("digital_time", 0), 80: ("author", 1), 85: ("author_position", 0), 90: ("city", 0), 92: ("location", 0), 95: ("state", 0), 100: ("country_code", 0), 101: ("country", 0), 103: ("transmission", 0), 105: ("headline", 0), 110: ("credit", 0), 115: ("source", 0), 116: ("copyright", 0), 120: ("description", 0), 122: ("writer", 0)}


def reals(ifd: Ifd, name: str, order: str, types: tuple[int, ...] | None = None) -> list[float]:
    e = ifd.find(T[name])
    return [] if e is None or (types and e.type not in types) else e.reals(order)


def linearization(ifd: Ifd, order: str, is_float: bool = False) -> dict:
    """Black, white, table and deltas; deltas must be signed rationals, a white level is 1 or 65535 where none is told."""
    dims = reals(ifd, "black_dims", order)
    return {
        "dims": (int(dims[0]), int(dims[1])) if len(dims) >= 2 else (1, 1),
        "black": reals(ifd, "black", order) or [0.0],
        "white": reals(ifd, "white", order) or [1.0 if is_float else 65535.0],
        "lut": reals(ifd, "lut", order) or None,
        "delta_h": reals(ifd, "delta_h", order, (10,)) or None,
        "delta_v": reals(ifd, "delta_v", order, (10,)) or None,
    }


def mosaic(ifd: Ifd, order: str) -> dict | None:
    e = ifd.find(T["cfa_pattern"])
    if e is None:
        return None
    dims = reals(ifd, "cfa_dims", order)
    return {"dims": (int(dims[0]), int(dims[1])) if len(dims) >= 2 else (2, 2), "pattern": list(e.payload), "split": int((reals(ifd, "split", order) or [0])[0]), "rows": int((reals(ifd, "row_interleave", order) or [1])[0]), "cols": int((reals(ifd, "col_interleave", order) or [1])[0])}


def active_area(ifd: Ifd, order: str) -> tuple[int, int, int, int] | None:
    v = reals(ifd, "active", order)
    return tuple(int(x) for x in v[:4]) if len(v) >= 4 else None


def default_crop(ifd: Ifd, order: str, active: tuple[int, int, int, int]) -> tuple[int, int, int, int] | None:
    """Crop in image coordinates: origin and size round half to even; what leaves the active area slides back in."""
    origin, size = reals(ifd, "crop_origin", order), reals(ifd, "crop_size", order)
    if len(origin) < 2 or len(size) < 2:
        return None
    out = []
    for k, (lo, hi) in ((1, (active[0], active[2])), (0, (active[1], active[3]))):
        start = lo + round(origin[k])
        end = start + round(size[k])
        if lo < hi:
            if end > hi:
                start, end = start - (end - hi), hi
            start = max(lo, start)
        out.append((start, end))
    (t, b), (l, r) = out
    return (t, l, b, r) if b > t and r > l else None


def profile(ifd: Ifd, order: str) -> dict:
    """The camera profile: balance, neutral or white (a white, read last, displaces the neutral), two calibrations, curve."""
    curve = reals(ifd, "curve", order, (11,))
    white = reals(ifd, "white_xy", order)
    sides = []
    for i in ("1", "2"):
        code = reals(ifd, f"illuminant_{i}", order)
        if code:
            sides.append({"illuminant": int(code[0]), "color": reals(ifd, f"color_{i}", order), "forward": reals(ifd, f"forward_{i}", order), "calibration": reals(ifd, f"calibration_{i}", order), "hue": reals(ifd, f"hue_{i}", order)})
    return {"balance": reals(ifd, "balance", order), "neutral": [] if len(white) >= 2 else reals(ifd, "neutral", order), "white_xy": white[:2], "exposure": (reals(ifd, "exposure", order) or [0.0])[0], "curve": list(zip(curve[::2], curve[1::2], strict=False)), "hue_dims": [int(x) for x in reals(ifd, "hue_dims", order)], "calibrations": sides}


def exif(ifd: Ifd, order: str) -> dict:
    """The exposure record; tags that it doesn't know are kept as bytes."""
    out: dict = {"unknown": {}}
    by_tag = {t: (n, "text") for n, t in EXIF_TEXT.items()} | {t: (n, "real") for n, t in EXIF_REAL.items()} | {t: (n, "number") for n, t in EXIF_NUMBER.items()}
    for e in ifd.entries:
        name, kind = by_tag.get(e.tag, (None, None))
        if name is None:
            out["unknown"][e.tag] = e.payload
        elif kind == "text":
            out[name] = e.payload.rstrip(b"\0").decode("utf-8", "replace")
        else:
            v = e.reals(order)
            out[name] = (v[0] if kind == "real" else int(v[0])) if v else None
    return out


def iim(block: bytes) -> list[tuple[str, str]]:
    """(name, text) of the datasets of record 2, in order. Bytes between datasets are passed over; a cut dataset is an error."""
    out, utf8, i = [], False, 0
    while i < len(block):
        if block[i] != 0x1C:
            i += 1
            continue
        if i + 5 > len(block):
            raise FormatError("cut dataset")
        record, dataset, size = block[i + 1], block[i + 2], int.from_bytes(block[i + 3 : i + 5], "big")
        payload = block[i + 5 : i + 5 + size]
        if len(payload) < size:
            raise FormatError("cut dataset")
        i += 5 + size
        if record == 1 and dataset == 90:
            utf8 = utf8 or b"G" in payload
        elif record == 2 and dataset in IIM:
            out.append((IIM[dataset][0], payload.decode("utf-8" if utf8 else "latin-1", "replace").rstrip("\0")))
    return out


#: Bytes that a dataset's size can tell (fixed by the format).
MOST_BYTES = 65535


def iim_pieces(dataset: int, text: str) -> Iterator[bytes]:
    """A text in as many datasets as it needs, cut between characters and not after a NUL, which readers strip.

    A dataset that may repeat can't be cut: its pieces would be read as several values.
    """
    raw = text.encode()
    if len(raw) > MOST_BYTES and IIM.get(dataset, ("", 1))[1]:
        raise FormatError(f"dataset {dataset} has {len(raw)} bytes")
    while len(raw) > MOST_BYTES:
        cut = MOST_BYTES
        while cut and (raw[cut] & 0xC0 == 0x80 or raw[cut - 1] == 0):
            cut -= 1
        if not cut:
            raise FormatError(f"dataset {dataset} can't be cut")
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def iim_block(fields: list[tuple[int, str]]) -> bytes:
    """A block of UTF-8 datasets of record 2; a long text goes to several in a row, which iim_joined() puts together."""
    out = b"\x1c\x01\x5a\x00\x03\x1b%G"
    for dataset, text in fields:
        for raw in iim_pieces(dataset, text):
            out += bytes([0x1C, 2, dataset]) + len(raw).to_bytes(2, "big") + raw
    return out


def iim_joined(records: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The records with those in a row joined whose dataset doesn't repeat."""
    once = {name for name, repeats in IIM.values() if not repeats}
    out: list[tuple[str, str]] = []
    for name, group in itertools.groupby(records, key=lambda r: r[0]):
        texts = [text for _, text in group]
        out += [(name, "".join(texts))] if name in once else [(name, text) for text in texts]
    return out


def iim_records(blocks: DataFrame, join: bool = False) -> DataFrame:
    """file_id, ord, name, text of (file_id, content); join: texts over several datasets are put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = ((f, iim(bytes(c or b""))) for f, c in zip(batch["file_id"], batch["content"], strict=True))
            rows = [(f, k, n, t) for f, found in read for k, (n, t) in enumerate(iim_joined(found) if join else found)]
            yield pd.DataFrame(rows, columns=["file_id", "ord", "name", "text"])

    return blocks.select("file_id", "content").mapInPandas(run, "file_id long, ord int, name string, text string")


def iim_date(text: str) -> tuple[int, int, int] | None:
    m = re.match(r"(\d{4})(\d{2})(\d{2})", text)
    return tuple(map(int, m.groups())) if m else None


def iim_time(text: str) -> tuple[int, int, int] | None:
    m = re.match(r"(\d{2})(\d{2})(\d{2})", text)
    return tuple(map(int, m.groups())) if m else None


def shown(e: Entry, order: str, most: int = 8) -> str:
    """A tag value as text: quoted, in brackets, at most `most` elements."""
    if e.type == 2:
        body = e.payload.rstrip(b"\0").decode("utf-8", "replace")
        return '"' + "".join("\\" + c if c in '\\"' else f"\\x{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in body) + '"'
    if e.type == 13:
        return f"IFD@{struct.unpack(order + 'I', e.payload[:4])[0]}"
    if e.type in (1, 7) and len(e.payload) > 4:
        return f"<{len(e.payload)} bytes: {e.payload[:16].hex(' ')}{' ...' if len(e.payload) > 16 else ''}>"
    values = list(e.payload) if e.type == 7 else e.values(order)
    parts = [f"{v[0]}/{v[1]} ({v[0] / v[1] if v[1] else 0.0:.4G})" if isinstance(v, tuple) else f"{v:.6G}" if isinstance(v, float) else str(v) for v in values[:most]]
    return "[" + ", ".join(parts) + (f", … (+{len(values) - most} more)" if len(values) > most else "") + "]"


def dump(files: DataFrame, most: int = 8) -> DataFrame:
    """file_id, ifd_idx, role, tag, type, count, text: the tags of each IFD in order of their numbers, values as shown(). A file
    that can't be read has one row, whose text is its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    c = tiff.parse(bytes(content or b""))
                    first = {i: role for role, places in tiff.roles(c).items() for i in places}
                    for i, ifd in enumerate(c.ifds):
                        rows += [(file_id, i, first.get(i, ""), e.tag, e.type, e.count, shown(e, c.order, most)) for e in sorted(ifd.entries, key=lambda e: e.tag)]
                except tiff.BROKEN as e:
                    rows.append((file_id, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file_id", "ifd_idx", "role", "tag", "type", "count", "text"]).astype({"ifd_idx": "Int32", "tag": "Int32", "type": "Int32", "count": "Int64"})

    return files.select("file_id", "content").mapInPandas(run, "file_id long, ifd_idx int, role string, tag int, type int, count long, text string")


def exif_records(files: DataFrame) -> DataFrame:
    """A row per file of the exposure record of its first IFD: a column for each tag of EXIF_TEXT, EXIF_REAL and EXIF_NUMBER,
    null where the file has none; unknown, a map of all other tags to their bytes; and the error of a file that can't be
    read. Dates stay text: functions.pixels.exif_date() reads them."""
    kinds = {**dict.fromkeys(EXIF_TEXT, "string"), **dict.fromkeys(EXIF_REAL, "double"), **dict.fromkeys(EXIF_NUMBER, "long")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    c = tiff.parse(bytes(content or b""))
                    found, error = exif(c.ifds[0], c.order), None
                except tiff.BROKEN as e:
                    found, error = {}, str(e)
                rows.append((file_id, *[found.get(n) for n in kinds], found.get("unknown", {}), error))
            frame = pd.DataFrame(rows, columns=["file_id", *kinds, "unknown", "error"])
            yield frame.astype({n: "Int64" for n in EXIF_NUMBER})

    return files.select("file_id", "content").mapInPandas(run, "file_id long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", unknown map<int, binary>, error string")


def by_file(files: DataFrame, schema: str, read) -> DataFrame:
    """file_id and what read(container, main or first IFD) gives, a tuple of values or a list of such, by the columns of
    schema; a file that can't be read has nulls and its error."""
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    c = tiff.parse(bytes(content or b""))
                    places = tiff.roles(c).get("main", [0])
                    found = read(c, c.ifds[places[0]])
                    rows += [(file_id, *r, None) for r in (found if isinstance(found, list) else [found])]
                except tiff.BROKEN as e:
                    rows.append((file_id, *[None] * len(names), str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names=["file_id", *names, "error"])

    whole = f"file_id long, {schema}, error string"
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(whole))]
    return files.select("file_id", "content").mapInArrow(run, whole)


def linearizations(files: DataFrame) -> DataFrame:
    """Black, white, table and deltas of each file's main image, as arrays; no table or delta is null."""

    def read(c, ifd):
        kind = ifd.number(339, c.order, 1)
        lin = linearization(ifd, c.order, kind == 3)
        return (*lin["dims"], lin["black"], lin["white"], lin["lut"], lin["delta_h"], lin["delta_v"])

    return by_file(files, "rows int, cols int, black array<double>, white array<double>, lut array<double>, delta_h array<double>, delta_v array<double>", read)


def mosaics(files: DataFrame) -> DataFrame:
    """The mosaic of each file's main image; nulls where it has none."""

    def read(c, ifd):
        m = mosaic(ifd, c.order)
        return (*m["dims"], m["pattern"], m["split"], m["rows"], m["cols"]) if m else (None,) * 6

    return by_file(files, "high int, wide int, pattern array<int>, split int, row_interleave int, col_interleave int", read)


def areas(files: DataFrame) -> DataFrame:
    """The active area and the default crop of each file's main image, as (top, left, bottom, right); null where it has none."""

    def read(c, ifd):
        active = active_area(ifd, c.order)
        whole = active or (0, 0, ifd.scalar(257, c.order, 0), ifd.scalar(256, c.order, 0))
        crop = default_crop(ifd, c.order, whole)
        return list(active) if active else None, list(crop) if crop else None

    return by_file(files, "active array<int>, crop array<int>", read)


def profiles(files: DataFrame) -> DataFrame:
    """The camera profile in each file's first IFD."""

    def read(c, ifd):
        p = profile(c.ifds[0], c.order)
        sides = p["calibrations"]
        return (p["balance"], p["neutral"], p["white_xy"], p["exposure"], [x for xy in p["curve"] for x in xy], p["hue_dims"], [s["illuminant"] for s in sides], [s["color"] for s in sides], [s["forward"] for s in sides], [s["calibration"] for s in sides], [s["hue"] for s in sides])

    return by_file(files, "balance array<double>, neutral array<double>, white_xy array<double>, exposure double, curve array<double>, hue_dims array<int>, illuminants array<int>, color array<array<double>>, forward array<array<double>>, calibration array<array<double>>, hue array<array<double>>", read)


def packets(files: DataFrame) -> DataFrame:
    """The XMP packet (tag 700) of each file's first IFD, as bytes; null where it has none."""

    def read(c, ifd):
        e = c.ifds[0].find(700)
        return (e.payload if e is not None else None,)

    return by_file(files, "packet binary", read)


def numbers(files: DataFrame) -> DataFrame:
    """ifd_idx, tag, type, pos, value of all numbers in all tags; a rational over 0 is 0. Text and other bytes have none."""

    def read(c, ifd):
        return [(i, e.tag, e.type, k, v) for i, d in enumerate(c.ifds) for e in d.entries if e.type not in (2, 7) for k, v in enumerate(e.reals(c.order))]

    return by_file(files, "ifd_idx int, tag int, type int, pos int, value double", read)
