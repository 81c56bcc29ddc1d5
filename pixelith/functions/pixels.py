"""Per-sample and per-pixel maps as Column expressions: no operator here leaves whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of the default tone curve (fixed values).
SHADOW_LIFT, TOE = 0.03, 0.08
#: Luminance weights of red, green and blue (fixed values).
LUMA = (0.2126, 0.7152, 0.0722)


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over values that are worked out once: body gets a struct of them. Keeps deep expressions small."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body)[0]


def num(x: float) -> Column:
    return F.lit(float(x))


def table(values: Sequence[float]) -> Column:
    """A literal array of doubles, folded into the plan."""
    return F.array(*[num(v) for v in values])


def pick(values: Sequence[float], index: Column) -> Column:
    """values[index], 0-based."""
    return F.element_at(table(values), index.cast("int") + 1)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def linearize(sample: Column, *, black: Column | float = 0.0, white: float, least_black: float | None = None, lut: Sequence[float] | None = None, delta: Column | None = None) -> Column:
    """(LUT[sample] - black - delta) / (white - smallest black), no more than 1; what is below black stays negative."""
    floor = float(black) if least_black is None else least_black
    if white <= floor:
        raise ValueError("white level is not above black level")
    x = sample.cast("double")
    if lut is not None:
        x = pick(lut, F.floor(clamp(x, 0, len(lut) - 1)))
    level = black if isinstance(black, Column) else num(black)
    if delta is not None:
        level = level + delta
    return F.least((x - level) * num(1.0 / (white - floor)), num(1.0))


def black_cell(row: Column, col: Column, blacks: Sequence[float], rows: int, cols: int) -> Column:
    """The black level of a repeating cell of rows x cols; a short table repeats its last entry."""
    index = (row % rows) * cols + col % cols
    return pick(blacks, F.least(index, F.lit(len(blacks) - 1)))


def map_table(sample: Column, entries: Sequence[int]) -> Column:
    """A look-up; samples beyond the table take its last entry."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in entries]), F.least(sample, F.lit(len(entries) - 1)).cast("int") + 1)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """c0 + x * (c1 + |x| * (c2 + ...)), by Horner's rule on the magnitude, held in [-1, 1]."""
    if len(coefficients) > 9:
        raise ValueError("degree above 8")
    if len(coefficients) == 1:
        return clamp(num(coefficients[0]) + x * num(0.0), -1, 1)
    size = F.abs(x)
    total = num(coefficients[-1])
    for c in reversed(coefficients[1:-1]):
        total = num(c) + size * total
    return clamp(num(coefficients[0]) + x * total, -1, 1)


def table_step(position: Column, start: int, pitch: int, values: Sequence[float]) -> Column:
    """The entry of a per-row or per-column table for a position from `start` on; null outside."""
    index = F.floor((position - start) / pitch)
    return F.when((index >= 0) & (index < len(values)), pick(values, F.least(F.greatest(index, F.lit(0)), F.lit(len(values) - 1))))


def vignette(x: Column, row: Column, col: Column, bounds: tuple[int, int, int, int], center: tuple[float, float], k: Sequence[float]) -> Column:
    """x times 1 + k0 r^2 + ... + k4 r^10, no more than 1. center: (horizontal, vertical) fractions of the bounds."""
    if not any(k):
        return x
    top, left, bottom, right = bounds
    cr, cc = top + center[1] * (bottom - top), left + center[0] * (right - left)
    reach = max(abs(cr - top), abs(cr - bottom)) ** 2 + max(abs(cc - left), abs(cc - right)) ** 2
    dv, dh = row + num(0.5) - num(cr), col + num(0.5) - num(cc)
    r2 = F.least((dv * dv + dh * dh) * num(1.0 / reach), num(1.0))
    total = num(0.0)
    for c in reversed(list(k)):
        total = r2 * (num(c) + total)
    return F.least(x * (total + 1.0), num(1.0))


def grid_axis(position: Column, origin: float, spacing: float, points: int) -> tuple[Column, Column, Column]:
    """Lower and upper grid index and the fraction between them; the ends extend."""
    last = points - 1
    at = (position - num(origin)) / num(spacing)
    low = F.when(at <= 0, 0).when(at >= last, last).otherwise(F.floor(at)).cast("int")
    high = F.when(at <= 0, 0).when(at >= last, last).otherwise(F.floor(at) + 1).cast("int")
    return low, high, F.when((at <= 0) | (at >= last), num(0.0)).otherwise(at - F.floor(at))


def gain_map(x: Column, row: Column, col: Column, plane: Column, bounds: tuple[int, int, int, int], gains: Sequence[float], points: tuple[int, int, int], origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0)) -> Column:
    """x times a gain interpolated on a (vertical, horizontal, planes) grid over the unit square, no more than 1."""
    top, left, bottom, right = bounds
    nv, nh, np_ = points
    (ov, oh), (sv, sh) = origin, spacing
    if nv == 1:
        ov, sv = 0.0, 1.0
    if nh == 1:
        oh, sh = 0.0, 1.0
    r0, r1, fr = grid_axis((row + num(0.5) - num(top)) / num(bottom - top), ov, sv, nv)
    c0, c1, fc = grid_axis((col + num(0.5) - num(left)) / num(right - left), oh, sh, nh)
    p = F.least(plane, F.lit(np_ - 1))

    def at(r: Column, c: Column) -> Column:
        return pick(gains, (r * nh + c) * np_ + p)

    upper = at(r0, c0) * (num(1.0) - fc) + at(r0, c1) * fc
    lower = at(r1, c0) * (num(1.0) - fc) + at(r1, c1) * fc
    return F.least(x * (upper * (num(1.0) - fr) + lower * fr), num(1.0))


def matrix(rgb: Sequence[Column], m: Sequence[Sequence[float]], exposure: float = 0.0) -> list[Column]:
    """The 3 x 3 product, times 2 ** exposure."""
    scale = 2.0**exposure
    return [num(r[0] * scale) * rgb[0] + num(r[1] * scale) * rgb[1] + num(r[2] * scale) * rgb[2] for r in m]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue from 0 to 6, saturation and value."""
    v = F.greatest(r, g, b)
    gap = v - F.least(r, g, b)
    red = (g - b) / F.when(gap > 0, gap)
    hue = F.when(gap <= 0, num(0.0)).when(r == v, F.when(red < 0, red + 6.0).otherwise(red)).when(g == v, num(2.0) + (b - r) / F.when(gap > 0, gap)).otherwise(num(4.0) + (r - g) / F.when(gap > 0, gap))
    return hue, F.when(gap > 0, gap / F.when(gap > 0, v)).otherwise(num(0.0)), v


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    h = h % 6.0
    h = F.when(h < 0, h + 6.0).otherwise(h)
    sector = F.floor(h).cast("int")
    f = h - sector
    p, q, t = v * (num(1.0) - s), v * (num(1.0) - s * f), v * (num(1.0) - s * (num(1.0) - f))
    by_sector = {0: (v, t, p), 1: (q, v, p), 2: (p, v, t), 3: (p, q, v), 4: (t, p, v), 5: (v, p, q)}
    out = []
    for k in range(3):
        case = F.when(s <= 0, v)
        for i in range(1, 6):
            case = case.when(sector == i, by_sector[i][k])
        out.append(case.otherwise(by_sector[0][k]))
    return out


def hue_sat_map(rgb: Sequence[Column], deltas: Sequence[tuple[float, float, float]], divisions: tuple[int, int, int]) -> list[Column]:
    """Shifts hue (degrees) and scales saturation and value by a (hue, saturation, value) table; hue wraps around.

    deltas: in order of value, hue, saturation. With fewer than 2 value divisions value takes no part in the look-up.
    """
    nh, ns, nv = divisions
    h, s, v = rgb_to_hsv(*[F.greatest(c, num(0.0)) for c in rgb])

    def places(x: Column) -> Column:
        hs, ss, vs = x["h"] * num(0.0 if nh < 2 else nh / 6.0), x["s"] * num(ns - 1), x["v"] * num(max(nv - 1, 0))
        h0 = F.least(F.greatest(F.floor(hs), F.lit(0)), F.lit(nh - 1)).cast("int")
        s0 = F.least(F.greatest(F.floor(ss), F.lit(0)), F.lit(max(0, ns - 2))).cast("int")
        v0 = F.least(F.greatest(F.floor(vs), F.lit(0)), F.lit(max(0, nv - 2))).cast("int")
        at = {"h": x["h"], "s": x["s"], "v": x["v"], "h0": h0, "h1": F.when(h0 >= nh - 1, 0).otherwise(h0 + 1), "s0": s0, "s1": F.least(s0 + 1, F.lit(ns - 1)), "v0": v0, "v1": F.least(v0 + 1, F.lit(max(nv - 1, 0))), "fh": hs - h0, "fs": ss - s0, "fv": vs - v0}
        return bound(at, look)

    def look(x: Column) -> Column:
        planes = [("v0", num(1.0) - x["fv"]), ("v1", x["fv"])] if nv >= 2 else [("v0", None)]

        def entry(k: int) -> Column:
            flat = [d[k] for d in deltas]

            def side(si: str) -> Column:
                total = None
                for vi, weight in planes:
                    one = (num(1.0) - x["fh"]) * pick(flat, (x[vi] * nh + x["h0"]) * ns + x[si]) + x["fh"] * pick(flat, (x[vi] * nh + x["h1"]) * ns + x[si])
                    part = one if weight is None else weight * one
                    total = part if total is None else total + part
                return total

            return (num(1.0) - x["fs"]) * side("s0") + x["fs"] * side("s1")

        new = {"h": x["h"] + entry(0) * num(6.0 / 360.0), "s": F.least(x["s"] * entry(1), num(1.0)), "v": F.greatest(x["v"] * entry(2), num(0.0))}
        return bound(new, lambda y: F.array(*hsv_to_rgb(y["h"], y["s"], y["v"])))

    out = bound({"h": h, "s": s, "v": v}, places)
    return [out[i] for i in range(3)]


def tone_curve(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between the knots, constant outside."""
    case = F.when(x <= num(knots[0][0]), num(knots[0][1])).when(x >= num(knots[-1][0]), num(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))[1:]):
        case = case.when(x >= num(x0), num(y0) + (x - num(x0)) / num(x1 - x0) * num(y1 - y0))
    (x0, y0), (x1, y1) = knots[0], knots[1]
    return case.otherwise(num(y0) + (x - num(x0)) / num(x1 - x0) * num(y1 - y0))


def s_curve(x: Column) -> Column:
    return F.when(x <= 0, num(SHADOW_LIFT)).otherwise(num(SHADOW_LIFT) + num(1.0 - SHADOW_LIFT) * (num(1.0) / (num(1.0) + num(TOE) / (x * x))))


def tone_map(rgb: Sequence[Column], curve: Callable[[Column], Column] = s_curve) -> list[Column]:
    """The curve on luminance: each channel times new over old luminance, not below 0; grey where there is no light."""
    y = num(LUMA[0]) * rgb[0] + num(LUMA[1]) * rgb[1] + num(LUMA[2]) * rgb[2]
    new = curve(y)
    return [F.when(y <= 1e-8, new).otherwise(F.greatest(c * (new / y), num(0.0))) for c in rgb]


def reinhard(x: Column) -> Column:
    return F.when(x <= 0, num(0.0)).otherwise(x / (num(1.0) + x))


def hdr_encode(x: Column) -> Column:
    return F.when(x <= 0, x).otherwise(x * (num(256.0) + x) / (num(256.0) * (num(1.0) + x)))


def hdr_decode(y: Column) -> Column:
    b = num(256.0) - num(256.0) * y
    return F.when(y <= 0, y).otherwise((F.sqrt(b * b + num(1024.0) * y) - b) * 0.5)


def hdr_wrapped(x: Column, lookup: Callable[[Column], Column]) -> Column:
    return hdr_decode(lookup(hdr_encode(x)))


def srgb_gamma(x: Column) -> Column:
    return F.when(x <= num(0.0031308), x * 12.92).otherwise(num(1.055) * F.pow(F.greatest(x, num(0.0)), num(1.0 / 2.4)) - 0.055)


def quantize(x: Column) -> Column:
    """0 to 255 from gamma-coded [0, 1]."""
    return F.floor(srgb_gamma(clamp(x, 0, 1)) * 255.0 + 0.5).cast("int")


def on_white(value: Column, alpha: Column, most: float) -> Column:
    """An 8-bit value over white; alpha counts up to `most`."""
    a = clamp(alpha.cast("double") / num(most), 0, 1)
    return F.when(a >= 1, value).otherwise(F.floor(a * value + (num(1.0) - a) * 255.0 + 0.5).cast("int"))


def half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def kelvin_weight(kelvin: Column, low: float, high: float) -> Column:
    """Weight of the lower calibration illuminant, linear in 1 / kelvin, held in [0, 1]."""
    if low == high:
        return num(1.0)
    return clamp((num(1.0) / kelvin - num(1.0 / high)) / num(1.0 / low - 1.0 / high), 0, 1)


def illuminants(kelvin: Column, calibrated: Sequence[float]) -> tuple[Column, Column]:
    """Indexes of the calibrated illuminants around a temperature; beyond the ends the last one twice."""
    order = sorted(range(len(calibrated)), key=lambda i: calibrated[i])
    low, high = F.when(kelvin <= num(calibrated[order[0]]), order[0]), F.when(kelvin <= num(calibrated[order[0]]), order[0])
    low, high = low.when(kelvin >= num(calibrated[order[-1]]), order[-1]), high.when(kelvin >= num(calibrated[order[-1]]), order[-1])
    for a, b in zip(order, order[1:], strict=False):
        low, high = low.when(kelvin <= num(calibrated[b]), a), high.when(kelvin <= num(calibrated[b]), b)
    return low.otherwise(order[0]), high.otherwise(order[-1])


def light_source_kelvin(code: Column) -> Column:
    """Colour temperature of a light-source code (fixed values); others: 5000."""
    known = {0: 5000, 1: 5500, 2: 4000, 3: 2850, 10: 5500, 17: 2856, 18: 5503, 19: 6774, 20: 5503, 21: 6504, 22: 7504, 23: 5003, 24: 3200, 255: 5000}
    case = F.when(F.lit(False), num(0.0))
    for k, v in known.items():
        case = case.when(code == k, num(v))
    return case.otherwise(num(5000.0))


def collapse32(digest_hex: Column) -> Column:
    """Exclusive or of the four big-endian words of a 16-byte digest in hex."""
    words = [F.conv(F.substring(digest_hex, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return words[0].bitwiseXOR(words[1]).bitwiseXOR(words[2]).bitwiseXOR(words[3])


def exif_date(text: Column) -> dict[str, Column]:
    """Fields of 'YYYY:MM:DD HH:MM:SS' ('-' and 'T' are fine, too); null if out of range. Day 31 fits any month."""
    pattern = r"^\s*(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
    raw = {n: F.when(F.regexp_extract(text, pattern, i) != "", F.regexp_extract(text, pattern, i).cast("int")) for i, n in enumerate(("year", "month", "day", "hour", "minute", "second"), 1)}
    fine = raw["year"].between(1, 9999) & raw["month"].between(1, 12) & raw["day"].between(1, 31) & raw["hour"].between(0, 23) & raw["minute"].between(0, 59) & raw["second"].between(0, 59)
    return {n: F.when(fine, c) for n, c in raw.items()}


def rect_intersect(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """(top, left, bottom, right) of the overlap; all 0 where there is none."""
    t, l, bo, r = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    empty = (t >= bo) | (l >= r)
    return [F.when(empty, 0).otherwise(c) for c in (t, l, bo, r)]


def rect_union(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """The bounding box; an empty side gives way to the other."""
    ea, eb = (a[0] >= a[2]) | (a[1] >= a[3]), (b[0] >= b[2]) | (b[1] >= b[3])
    both = [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]
    return [F.when(ea, y).when(eb, x).otherwise(z) for x, y, z in zip(a, b, both, strict=True)]


def rect_contains(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether b lies inside a."""
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def rect_transpose(a: Sequence[Column]) -> list[Column]:
    """Rows for columns."""
    return [a[1], a[0], a[3], a[2]]


def iim_date(text: Column) -> dict[str, Column]:
    """Year, month and day of CCYYMMDD; null where the text doesn't begin with eight digits."""
    fine = text.rlike(r"^\d{8}")
    return {n: F.when(fine, F.substring(text, at, size).cast("int")) for n, at, size in (("year", 1, 4), ("month", 5, 2), ("day", 7, 2))}


def iim_time(text: Column) -> dict[str, Column]:
    """Hour, minute and second of HHMMSS, whatever follows; null where the text doesn't begin with six digits."""
    fine = text.rlike(r"^\d{6}")
    return {n: F.when(fine, F.substring(text, at, 2).cast("int")) for n, at in (("hour", 1), ("minute", 3), ("second", 5))}


def can_develop(photometric: Column, has_mosaic: Column) -> Column:
    """What a photometric code asks for: "pass", "demosaic", or null for what can't be developed (fixed codes)."""
    return F.when(photometric.isin(34892, 2), "pass").when((photometric == 32803) & has_mosaic, "demosaic")


def jxl_kind(data: Column) -> Column:
    """Whether bytes begin as a JPEG XL codestream or container."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FF0A"), "codestream").when(head == "0000000C4A584C200D0A870A", "container")


def ascii_text(payload: Column) -> Column:
    """The text of bytes up to the first NUL."""
    return F.substring_index(F.decode(payload, "UTF-8"), "\0", 1)


def tiff_to_dihedral(code: Column) -> Column:
    """Orientation codes 1 to 9 as elements of the dihedral group, 0 to 7 (8: unknown); others are 0 (fixed values)."""
    known = {1: 0, 2: 4, 3: 2, 4: 6, 5: 7, 6: 1, 7: 5, 8: 3, 9: 8}
    case = F.when(F.lit(False), 0)
    for k, v in known.items():
        case = case.when(code == k, v)
    return case.otherwise(0)


def dihedral_to_tiff(x: Column) -> Column:
    known = {0: 1, 1: 6, 2: 3, 3: 8, 4: 2, 5: 7, 6: 4, 7: 5, 8: 9}
    case = F.when(F.lit(False), 1)
    for k, v in known.items():
        case = case.when(x == k, v)
    return case.otherwise(1)


def dihedral_compose(a: Column, b: Column) -> Column:
    """First a, then b. Elements: quarter turns in the low two bits, a mirror in the third."""
    turned = F.when(b.bitwiseAND(4) != 0, F.when(a.bitwiseAND(1) != 0, a.bitwiseXOR(F.lit(6))).otherwise(a.bitwiseXOR(F.lit(4)))).otherwise(a)
    return (turned + b).bitwiseAND(3).bitwiseOR(turned.bitwiseAND(4))


def dihedral_inverse(a: Column) -> Column:
    x = F.when(a.bitwiseAND(5) == 5, a.bitwiseXOR(F.lit(2))).otherwise(a)
    return (F.lit(4) - x).bitwiseAND(3).bitwiseOR(x.bitwiseAND(4))


def backward_version(flags: dict[str, Column]) -> Column:
    """The oldest reader version, as major * 1000 + minor * 100 + patch * 10 (1.7.1 is 1710), that a file's features allow."""
    parts = [F.lit(1000)]
    needs = {1300: ("opcodes",), 1400: ("float_pixels", "deflate", "lossy_jpeg", "proxy"), 1500: ("depth_map", "enhanced"), 1600: ("semantic_mask", "third_illuminant"), 1700: ("jxl", "gain_table_2", "hdr_profile", "image_stats", "image_sequence"), 1710: ("column_interleave",)}
    for version, names in needs.items():
        for n in names:
            if n in flags:
                parts.append(F.when(flags[n], version).otherwise(1000))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]
