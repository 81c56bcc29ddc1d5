"""The queries over the bound images, each with the SQL that must agree with it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelith.functions import colour
from pixelith.functions import pixels as P
from pixelith.operators import raster as R
from pixelith.operators import tone
from pixelith.operators import warp as W
from pixelith.plans import bindings as B
from pixelith.plans.bindings import BLACK, BOUNDS, DYADIC, GRID, HEIGHT, LINEAR, MOSAIC, PLANES, RGB, WHITE, WIDTH, arr, d, q, sql_q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


AT = ["image_id", "row", "col"]
WITH = "WITH "
ROW = '"row"'
MATRIX = [[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]]
POLY = [0.01, 0.9, -0.05, 0.12]
VIGNETTE = [0.3, -0.05, 0.02, 0.01, -0.004]
GAINS = [1.0, 1.1, 1.25, 0.9, 1.0, 1.05, 1.2, 1.15, 0.95]
KNOTS = [(0.0, 0.0), (0.18, 0.25), (0.5, 0.62), (0.8, 0.9), (1.0, 1.0)]
POINTS, RECTS = [(3, 5), (10, 20), (50, 33), (99, 63), (0, 0)], [(20, 10, 23, 13), (60, 40, 61, 50)]
CONSTANT = 2048


def linear(spark: SparkSession, sf: str) -> DataFrame:
    px = B.mosaic_pixels(spark, sf)
    return px.select("image_id", "row", "col", "plane", P.linearize(F.col("value"), black=BLACK, white=WHITE).alias("value"))


def dyadic_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = B.mosaic_lines(spark, sf)
    return lines.withColumn("vals", F.transform("vals", lambda v: F.floor(P.linearize(v, black=BLACK, white=WHITE) * GRID) / GRID))


# --- linearization ---------------------------------------------------------------------------------------------


@query(WITH + LINEAR + f' SELECT image_id, "row", col, {sql_q("x")} AS v FROM lin')
def linearize_mosaic(spark, sf):
    return linear(spark, sf).select(*AT, q(F.col("value")).alias("v"))


CELL = [60.0, 62.0, 66.0, 71.0]


@query(WITH + MOSAIC + f""" SELECT image_id, "row", col, {sql_q(f'least((value - list_extract({arr(CELL)}, ("row" % 2) * 2 + col % 2 + 1)) * {d(1 / (WHITE - 60.0))}, {d(1)})')} AS v FROM rb1""")
def linearize_repeat_black(spark, sf):
    px = B.mosaic_pixels(spark, sf)
    black = P.black_cell(F.col("row"), F.col("col"), CELL, 2, 2)
    return px.select(*AT, q(P.linearize(F.col("value"), black=black, white=WHITE, least_black=min(CELL))).alias("v"))


LUT = [float(round(4095 * math.sqrt(i / 4095))) for i in range(0, 4096, 32)]


@query(
    WITH
    + MOSAIC
    + f""" SELECT image_id, "row", col, {sql_q(f'least((list_extract({arr(LUT)}, CAST(floor(least(greatest(CAST(value // 32 AS DOUBLE), {d(0)}), {d(len(LUT) - 1)})) AS INT) + 1) - (({d(BLACK)}) + (CASE WHEN "row" < 80 THEN ("row" % 3) * {d(0.25)} ELSE {d(0)} END + CASE WHEN col < 60 THEN (col % 5) * {d(0.5)} ELSE {d(0)} END))) * {d(1 / (WHITE - BLACK))}, {d(1)})')} AS v FROM rb1"""
)
def linearize_lut_delta(spark, sf):
    px = B.mosaic_pixels(spark, sf)
    rows, cols = [0.25 * (i % 3) for i in range(80)], [0.5 * (i % 5) for i in range(60)]
    delta = F.coalesce(P.table_step(F.col("row"), 0, 1, rows), F.lit(0.0)) + F.coalesce(P.table_step(F.col("col"), 0, 1, cols), F.lit(0.0))
    x = P.linearize(F.expr("value div 32"), white=WHITE - BLACK, lut=LUT, delta=F.lit(BLACK) + delta)
    return px.select(*AT, q(x).alias("v"))


# --- demosaic --------------------------------------------------------------------------------------------------

OFFSETS = "off AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {d(0.25 if r and c else 0.5)})" for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c) + ") o(dr, dc, w))"


def wrapped(e: str, size: int) -> str:
    return f"CASE WHEN {e} < 0 THEN {e} + 2 WHEN {e} >= {size} THEN {size - 2} + ({e} - {size}) % 2 ELSE {e} END"


def demosaic_sql(pattern: list[int]) -> str:
    def colour_at(r: str, c: str) -> str:
        return f"list_extract({pattern}, (({r}) & 1) * 2 + (({c}) & 1) + 1)"

    return (
        WITH
        + DYADIC
        + f""", {OFFSETS}, near AS (SELECT p.image_id, p."row", p.col, {colour_at('p."row" + dr', 'p.col + dc')} AS ch, sum(w * n.x) / sum(w) AS x
 FROM dy p CROSS JOIN off JOIN dy n ON n.image_id = p.image_id AND n."row" = {wrapped('(p."row" + dr)', HEIGHT)} AND n.col = {wrapped('(p.col + dc)', WIDTH)} GROUP BY ALL),
 bo AS (SELECT image_id, "row", col, ch, x FROM near WHERE ch <> {colour_at('"row"', 'col')} UNION ALL SELECT image_id, "row", col, {colour_at('"row"', 'col')}, x FROM dy),
 wide AS (SELECT image_id, "row", col, max(x) FILTER (WHERE ch = 0) AS r, max(x) FILTER (WHERE ch = 1) AS g, max(x) FILTER (WHERE ch = 2) AS b FROM bo GROUP BY ALL)"""
    )


def demosaiced(spark: SparkSession, sf: str, pattern=(0, 1, 1, 2)) -> DataFrame:
    """The last image of a table may have fewer lines than the others."""
    return R.demosaic(dyadic_lines(spark, sf), pattern, (HEIGHT, WIDTH))


for _name, _pattern in {"demosaic_bilinear": [0, 1, 1, 2], "demosaic_grbg": [1, 0, 2, 1], "demosaic_bggr": [2, 1, 1, 0]}.items():
    query(demosaic_sql(_pattern) + f' SELECT image_id, "row", col, {sql_q("r")} AS r, {sql_q("g")} AS g, {sql_q("b")} AS b FROM wide', _name)(
        lambda spark, sf, pattern=tuple(_pattern): demosaiced(spark, sf, pattern).select(*AT, *[q(F.col(c)).alias(c) for c in "rgb"])
    )


# --- in-place corrections --------------------------------------------------------------------------------------

AREA = {"rect": (10, 4, 90, 60), "pitch": (2, 3)}
IN_AREA = '("row" BETWEEN 10 AND 89 AND col BETWEEN 4 AND 59 AND ("row" - 10) % 2 = 0 AND (col - 4) % 3 = 0)'
TABLE16 = [min(65535, i * i // 64) for i in range(0, 3000, 25)]


@query(WITH + MOSAIC + f""" SELECT image_id, "row", col, CAST(CASE WHEN {IN_AREA} THEN list_extract({TABLE16}, least(value // 25, {len(TABLE16) - 1}) + 1) ELSE value // 25 END AS BIGINT) AS v FROM rb1""")
def map_table(spark, sf):
    px = B.mosaic_pixels(spark, sf).withColumn("value", F.expr("cast(value div 25 as int)"))
    return px.select(*AT, F.when(R.area(BOUNDS, **AREA), P.map_table(F.col("value"), TABLE16)).otherwise(F.col("value")).cast("long").alias("v"))


def in_place(name: str, spark_expr: Callable[[Column], Column], sql_expr: str, *, area: bool = False) -> None:
    sql = f"CASE WHEN {IN_AREA} THEN {sql_expr} ELSE x END" if area else sql_expr

    def run(spark, sf):
        new = spark_expr(F.col("value"))
        return linear(spark, sf).select(*AT, q(F.when(R.area(BOUNDS, **AREA), new).otherwise(F.col("value")) if area else new).alias("v"))

    query(WITH + LINEAR + f' SELECT image_id, "row", col, {sql_q(sql)} AS v FROM lin', name)(run)


def clamp_sql(e: str, lo: float = -1, hi: float = 1) -> str:
    return f"least(greatest({e}, {d(lo)}), {d(hi)})"


in_place("map_polynomial", lambda x: P.polynomial(x, POLY), clamp_sql(f"{d(POLY[0])} + x * ({d(POLY[1])} + abs(x) * ({d(POLY[2])} + abs(x) * {d(POLY[3])}))"), area=True)
DELTAS, SCALES = [0.01 * (i % 7) - 0.03 for i in range(40)], [0.8 + 0.05 * (i % 9) for i in range(30)]


def step_sql(at: str, start: int, pitch: int, values: list[float], then: str) -> str:
    index = f"(({at} - {start}) // {pitch})"
    return f"CASE WHEN {at} >= {start} AND {index} < {len(values)} THEN {clamp_sql(then.format(v=f'list_extract({arr(values)}, {index} + 1)'))} ELSE x END"


for _name, _at, _values, _form in (
    ("delta_per_row", "row", DELTAS, "x + {v}"),
    ("delta_per_column", "col", DELTAS, "x + {v}"),
    ("scale_per_row", "row", SCALES, "x * {v}"),
    ("scale_per_column", "col", SCALES, "x * {v}"),
):

    def _run(x: Column, at=_at, values=tuple(_values), plus="+" in _form) -> Column:
        v = P.table_step(F.col(at), 6, 2, values)
        return F.when(v.isNotNull(), P.clamp(x + v if plus else x * v, -1, 1)).otherwise(x)

    in_place(_name, _run, step_sql(f'"{_at}"', 6, 2, _values, _form))

_cr, _cc = 0.45 * HEIGHT, 0.55 * WIDTH
_reach = max(abs(_cr), abs(_cr - HEIGHT)) ** 2 + max(abs(_cc), abs(_cc - WIDTH)) ** 2
_r2 = f'least((("row" + {d(0.5)} - {d(_cr)}) * ("row" + {d(0.5)} - {d(_cr)}) + (col + {d(0.5)} - {d(_cc)}) * (col + {d(0.5)} - {d(_cc)})) * {d(1 / _reach)}, {d(1)})'
_horner = d(0)
for _k in reversed(VIGNETTE):
    _horner = f"({_r2}) * ({d(_k)} + {_horner})"
in_place("vignette_radial", lambda x: P.vignette(x, F.col("row"), F.col("col"), BOUNDS, (0.55, 0.45), VIGNETTE), f"least(x * ({_horner} + {d(1)}), {d(1)})")


def axis_sql(e: str, points: int, spacing: float) -> tuple[str, str, str]:
    at, last = f"(({e}) / {d(spacing)})", points - 1
    return f"CAST(CASE WHEN {at} <= 0 THEN 0 WHEN {at} >= {last} THEN {last} ELSE floor({at}) END AS INT)", f"CAST(CASE WHEN {at} <= 0 THEN 0 WHEN {at} >= {last} THEN {last} ELSE floor({at}) + 1 END AS INT)", f"(CASE WHEN {at} <= 0 OR {at} >= {last} THEN {d(0)} ELSE {at} - floor({at}) END)"


_r0, _r1, _fr = axis_sql(f'("row" + {d(0.5)} - {d(0)}) / {d(HEIGHT)} - {d(0.1)}', 3, 0.4)
_c0, _c1, _fc = axis_sql(f"(col + {d(0.5)} - {d(0)}) / {d(WIDTH)} - {d(0.05)}", 3, 0.45)


def gain_sql(x: str, gains: list[float]) -> str:
    """x times the gain of a 3 x 3 grid."""
    low, high = (f"list_extract({arr(gains)}, {r} * 3 + {_c0} + 1) * ({d(1)} - {_fc}) + list_extract({arr(gains)}, {r} * 3 + {_c1} + 1) * {_fc}" for r in (_r0, _r1))
    return f"least({x} * (({low}) * ({d(1)} - {_fr}) + ({high}) * {_fr}), {d(1)})"


in_place("gain_map", lambda x: P.gain_map(x, F.col("row"), F.col("col"), F.col("plane"), BOUNDS, GAINS, (3, 3, 1), (0.1, 0.05), (0.4, 0.45)), gain_sql("x", GAINS))


# --- selection -------------------------------------------------------------------------------------------------


@query(WITH + MOSAIC + ' SELECT image_id, "row" - 8 AS "row", col - 4 AS col, CAST(value AS BIGINT) AS v FROM rb1 WHERE "row" BETWEEN 8 AND 91 AND col BETWEEN 4 AND 59')
def crop(spark, sf):
    return R.crop(B.mosaic_pixels(spark, sf), 8, 4, 92, 60).select(*AT, F.col("value").cast("long").alias("v"))


@query(WITH + MOSAIC + ' SELECT image_id, "row" - 1 AS "row", col - 2 AS col, CAST(value AS BIGINT) AS v FROM rb1 WHERE "row" BETWEEN 1 AND 98 AND col BETWEEN 2 AND 61')
def trim_bounds(spark, sf):
    return R.trim_bounds(B.mosaic_pixels(spark, sf), (1, 2, 99, 62), BOUNDS).select(*AT, F.col("value").cast("long").alias("v"))


@query(WITH + MOSAIC + f' SELECT image_id, "row", col, CAST(value AS BIGINT) AS v FROM rb1 WHERE {IN_AREA}')
def area_spec(spark, sf):
    return B.mosaic_pixels(spark, sf).where(R.area(BOUNDS, **AREA)).select(*AT, F.col("value").cast("long").alias("v"))


def fix_sql(bad: str) -> str:
    pairs = ", ".join([f"(1, {r}, {c})" for r, c in ((-1, -1), (-1, 1), (1, -1), (1, 1))] + [f"(0, {r}, {c})" for r, c in ((-2, 0), (2, 0), (0, -2), (0, 2))])
    return (
        WITH
        + MOSAIC
        + f""", px AS (SELECT *, {bad} AS bad FROM rb1), off AS (SELECT * FROM (VALUES {pairs}) o(green, dr, dc)),
 fixed AS (SELECT p.image_id, p."row", p.col, sum(n.value) AS s, count(*) AS n FROM px p JOIN off ON off.green = 1 - (p."row" + p.col) % 2
 JOIN px n ON n.image_id = p.image_id AND n."row" = p."row" + dr AND n.col = p.col + dc AND NOT n.bad WHERE p.bad GROUP BY ALL)
 SELECT p.image_id, p."row", p.col, CAST(CASE WHEN f.n = 4 THEN (f.s + 2) // 4 WHEN f.n > 0 THEN (f.s + f.n // 2) // f.n ELSE p.value END AS BIGINT) AS v
 FROM px p LEFT JOIN fixed f ON f.image_id = p.image_id AND f."row" = p."row" AND f.col = p.col"""
    )


@query(fix_sql(f"value = {CONSTANT}"))
def bad_pixels_constant(spark, sf):
    return R.fix_constant(B.mosaic_pixels(spark, sf), CONSTANT).select(*AT, F.col("value").cast("long").alias("v"))


_listed = " OR ".join([f'("row" = {r} AND col = {c})' for r, c in POINTS] + [f'("row" BETWEEN {t} AND {b - 1} AND col BETWEEN {l} AND {r - 1})' for t, l, b, r in RECTS])


@query(fix_sql(f"({_listed})"))
def bad_pixels_list(spark, sf):
    return R.fix_list(B.mosaic_pixels(spark, sf), POINTS, RECTS).select(*AT, F.col("value").cast("long").alias("v"))


# --- colour ----------------------------------------------------------------------------------------------------

KEY = ["l_orderkey", "l_linenumber"]


def on_rgb(name: str, f: Callable[[list[Column]], list[Column]], sql: list[str], *, extra: str = "", names: str = "rgb", scale: float = 1e6, source: str = "rb3") -> None:
    def run(spark, sf):
        out = f([F.col(c) for c in "rgb"])
        return B.rgb(spark, sf).select(*KEY, *[q(c, scale).alias(n) for c, n in zip(out, names, strict=True)])

    query(WITH + RGB + extra + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql_q(e, scale)} AS {n}" for e, n in zip(sql, names, strict=True)) + f" FROM {source}", name)(run)


def matrix_sql(m, exposure: float = 0.0) -> list[str]:
    s = 2.0**exposure
    return [f"{d(r[0] * s)} * r + {d(r[1] * s)} * g + {d(r[2] * s)} * b" for r in m]


for _space in colour.OUTPUT:
    _m = colour.to_output(_space, MATRIX).tolist()
    on_rgb(f"color_matrix_{_space}", lambda c, m=_m: P.matrix(c, m, 0.5), matrix_sql(_m, 0.5))

HSV_SQL = f""", h1 AS (SELECT *, greatest(r, {d(0)}) AS r0, greatest(g, {d(0)}) AS g0, greatest(b, {d(0)}) AS b0 FROM rb3), h2 AS (SELECT *, greatest(r0, g0, b0) AS v, greatest(r0, g0, b0) - least(r0, g0, b0) AS gap FROM h1),
 h3 AS (SELECT *, CASE WHEN gap <= 0 THEN {d(0)} WHEN r0 = v THEN CASE WHEN (g0 - b0) / gap < 0 THEN (g0 - b0) / gap + {d(6)} ELSE (g0 - b0) / gap END WHEN g0 = v THEN {d(2)} + (b0 - r0) / gap ELSE {d(4)} + (r0 - g0) / gap END AS h, CASE WHEN gap > 0 THEN gap / v ELSE {d(0)} END AS s FROM h2)"""
_rgb_of = {0: "vtp", 1: "qvp", 2: "pvt", 3: "pqv", 4: "tpv", 5: "vpq"}
HSV_BACK = (
    f""", k1 AS (SELECT *, CASE WHEN h % {d(6)} < 0 THEN h % {d(6)} + {d(6)} ELSE h % {d(6)} END AS hh FROM k0), k2 AS (SELECT *, CAST(floor(hh) AS INT) AS i, hh - floor(hh) AS f FROM k1),
 k3 AS (SELECT *, v * ({d(1)} - s) AS p, v * ({d(1)} - s * f) AS q, v * ({d(1)} - s * ({d(1)} - f)) AS t FROM k2), k4 AS (SELECT l_orderkey, l_linenumber, """
    + ", ".join(f"CASE WHEN s <= 0 THEN v {' '.join(f'WHEN i = {i} THEN {_rgb_of[i][k]}' for i in range(1, 6))} ELSE {_rgb_of[0][k]} END AS {n}" for k, n in enumerate("rgb"))
    + " FROM k3)"
)


def deltas(nh: int, ns: int, nv: int) -> list[tuple[float, float, float]]:
    return [(4.0 * math.sin(i), 1.0 + 0.1 * math.cos(i), 1.0 + 0.05 * math.sin(2 * i)) for i in range(nh * ns * max(nv, 1))]


def hue_sat_sql(nh: int, ns: int, nv: int) -> str:
    table = deltas(nh, ns, nv)
    vs = [("v0", f"({d(1)} - fv)"), ("v1", "fv")] if nv >= 2 else [("0", "")]

    def entry(k: int) -> str:
        flat = arr([t[k] for t in table])

        def side(s: str) -> str:
            parts = []
            for v, w in vs:
                one = f"(({d(1)} - fh) * list_extract({flat}, ({v} * {nh} + ih0) * {ns} + {s} + 1) + fh * list_extract({flat}, ({v} * {nh} + ih1) * {ns} + {s} + 1))"
                parts.append(f"{w} * {one}" if w else one)
            return "(" + " + ".join(parts) + ")"

        return f"(({d(1)} - fs) * {side('is0')} + fs * {side('is1')})"

    val = f", CAST(least(greatest(floor(v * {d(nv - 1)}), 0), {max(0, nv - 2)}) AS INT) AS v0" if nv >= 2 else ", 0 AS v0"
    return (
        HSV_SQL
        + f""", j0 AS (SELECT *, h * {d(0 if nh < 2 else nh / 6)} AS hs, s * {d(ns - 1)} AS ss FROM h3), j1 AS (SELECT *, CAST(least(greatest(floor(hs), 0), {nh - 1}) AS INT) AS ih0, CAST(least(greatest(floor(ss), 0), {max(0, ns - 2)}) AS INT) AS is0{val} FROM j0),
 j2 AS (SELECT *, CASE WHEN ih0 >= {nh - 1} THEN 0 ELSE ih0 + 1 END AS ih1, least(is0 + 1, {ns - 1}) AS is1, least(v0 + 1, {max(nv - 1, 0)}) AS v1, hs - ih0 AS fh, ss - is0 AS fs, v * {d(max(nv - 1, 0))} - v0 AS fv FROM j1),
 k0 AS (SELECT l_orderkey, l_linenumber, h + {entry(0)} * {d(6 / 360)} AS h, least(s * {entry(1)}, {d(1)}) AS s, greatest(v * {entry(2)}, {d(0)}) AS v FROM j2)"""
        + HSV_BACK
    )


on_rgb("rgb_hsv", lambda c: list(P.rgb_to_hsv(*c)), ["h", "s", "v"], extra=HSV_SQL, names="hsv", source="h3")
for _name, _div in {"hue_sat_map_2d": (6, 4, 1), "hue_sat_map_3d": (6, 3, 4)}.items():
    _sql = WITH + RGB + hue_sat_sql(*_div) + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql_q(x, 1e5)} AS {x}" for x in "rgb") + " FROM k4"
    query(_sql, _name)(lambda spark, sf, div=_div: tone.hue_sat(B.rgb(spark, sf), deltas(*div), div).select(*KEY, *[q(F.col(c), 1e5).alias(c) for c in "rgb"]))


def curve_sql(x: str) -> str:
    parts = [f"WHEN {x} <= {d(KNOTS[0][0])} THEN {d(KNOTS[0][1])} WHEN {x} >= {d(KNOTS[-1][0])} THEN {d(KNOTS[-1][1])}"]
    for (x0, y0), (x1, y1) in reversed(list(zip(KNOTS, KNOTS[1:], strict=False))):
        parts.append(f"WHEN {x} >= {d(x0)} THEN {d(y0)} + ({x} - {d(x0)}) / {d(x1 - x0)} * {d(y1 - y0)}")
    return "CASE " + " ".join(parts) + " END"


on_rgb("tone_curve", lambda c: [P.tone_curve(x, KNOTS) for x in c], [curve_sql(x) for x in "rgb"])


#: The pieces of the curve (from, to, knot, its value, slope): constant before the first knot and after the last.
PIECES = [(-math.inf, KNOTS[0][0], *KNOTS[0], 0.0), *((a, b, a, x, (y - x) / (b - a)) for (a, x), (b, y) in zip(KNOTS, KNOTS[1:], strict=False)), (KNOTS[-1][0], math.inf, *KNOTS[-1], 0.0)]


@query(WITH + RGB + ", k AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(d, p)) + ")" for p in PIECES) + f") t(lo, hi, x0, y0, slope)) SELECT l_orderkey, l_linenumber, {sql_q('y0 + CASE WHEN slope = 0 THEN 0 ELSE (r - x0) * slope END')} AS r FROM rb3 JOIN k ON r >= lo AND r < hi")
def tone_curve_join(spark, sf):
    """The curve as an interval join against its few pieces, a table of fixed size that covers every number."""
    pieces = spark.createDataFrame(PIECES, "lo double, hi double, x0 double, y0 double, slope double")
    joined = B.rgb(spark, sf).join(F.broadcast(pieces), (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return joined.select(*KEY, q(F.expr("y0 + case when slope = 0 then 0 else (r - x0) * slope end")).alias("r"))


def s_curve_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN {d(0.03)} ELSE {d(0.03)} + {d(1 - 0.03)} * ({d(1)} / ({d(1)} + {d(0.08)} / ({x} * {x}))) END"


LUMA_SQL = f", y0 AS (SELECT *, {d(0.2126)} * r + {d(0.7152)} * g + {d(0.0722)} * b AS y FROM rb3), y1 AS (SELECT *, {s_curve_sql('y')} AS ny FROM y0)"
on_rgb("scurve_tonemap", lambda c: P.tone_map(c), [f"CASE WHEN y <= {d(1e-8)} THEN ny ELSE greatest({x} * (ny / y), {d(0)}) END" for x in "rgb"], extra=LUMA_SQL, source="y1")
on_rgb("scurve", lambda c: [P.s_curve(x) for x in c], [s_curve_sql(x) for x in "rgb"])
on_rgb("reinhard", lambda c: [P.reinhard(x * 4.0) for x in c], [f"CASE WHEN {x} * {d(4)} <= 0 THEN {d(0)} ELSE {x} * {d(4)} / ({d(1)} + {x} * {d(4)}) END" for x in "rgb"])


def encode_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN {x} ELSE {x} * ({d(256)} + {x}) / ({d(256)} * ({d(1)} + {x})) END"


on_rgb("hdr_encode", lambda c: [P.hdr_encode(x * 8.0) for x in c], [encode_sql(f"({x} * {d(8)})") for x in "rgb"])
on_rgb("hdr_encode_decode", lambda c: [P.hdr_decode(P.hdr_encode(x * 8.0)) for x in c], [f"{x} * {d(8)}" for x in "rgb"])
on_rgb("hdr_wrapped_curve", lambda c: [P.hdr_wrapped(x, lambda y: y) for x in c], list("rgb"))


def gamma_sql(x: str) -> str:
    c = f"least(greatest({x}, {d(0)}), {d(1)})"
    return f"CASE WHEN {c} <= {d(0.0031308)} THEN {c} * {d(12.92)} ELSE {d(1.055)} * pow({c}, {d(1 / 2.4)}) - {d(0.055)} END"


def quantize_sql(x: str) -> str:
    return f"CAST(floor(({gamma_sql(x)}) * {d(255)} + {d(0.5)}) AS INT)"


on_rgb("srgb_gamma", lambda c: [P.srgb_gamma(P.clamp(x, 0, 1)) for x in c], [gamma_sql(x) for x in "rgb"])


@query(WITH + RGB + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"{quantize_sql(x)} AS {x}" for x in "rgb") + " FROM rb3")
def gamma_quantize(spark, sf):
    return B.rgb(spark, sf).select(*KEY, *[P.quantize(F.col(c)).alias(c) for c in "rgb"])


_alpha = "(l_orderkey * 7 + l_linenumber * 13) % 256"


@query(
    WITH + RGB + f", m AS (SELECT *, CAST({_alpha} AS DOUBLE) / {d(255)} AS a FROM rb3) SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(CASE WHEN a >= 1 THEN {quantize_sql(x)} ELSE floor(a * {quantize_sql(x)} + ({d(1)} - a) * {d(255)} + {d(0.5)}) END AS INT) AS {x}" for x in "rgb") + " FROM m"
)
def mask_composite(spark, sf):
    px = B.rgb(spark, sf).select(*KEY, *[P.quantize(F.col(c)).alias(c) for c in "rgb"])
    return px.select(*KEY, *[P.on_white(F.col(c), F.expr(_alpha), 255.0).alias(c) for c in "rgb"])


# --- masks, statistics, layouts --------------------------------------------------------------------------------

_open = 1500


@query(WITH + MOSAIC + f' SELECT image_id, min("row") AS top, min(col) AS "left", max("row") + 1 AS bottom, max(col) + 1 AS "right" FROM rb1 WHERE value >= {2600} GROUP BY image_id')
def opaque_bbox(spark, sf):
    return R.opaque_box(B.mosaic_pixels(spark, sf), 2600.5)


#: One step a side: the edge of the rectangle that is tested, and how it moves.
_sides = [("t", "t", "t + 1", "l", "r", "t + 1"), ("b", "b - 1", "b", "l", "r", "b - 1"), ("l", "t", "b", "l", "l + 1", "l + 1"), ("r", "t", "b", "r - 1", "r", "r - 1")]


def _peel_sql(threshold: float) -> str:
    """Rounds as a recursion of four steps each; holes of an edge by a table of sums."""

    def holes(t: str, b: str, l: str, r: str) -> str:
        def corner(y: str, x: str) -> str:
            return f"coalesce(list_extract(list_extract(s, {y}), {x}), 0)"

        return f"({corner(b, r)} - {corner(t, r)} - {corner(b, l)} + {corner(t, l)})"

    steps, before = [], "t0"
    for k, (side, t, b, l, r, moved) in enumerate(_sides, 1):
        hit = f"(t < b AND l < r AND {holes(t, b, l, r)} > 0)"
        keep = ", ".join(f"CASE WHEN {hit} THEN {moved} ELSE {side} END AS {side}" if x == side else x for x in "tblr")
        steps.append(f"t{k} AS (SELECT image_id, s, n, {keep}, again OR {hit} AS again FROM {before})")
        before = f"t{k}"
    return (
        "WITH RECURSIVE "
        + MOSAIC
        + f""", hole AS (SELECT image_id, "row" AS y, col AS x, CASE WHEN value >= {threshold} THEN 0 ELSE 1 END AS h FROM rb1),
 line AS (SELECT image_id, y, x, sum(h) OVER (PARTITION BY image_id, x ORDER BY y) AS down FROM hole), area AS (SELECT image_id, y, x, sum(down) OVER (PARTITION BY image_id, y ORDER BY x) AS a FROM line),
 rows_ AS (SELECT image_id, y, list(CAST(a AS BIGINT) ORDER BY x) AS v FROM area GROUP BY image_id, y), tables AS (SELECT image_id, list(v ORDER BY y) AS s, count(*) AS h, max(len(v)) AS w FROM rows_ GROUP BY image_id),
 run(image_id, s, n, t, b, l, r, again) AS (SELECT image_id, s, 0, CAST(0 AS BIGINT), CAST(h AS BIGINT), CAST(0 AS BIGINT), CAST(w AS BIGINT), true FROM tables
 UNION ALL (WITH t0 AS (SELECT image_id, s, n + 1 AS n, t, b, l, r, false AS again FROM run WHERE again AND t < b AND l < r), """
        + ", ".join(steps)
        + """ SELECT image_id, s, n, t, b, l, r, again FROM t4))
 SELECT image_id, CAST(arg_max(t, n) AS INT) AS top, CAST(arg_max(l, n) AS INT) AS "left", CAST(arg_max(b, n) AS INT) AS bottom, CAST(arg_max(r, n) AS INT) AS "right" FROM run GROUP BY image_id HAVING arg_max(t, n) < arg_max(b, n) AND arg_max(l, n) < arg_max(r, n)"""
    )


@query(_peel_sql(40))
def opaque_rect_greedy(spark, sf):
    """Peeling depends on its own rounds."""
    return R.opaque_rect(B.mosaic_pixels(spark, sf), 40.5)


@query(WITH + MOSAIC + " SELECT image_id, count(*) AS n, min(value) AS least, max(value) AS most, CAST(sum(value) AS BIGINT) AS total FROM rb1 GROUP BY image_id")
def image_stats(spark, sf):
    return R.image_stats(B.mosaic_pixels(spark, sf))


@query(WITH + PLANES + ' SELECT image_id, "row", col, max(value) FILTER (WHERE plane = 0) AS r, coalesce(max(value) FILTER (WHERE plane = 1), -1) AS g, coalesce(max(value) FILTER (WHERE plane = 2), -1) AS b FROM rb2 GROUP BY ALL')
def planes_to_wide(spark, sf):
    """The last pixel of a row has one plane only; what it lacks shows as -1."""
    return R.to_wide(B.plane_pixels(spark, sf)).na.fill(-1, ["g", "b"])


@query(WITH + PLANES + ' SELECT image_id, "row", col, plane, value, CAST(("row" * 22 + col) * 3 + plane AS INT) AS "offset" FROM rb2')
def planar_to_interleaved(spark, sf):
    return R.planar_to_interleaved(B.plane_pixels(spark, sf), 3).select("image_id", "row", "col", "plane", "value", F.col("offset").cast("int"))


@query(WITH + MOSAIC + ' SELECT image_id, "row", col, value FROM rb1')
def scanline_roundtrip(spark, sf):
    return R.to_pixels(R.to_scanlines(B.mosaic_pixels(spark, sf))).select(*AT, "value")


@query(WITH + MOSAIC + ' SELECT image_id, "row", col, CAST(value AS BIGINT) AS v FROM rb1')
def predictor_hdiff(spark, sf):
    """Differences two samples apart, undone by running sums: the table itself again."""
    px = B.mosaic_lines(spark, sf)
    step = 2
    coded = px.withColumn("vals", F.transform("vals", lambda v, i: F.pmod(v - F.when(i >= step, F.element_at(F.col("vals"), F.greatest(i - step + 1, F.lit(1)))).otherwise(0), F.lit(65536))))
    return R.to_pixels(R.undo_differences(coded, step, 16)).select(*AT, F.col("value").alias("v"))


@query(WITH + MOSAIC + ' SELECT image_id, "row", col, CAST(sum(value) OVER (PARTITION BY image_id, "row", col % 3 ORDER BY col) % 65536 AS BIGINT) AS v FROM rb1')
def predictor_window(spark, sf):
    return R.undo_differences_pixels(B.mosaic_pixels(spark, sf), 3, 16).select(*AT, F.col("value").cast("long").alias("v"))


def _stored_line(e: str, size: int, k: int) -> str:
    return f"(({e} % {k}) * {size // k} + least({e} % {k}, {size % k}) + {e} // {k})"


@query(WITH + MOSAIC + f', dst AS (SELECT image_id, "row", col FROM rb1) SELECT d.image_id, d."row", d.col, CAST(s.value AS BIGINT) AS v FROM dst d JOIN rb1 s ON s.image_id = d.image_id AND s."row" = {_stored_line("d." + ROW, HEIGHT, 3)} AND s.col = {_stored_line("d.col", WIDTH, 5)}')
def row_col_deinterleave(spark, sf):
    return R.deinterleave_lines(B.mosaic_lines(spark, sf), 3, 5, HEIGHT, WIDTH).select(*AT, F.col("value").cast("long").alias("v"))


@query('SELECT p_partkey, CAST(r * 3 + c AS INT) AS tile, CAST(r * 40 AS INT) AS top, CAST(c * 24 AS INT) AS "left", CAST(least((r + 1) * 40, 100) AS INT) AS bottom, CAST(least((c + 1) * 24, 64) AS INT) AS "right" FROM part, range(3) a(r), range(3) b(c)')
def tile_grid(spark, sf):
    return R.tiles(100, 64, 40, 24, B.read(spark, sf, "part").select("p_partkey"))


# --- warps -----------------------------------------------------------------------------------------------------

WARPS = {
    "warp_rectilinear": W.Rectilinear([1.0, -0.08, 0.02, -0.005], (0.003, -0.002), (0.48, 0.53)),
    "warp_rectilinear2": W.Rectilinear2([1.0, 0.02, -0.05, 0.01], (0.0, 0.0), (0.5, 0.5), (0.1, 0.9), True),
    "warp_fisheye": W.Fisheye([1.0, 0.12, -0.03, 0.0], (0.0, 0.0), (0.5, 0.5)),
}


def warp_sql(p: W.Rectilinear) -> str:
    ch, cv = WIDTH * p.center[0], HEIGHT * p.center[1]
    reach = max(math.hypot(cv - y, ch - x) for y in (0, HEIGHT) for x in (0, WIDTH))
    if isinstance(p, W.Fisheye):
        k = p.radial
        ratio = f"CASE WHEN r2 < {d(1e-12)} THEN {d(1)} ELSE atan(sqrt(r2)) * ({d(k[0])} + pow(atan(sqrt(r2)), 2) * ({d(k[1])} + pow(atan(sqrt(r2)), 2) * ({d(k[2])} + pow(atan(sqrt(r2)), 2) * {d(k[3])}))) / sqrt(r2) END"
    elif isinstance(p, W.Rectilinear2):
        r = f"sqrt(least(greatest(r2, {d(p.valid[0] ** 2)}), {d(p.valid[1] ** 2)}))"
        ratio = d(p.radial[-1])
        for k in reversed(p.radial[:-1]):
            ratio = f"(({ratio}) * {r} + {d(k)})"
        ratio = f"{d(1)} / {ratio}" if p.reciprocal else ratio
    else:
        k = p.radial
        ratio = f"{d(k[0])} + r2 * ({d(k[1])} + r2 * ({d(k[2])} + r2 * {d(k[3])}))"
    k0, k1 = p.tangential
    if k0 or k1:
        pv = f"{d(cv)} + {d(reach)} * (nv * ratio + ({d(k0)} * (r2 + {d(2)} * (nv * nv)) + {d(2 * k1)} * nh * nv))"
        ph = f"{d(ch)} + {d(reach)} * (nh * ratio + ({d(k1)} * (r2 + {d(2)} * (nh * nh)) + {d(2 * k0)} * nh * nv))"
    else:
        pv, ph = f"{d(cv)} + dv * ratio", f"{d(ch)} + dh * ratio"

    def kernel(x: str) -> str:
        return f"(CASE WHEN abs({x}) >= 2 THEN {d(0)} WHEN abs({x}) >= 1 THEN (({d(-0.75)} * abs({x}) + {d(3.75)}) * abs({x}) - {d(6)}) * abs({x}) + {d(3)} ELSE ({d(1.25)} * abs({x}) - {d(2.25)}) * abs({x}) * abs({x}) + {d(1)} END)"

    def window(e: str, n: str, most: int) -> str:
        first = f"(floor({e}) - 1)"
        return f"CAST(least(greatest({first}, 0), {most}) AS INT) AS {n}0, CASE WHEN {first} < 0 OR {first} > {most} THEN {d(0)} ELSE floor(({e} - floor({e})) * 32) / {d(32)} END AS {n}f"

    return (
        WITH
        + LINEAR
        + f""", w1 AS (SELECT image_id, "row", col, plane, "row" - {d(cv)} AS dv, col - {d(ch)} AS dh FROM lin), w2 AS (SELECT *, dv * {d(1 / reach)} AS nv, dh * {d(1 / reach)} AS nh FROM w1),
 w3 AS (SELECT *, least(nv * nv + nh * nh, {d(1)}) AS r2 FROM w2), w4 AS (SELECT *, {ratio} AS ratio FROM w3), w5 AS (SELECT image_id, "row", col, plane, least(greatest({pv}, 0), {HEIGHT - 1}) AS sv, least(greatest({ph}, 0), {WIDTH - 1}) AS sh FROM w4),
 w6 AS (SELECT image_id, "row", col, plane, {window('sv', 'v', HEIGHT - 5)}, {window('sh', 'h', WIDTH - 5)} FROM w5),
 w7 AS (SELECT w6.image_id, w6."row", w6.col, n.x, {kernel('(i - 1 - vf)')} * {kernel('(j - 1 - hf)')} AS w FROM w6, range(4) a(i), range(4) b(j), lin n WHERE n.image_id = w6.image_id AND n."row" = v0 + i AND n.col = h0 + j)
 SELECT image_id, "row", col, CAST(floor(sum(w * x) / sum(w) * {d(1e4)} + {d(0.5)}) AS BIGINT) AS v FROM w7 GROUP BY image_id, "row", col"""
    )


for _name, _p in WARPS.items():
    query(warp_sql(_p), _name)(lambda spark, sf, p=_p: W.warp(linear(spark, sf), BOUNDS, p).select(*AT, q(F.col("value"), 1e4).alias("v")))


# --- metadata scalars ------------------------------------------------------------------------------------------

KELVIN = f"({d(2000)} + (p_retailprice - {d(900)}) * {d(60)})"
CALIBRATED = [6504.0, 2856.0, 5003.0]


def kelvin() -> Column:
    return F.lit(2000.0) + (F.col("p_retailprice") - 900.0) * 60.0


@query(f"SELECT p_partkey, {sql_q(f'least(greatest(({d(1)} / {KELVIN} - {d(1 / 6504.0)}) / {d(1 / 2856.0 - 1 / 6504.0)}, {d(0)}), {d(1)})')} AS w FROM part")
def cct_interpolation(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", q(P.kelvin_weight(kelvin(), 2856.0, 6504.0)).alias("w"))


@query(f"SELECT p_partkey, CASE WHEN {KELVIN} <= 2856 THEN 1 WHEN {KELVIN} >= 6504 THEN 0 WHEN {KELVIN} <= 5003 THEN 1 ELSE 2 END AS low, CASE WHEN {KELVIN} <= 2856 THEN 1 WHEN {KELVIN} >= 6504 THEN 0 WHEN {KELVIN} <= 5003 THEN 2 ELSE 0 END AS high FROM part")
def illuminant_pick(spark, sf):
    low, high = P.illuminants(kelvin(), CALIBRATED)
    return B.read(spark, sf, "part").select("p_partkey", low.cast("int").alias("low"), high.cast("int").alias("high"))


ISO = ", ".join(f"({i}, {d(r)}, {d(u)}, {d(v)}, {d(t)})" for i, (r, u, v, t) in enumerate(colour.ISOTHERMS))


@query(
    f"""WITH iso AS (SELECT *, lead(r) OVER (ORDER BY i) AS r1, lead(u) OVER (ORDER BY i) AS u1, lead(v) OVER (ORDER BY i) AS v1 FROM (VALUES {ISO}) t(i, r, u, v, s)), k AS (SELECT p_partkey, {d(1e6)} / {KELVIN} AS m FROM part),
 f AS (SELECT p_partkey, (r1 - m) / (r1 - r) AS f, u, u1, v, v1 FROM k JOIN iso ON r1 IS NOT NULL AND (m >= r OR i = 0) AND (m < r1 OR i = 29)), uv AS (SELECT p_partkey, u * f + u1 * ({d(1)} - f) AS u, v * f + v1 * ({d(1)} - f) AS v FROM f)
 SELECT p_partkey, {sql_q(f'{d(1.5)} * u / (u - {d(4)} * v + {d(2)})')} AS x, {sql_q(f'v / (u - {d(4)} * v + {d(2)})')} AS y FROM uv"""
)
def robertson_cct(spark, sf):
    """Chromaticities on the line of black bodies: an interval join with the isotherms, a table of 31 rows."""
    rows = [(a[0], b[0], a[1], b[1], a[2], b[2], i) for i, (a, b) in enumerate(zip(colour.ISOTHERMS, colour.ISOTHERMS[1:], strict=False))]
    iso = spark.createDataFrame([tuple(map(float, r[:6])) + (r[6],) for r in rows], "r0 double, r1 double, u0 double, u1 double, v0 double, v1 double, i int")
    m = B.read(spark, sf, "part").select("p_partkey", (F.lit(1e6) / kelvin()).alias("m"))
    j = m.join(F.broadcast(iso), ((F.col("m") >= F.col("r0")) | (F.col("i") == 0)) & ((F.col("m") < F.col("r1")) | (F.col("i") == 29)))
    f = F.expr("(r1 - m) / (r1 - r0)")
    j = j.withColumn("f", f).withColumns({"u": F.expr("u0 * f + u1 * (1D - f)"), "v": F.expr("v0 * f + v1 * (1D - f)")})
    return j.select("p_partkey", q(F.expr("1.5D * u / (u - 4D * v + 2D)")).alias("x"), q(F.expr("v / (u - 4D * v + 2D)")).alias("y"))


@query("SELECT p_partkey, CASE p_size % 26 WHEN 1 THEN 5500 WHEN 2 THEN 4000 WHEN 3 THEN 2850 WHEN 10 THEN 5500 WHEN 17 THEN 2856 WHEN 18 THEN 5503 WHEN 19 THEN 6774 WHEN 20 THEN 5503 WHEN 21 THEN 6504 WHEN 22 THEN 7504 WHEN 23 THEN 5003 WHEN 24 THEN 3200 ELSE 5000 END AS kelvin FROM part")
def light_source(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", P.light_source_kelvin(F.col("p_size") % 26).cast("int").alias("kelvin"))


@query("""WITH o AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM range(8) x(a), range(8) y(b)), t AS (SELECT a, b, CASE WHEN b & 4 <> 0 THEN CASE WHEN a & 1 <> 0 THEN xor(a, 6) ELSE xor(a, 4) END ELSE a END AS x, CASE WHEN a & 5 = 5 THEN xor(a, 2) ELSE a END AS y FROM o)
 SELECT a, b, ((x + b) & 3) | (x & 4) AS composed, ((4 - y) & 3) | (y & 4) AS inverse, list_extract([1, 6, 3, 8, 2, 7, 4, 5], a + 1) AS code FROM t""")
def orientation_compose(spark, sf):
    eight = spark.range(8).select(F.col("id").cast("int").alias("a"))
    both = eight.crossJoin(eight.select(F.col("a").alias("b")))
    return both.select("a", "b", P.dihedral_compose(F.col("a"), F.col("b")).alias("composed"), P.dihedral_inverse(F.col("a")).alias("inverse"), P.dihedral_to_tiff(F.col("a")).alias("code"))


@query("SELECT o_orderkey, greatest(1000, CASE WHEN o_orderkey % 2 = 0 THEN 1300 ELSE 0 END, CASE WHEN o_orderkey % 3 = 0 THEN 1400 ELSE 0 END, CASE WHEN o_orderkey % 5 = 0 THEN 1500 ELSE 0 END, CASE WHEN o_orderkey % 7 = 0 THEN 1600 ELSE 0 END, CASE WHEN o_orderkey % 11 = 0 THEN 1700 ELSE 0 END, CASE WHEN o_orderkey % 13 = 0 THEN 1710 ELSE 0 END) AS version FROM orders")
def backward_version(spark, sf):
    k = F.col("o_orderkey")
    flags = {n: k % m == 0 for n, m in {"opcodes": 2, "deflate": 3, "depth_map": 5, "semantic_mask": 7, "jxl": 11, "column_interleave": 13}.items()}
    return B.read(spark, sf, "orders").select("o_orderkey", P.backward_version(flags).alias("version"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderkey % 4) * 1000000000 - o_orderkey) AS source_key, CAST(max(o_orderkey % 4) AS INT) AS rank FROM orders WHERE o_orderkey % 4 > 0 GROUP BY o_custkey")
def gain_table_precedence(spark, sf):
    """The highest rank wins, the first of equals; rank 0 is none. An aggregate, so it combines before its shuffle."""
    o = B.read(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("rank")).where("rank > 0")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("rank", -F.col("o_orderkey"))).alias("source_key"), F.max("rank").cast("int").alias("rank"))


@query("SELECT o_custkey, min_by(o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1000000000 END + o_orderkey) AS profile FROM orders GROUP BY o_custkey")
def profile_selection(spark, sf):
    """The first profile of standard range, else the first."""
    o = B.read(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "O", "o_orderkey")).alias("profile"))


@query("SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(floor(second(ts)) AS INT) AS second FROM events")
def exif_datetime_roundtrip(spark, sf):
    e = B.read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("text"))
    return e.select("event_id", *[c.alias(n) for n, c in P.exif_date(F.col("text")).items()])


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def fingerprint_md5(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents) SELECT doc_id, xor(xor(CAST('0x' || m[1:8] AS BIGINT), CAST('0x' || m[9:16] AS BIGINT)), xor(CAST('0x' || m[17:24] AS BIGINT), CAST('0x' || m[25:32] AS BIGINT))) AS folded FROM h")
def fingerprint_collapse32(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", P.collapse32(F.md5(F.coalesce("text", F.lit("")))).alias("folded"))


@query("SELECT p_partkey, greatest(p_size, 10) AS t, least(p_size + 20, 40) AS b, CAST(floor(p_retailprice / '7.0'::DOUBLE + '0.5'::DOUBLE) AS BIGINT) AS rounded, (p_size + 6) // 7 AS tiles FROM part WHERE greatest(p_size, 10) < least(p_size + 20, 40)")
def rect_geometry(spark, sf):
    p = B.read(spark, sf, "part")
    t, _, b, _ = P.rect_intersect([F.col("p_size"), F.lit(0), F.col("p_size") + 20, F.lit(5)], [F.lit(10), F.lit(0), F.lit(40), F.lit(5)])
    return p.select("p_partkey", t.alias("t"), b.alias("b"), P.half_away(F.col("p_retailprice") / 7.0).alias("rounded"), F.expr("cast((p_size + 6) div 7 as int)").alias("tiles")).where("t < b")


# --- end to end ------------------------------------------------------------------------------------------------

RENDER = colour.to_output("srgb", MATRIX).tolist()


def render(spark: SparkSession, sf: str) -> DataFrame:
    """Linearize, demosaic, matrix and exposure, tone curve, tone map, gamma, 8 bits: one projection after the stencil."""
    px = demosaiced(spark, sf)
    c = P.matrix([F.col(x) for x in "rgb"], RENDER, 0.25)
    px = px.select(*AT, *[x.alias(n) for x, n in zip(c, "rgb", strict=True)])
    px = px.select(*AT, *[P.tone_curve(F.col(x), KNOTS).alias(x) for x in "rgb"])
    px = px.select(*AT, *[x.alias(n) for x, n in zip(P.tone_map([F.col(x) for x in "rgb"]), "rgb", strict=True)])
    return px.select(*AT, *[P.quantize(F.col(x)).alias(x) for x in "rgb"])


_render_sql = (
    demosaic_sql([0, 1, 1, 2])
    + ', m1 AS (SELECT image_id, "row", col, '
    + ", ".join(f"{e} AS {n}" for e, n in zip(matrix_sql(RENDER, 0.25), "rgb", strict=True))
    + ' FROM wide), m2 AS (SELECT image_id, "row", col, '
    + ", ".join(f"{curve_sql(x)} AS {x}" for x in "rgb")
    + f" FROM m1), m3 AS (SELECT *, {d(0.2126)} * r + {d(0.7152)} * g + {d(0.0722)} * b AS y FROM m2), m4 AS (SELECT *, {s_curve_sql('y')} AS ny FROM m3), m5 AS (SELECT image_id, \"row\", col, "
    + ", ".join(f"CASE WHEN y <= {d(1e-8)} THEN ny ELSE greatest({x} * (ny / y), {d(0)}) END AS {x}" for x in "rgb")
    + " FROM m4)"
)


@query(_render_sql + ' SELECT image_id, "row", col, ' + ", ".join(f"{quantize_sql(x)} AS {x}" for x in "rgb") + " FROM m5")
def pipeline_render(spark, sf):
    return render(spark, sf)


@query(demosaic_sql([0, 1, 1, 2]) + ", u AS (SELECT image_id, 0 AS plane, " + quantize_sql("r") + " AS v FROM wide UNION ALL SELECT image_id, 1, " + quantize_sql("g") + " FROM wide UNION ALL SELECT image_id, 2, " + quantize_sql("b") + " FROM wide) SELECT image_id, plane, count(*) AS n, min(v) AS least, max(v) AS most, CAST(sum(v) AS BIGINT) AS total FROM u GROUP BY ALL")
def render_stats(spark, sf):
    """The flagship: linearize, demosaic, gamma and 8 bits, then statistics of each plane of each image."""
    px = demosaiced(spark, sf).select("image_id", *[P.quantize(F.col(x)).alias(x) for x in "rgb"])
    flat = px.select("image_id", F.posexplode(F.array("r", "g", "b")).alias("plane", "value"))
    return R.image_stats(flat, "plane")
