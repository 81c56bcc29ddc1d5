"""Queries over containers that are made from table rows: readers of every kind, scalar functions, rendering with masks.
Importing adds them to the catalog."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelith.functions import algebra as A
from pixelith.functions import colour
from pixelith.functions import pixels as P
from pixelith.operators import raster as R
from pixelith.operators import tone
from pixelith.operators import warp as W
from pixelith.plans import bindings as B
from pixelith.plans import develop as D
from pixelith.plans import opcodes as O
from pixelith.plans.bindings import BOUNDS, LINEAR, MOSAIC, PLANES, RGB, d, q, sql_q
from pixelith.plans.catalog import AT, HSV_BACK, HSV_SQL, ISO, KEY, VIGNETTE, WITH, deltas, demosaic_sql, demosaiced, hue_sat_sql, linear, matrix_sql, quantize_sql, query, s_curve_sql
from pixelith.plans.containers import SAME, _files
from pixelith.sources import codecs, metadata, synthetic, tiff


def filled(sql: str, **instead: int | str):
    """query() whose nulls show as other values: in the columns that are named, here and in the SQL."""
    replaced = ", ".join(f'coalesce("{n}", {v!r}) AS "{n}"' for n, v in instead.items())

    def add(f):
        def run(spark, sf):
            return f(spark, sf).na.fill(instead)

        run.__doc__ = f.__doc__
        query(f"SELECT * REPLACE ({replaced}) FROM ({sql}) x", f.__name__)(run)
        return f

    return add


def made(df: DataFrame, make: Callable[..., bytes], key: str, *columns: str) -> DataFrame:
    """(file_id, content): a container for each row, from its values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b[key], "content": [make(*row) for row in b[[key, *columns]].itertuples(index=False)]})

    return df.select(key, *columns).mapInPandas(run, "file_id long, content binary")


def tiny(*extra: tiff.Entry, order: str = "<", sub_type: int = 0, kind: str = "u1") -> tiff.Page:
    return tiff.image_page(np.zeros((2, 2, 1), kind), order=order, sub_type=sub_type, extra=list(extra))


def parts(spark, sf: str) -> DataFrame:
    return B.read(spark, sf, "part")


# --- containers ------------------------------------------------------------------------------------------------


def wide_container(key: int, size: int) -> bytes:
    """A container of 64-bit offsets, made by hand: two numbers inline, four outside."""
    order = "<" if key % 2 else ">"
    out = struct.pack(order + "HHHQ", 43, 8, 0, 16)
    entries = [(256, 4, 1, struct.pack(order + "I4x", key)), (257, 16, 1, struct.pack(order + "Q", size)), (258, 4, 4, struct.pack(order + "Q", 16 + 8 + 60 + 8))]
    body = struct.pack(order + "Q", 3) + b"".join(struct.pack(order + "HHQ", t, k, n) + v for t, k, n, v in entries) + bytes(8)
    return (b"II" if order == "<" else b"MM") + out + body + struct.pack(order + "4I", size, size + 1, size + 2, size + 3)


@query("SELECT p_partkey AS file_id, t AS tag, CAST(pos AS INT) AS pos, CAST(CASE t WHEN 256 THEN p_partkey WHEN 257 THEN p_size ELSE p_size + pos END AS BIGINT) AS v FROM part, (VALUES (256, 1), (257, 1), (258, 4)) k(t, n), range(4) r(pos) WHERE pos < n")
def ifd_entries_64(spark, sf):
    """Containers of 64-bit offsets, in either byte order."""
    found = metadata.numbers(made(parts(spark, sf), wide_container, "p_partkey", "p_size"))
    return found.select("file_id", "tag", "pos", F.col("value").cast("long").alias("v"))


def chained(key: int) -> bytes:
    """1 to 3 chained IFDs of 0 to 3 sub-IFDs each, and a sub-IFD at place 0, which is passed over."""
    pages, o = [], "<" if key % 2 else ">"
    for i in range(1 + key % 3):
        page = tiny(tiff.entry(37500, 4, key * 100 + i * 10, o), order=o, sub_type=0 if i == 0 else 1)
        page.subs = [tiny(tiff.entry(37500, 4, key * 100 + i * 10 + j, o), order=o, sub_type=4 if j == 1 else 0x10004) for j in range(1, 1 + key % 4)]
        pages.append(page)
    return tiff.write(pages, o)


CHAIN_SQL = """chain AS (SELECT c_custkey AS file_id, CAST(i * (1 + c_custkey % 4) + j AS INT) AS ifd_idx, CASE WHEN j > 0 THEN CAST(i * (1 + c_custkey % 4) AS INT) END AS parent_idx,
 CASE WHEN j = 0 AND i = 0 THEN 'main' WHEN j = 0 THEN 'preview' WHEN j = 1 THEN 'mask' ELSE 'semantic' END AS role, c_custkey * 100 + i * 10 + j AS mark FROM customer, range(3) a(i), range(4) b(j) WHERE i < 1 + c_custkey % 3 AND j < 1 + c_custkey % 4)"""


@filled(WITH + CHAIN_SQL + " SELECT * FROM chain", parent_idx=-1)
def ifd_chain(spark, sf):
    """The chain and its sub-IFDs, flattened: each top-level one, then its own."""
    e = tiff.entries(made(B.read(spark, sf, "customer"), chained, "c_custkey"))
    mark = tiff.whole(F.col("payload"), F.col("type"), F.col("big_endian"))
    return e.where("tag = 37500").select("file_id", "ifd_idx", "parent_idx", "role", mark.alias("mark"))


@query(WITH + CHAIN_SQL + """, one AS (SELECT file_id, count(*) AS ifds, count(*) FILTER (WHERE parent_idx IS NULL) AS top_level, min(ifd_idx) FILTER (WHERE role = 'main') AS main, string_agg(CAST(ifd_idx AS VARCHAR), ',' ORDER BY ifd_idx) FILTER (WHERE role = 'preview') AS previews, string_agg(CAST(ifd_idx AS VARCHAR), ',' ORDER BY ifd_idx) FILTER (WHERE role = 'mask') AS masks FROM chain GROUP BY file_id)
 SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'MM' ELSE 'II' END AS byte_order, 32 AS offset_bits, ifds, top_level, main, coalesce(previews, '') AS previews, coalesce(masks, '') AS masks, CAST(2 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, CAST(1 AS BIGINT) AS compression, CAST(1 AS BIGINT) AS photometric FROM one""")
def file_summary(spark, sf):
    """A row for each file: order, IFDs, roles, size and compression of the main image."""
    s = tiff.summary(tiff.entries(made(B.read(spark, sf, "customer"), chained, "c_custkey")))
    listed = {n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in ("previews", "masks")}
    return s.select("file_id", "byte_order", "offset_bits", "ifds", "top_level", "main", *listed.values(), "width", "height", "compression", "photometric")


@query(WITH + CHAIN_SQL + " SELECT file_id, role, min(ifd_idx) AS ifd_idx FROM chain WHERE role <> 'semantic' GROUP BY file_id, role")
def first_of_role(spark, sf):
    """The first IFD of each role."""
    e = tiff.entries(made(B.read(spark, sf, "customer"), chained, "c_custkey"))
    return e.where("role <> 'semantic'").groupBy("file_id", "role").agg(F.min("ifd_idx").alias("ifd_idx"))


BROKEN_SQL = {0: "NULL", 1: "'no TIFF header'", 2: "'tag 254 has 0 values'", 3: "'IFD chain goes in a circle'", 4: "'more than 10 chained IFDs'", 5: "'tag 254 has no whole number'", 6: "'value outside the file'"}


def broken(key: int) -> bytes:
    """Whole files, and files broken in six ways."""
    case = key % 7
    if case == 1:
        return b"II*"
    if case in (2, 5):
        return tiff.write([tiff.Page([tiff.Entry(254, 4, 0, b"") if case == 2 else tiff.entry(254, 5, [(1, 1)])])])
    if case == 4:
        return tiff.write([tiny() for _ in range(11)])
    data = bytearray(tiff.write([tiny(tiff.entry(37500, 7, bytes(9)))]))
    first = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, first)[0]
    if case == 3:
        struct.pack_into("<I", data, first + 2 + 12 * n, first)
    if case == 6:
        at = next(first + 2 + 12 * i for i in range(n) if struct.unpack_from("<H", data, first + 2 + 12 * i)[0] == 37500)
        struct.pack_into("<I", data, at + 8, 1 << 30)
    return bytes(data)


@filled("SELECT p_partkey AS file_id, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in BROKEN_SQL.items()) + " END AS error, p_partkey % 7 = 0 AS whole FROM part", error='')
def broken_files(spark, sf):
    """Broken files among whole ones: a row with the error each, and no failure."""
    e = tiff.entries(made(parts(spark, sf), broken, "p_partkey"))
    return e.groupBy("file_id").agg(F.max("error").alias("error"), F.count("tag").alias("n")).select("file_id", "error", (F.col("n") > 0).alias("whole"))


@query("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 7 = 0 THEN CAST(4 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS samples FROM part")
def broken_files_skipped(spark, sf):
    """The samples of whole files; broken ones are left out on request."""
    files = made(parts(spark, sf), broken, "p_partkey")
    px = tiff.samples(files, on_error="skip").groupBy(F.col("image_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    return files.select("file_id").join(px, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("long").alias("samples"))


def typed(key: int, size: int) -> bytes:
    """A tag of each number type, in either byte order."""
    o = "<" if key % 2 else ">"
    tags = [tiff.entry(40001, 1, [size, 255], o), tiff.entry(40003, 3, [size, 65535, key % 65536], o), tiff.entry(40004, 4, [key, 4294967295], o), tiff.entry(40005, 5, [(size, 4), (key, 0)], o), tiff.entry(40006, 6, [-size], o), tiff.entry(40008, 8, [-size, 7], o), tiff.entry(40009, 9, [-key], o), tiff.entry(40010, 10, [(-size, 8)], o), tiff.entry(40011, 11, [size / 2], o), tiff.entry(40012, 12, [size / 3], o), tiff.entry(40002, 2, f"part {key}\0rest", o)]
    return tiff.write([tiny(*tags, order=o)], o)


@query("""WITH t AS (SELECT p_partkey AS file_id, unnest([40001, 40001, 40003, 40003, 40003, 40004, 40004, 40005, 40005, 40006, 40008, 40008, 40009, 40010, 40011, 40012]) AS tag, unnest([0, 1, 0, 1, 2, 0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0]) AS pos,
 unnest([CAST(p_size AS DOUBLE), 255, p_size, 65535, p_partkey % 65536, p_partkey, 4294967295, p_size / 4, 0, -p_size, -p_size, 7, -p_partkey, -p_size / 8, p_size / 2, p_size / 3]) AS value FROM part) SELECT file_id, tag, pos, """ + sql_q("value") + " AS v FROM t")
def tag_numbers(spark, sf):
    """Numbers of every type in either byte order; a rational over 0 is 0."""
    found = metadata.numbers(made(parts(spark, sf), typed, "p_partkey", "p_size")).where("tag > 40000")
    return found.select("file_id", "tag", "pos", q(F.col("value")).alias("v"))


@query("SELECT p_partkey AS file_id, 'part ' || p_partkey AS text FROM part")
def ascii_tags(spark, sf):
    """Text up to the first NUL, in the JVM."""
    e = tiff.entries(made(parts(spark, sf), typed, "p_partkey", "p_size")).where("tag = 40002")
    return e.select("file_id", P.ascii_text(F.col("payload")).alias("text"))


@query("""SELECT p_partkey AS file_id, tag, CASE tag WHEN 256 THEN '[2]' WHEN 40100 THEN '"p' || p_size || '\\"\\x0A"' WHEN 40101 THEN '[' || p_size || ', 1, 2, 3, 4, 5, 6, 7, … (+3 more)]'
 WHEN 40102 THEN '<9 bytes: 00 01 02 03 04 05 06 07 08>' WHEN 40103 THEN '[-' || p_size || '/4 (' || CASE WHEN p_size % 4 = 0 THEN CAST(-p_size // 4 AS VARCHAR) ELSE rtrim(CAST(CAST(-p_size / 4 AS DECIMAL(9, 2)) AS VARCHAR), '0') END || ')]' END AS text FROM part, (VALUES (256), (40100), (40101), (40102), (40103)) t(tag)""")
def tag_dump(spark, sf):
    """Tags as text: quoted, in brackets, eight elements at most, rationals worked out."""

    def make(key: int, size: int) -> bytes:
        return tiff.write([tiny(tiff.entry(40100, 2, f'p{size}"\n'), tiff.entry(40101, 3, [size, *range(1, 11)]), tiff.entry(40102, 7, bytes(range(9))), tiff.entry(40103, 10, [(-size, 4)]))])

    return metadata.dump(made(parts(spark, sf), make, "p_partkey", "p_size")).where("tag = 256 or tag > 40000").select("file_id", "tag", "text")


@query("SELECT p_partkey AS file_id, tag, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY tag) AS INT) AS place FROM part, (VALUES (254), (256), (257), (258), (259), (262), (273), (277), (278), (279), (284), (339), (700), (40000), (50000)) t(tag)")
def tags_in_order(spark, sf):
    """Written tags are sorted, whatever order they are given in."""
    files = made(parts(spark, sf), lambda key: tiff.write([tiny(tiff.entry(50000, 4, key), tiff.entry(700, 7, b"x"), tiff.entry(40000, 4, key))]), "p_partkey")
    return tiff.entries(files).select("file_id", "tag", (F.col("entry_ord") + 1).alias("place"))


@query("SELECT tag, CAST(count(*) AS BIGINT) AS files FROM part, (VALUES (40005), (40012)) t(tag) WHERE p_partkey % 5 = 0 GROUP BY tag")
def tags_missing(spark, sf):
    """Tags of one set of files that the other lacks: a set difference."""
    both = [tiff.entries(made(parts(spark, sf).where(f"p_partkey % 5 {op} 0"), f, "p_partkey", "p_size")) for op, f in (("=", typed), ("<>", lambda key, size: tiff.write([tiny(*[tiff.entry(t, 4, size) for t in (40001, 40002, 40003, 40004, 40006, 40008, 40009, 40010, 40011)])])))]
    missing = both[0].select("tag").distinct().subtract(both[1].select("tag").distinct())
    return both[0].join(missing, "tag", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


@query(SAME)
def rewrite_roundtrip(spark, sf):
    """Containers written again, and read."""
    px = tiff.samples(tiff.rewritten(tiff.build(B.mosaic_pixels(spark, sf), rows_per_strip=9)))
    return px.select(*AT, F.col("value").cast("long").alias("v"))


@filled("WITH n AS (SELECT DISTINCT vec_id // 100 AS file_id FROM embeddings) SELECT file_id, CASE WHEN file_id % 9 BETWEEN 2 AND 8 THEN CAST(file_id % 9 AS BIGINT) END AS orientation, CAST(1 AS BIGINT) AS photometric, CAST(100 AS BIGINT) AS height FROM n", orientation=0)
def orientation_tags(spark, sf):
    """The orientation that a stage is written with."""
    px = B.mosaic_pixels(spark, sf)
    turned = px.select("image_id").distinct().withColumn("orientation", (F.col("image_id") % 9).cast("int"))
    found = tiff.numbers(tiff.entries(tiff.build(px, orientation=turned, size=(B.HEIGHT, B.WIDTH))), {"orientation": 274, "photometric": 262, "height": 257})
    return found.select("file_id", "orientation", "photometric", "height")


KINDS = ["u1", "u2", "i2", "f2", "u4", "f4"]


@query(WITH + MOSAIC + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in KINDS) + f') t(kind)) SELECT kind, image_id, "row", col, CAST(value % 200 AS BIGINT) AS v FROM rb1, k')
def sample_types(spark, sf):
    """Every sample type there and back, half floats too."""
    px = B.mosaic_pixels(spark, sf).withColumn("value", F.col("value") % 200)
    out = None
    for k in KINDS:
        one = tiff.samples(tiff.build(px, k, rows_per_strip=33)).select(F.lit(k).alias("kind"), *AT, F.col("value").cast("long").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


CODES = [(1, "NULL"), (8, "NULL"), (7, "NULL"), *((c, f"'compression {c} ({n}) is not supported'") for c, n in codecs.UNSUPPORTED.items()), (99, "'compression 99 (unknown) is not supported'")]


@filled("SELECT r_regionkey, code, error, CASE WHEN error IS NULL THEN CAST(6 * r_regionkey + 15 AS BIGINT) END AS total FROM region, (VALUES " + ", ".join(f"({c}, {e})" for c, e in CODES) + ") t(code, error)", error='', total=-1)
def codec_registry(spark, sf):
    """A strip of each compression code: its decoder, or the error of a code without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["r_regionkey"].tolist():
                strip = (np.arange(6).reshape(2, 3, 1) + key).astype("u2")
                coded = {codecs.RAW: codecs.encode_raw(strip), codecs.DEFLATE: codecs.encode_deflate(strip), codecs.JPEG: codecs.encode_lossless_jpeg(strip)}
                for code, _ in CODES:
                    try:
                        rows.append((key, code, None, int(codecs.decode(code, coded.get(code, b""), 2, 3, 1, "u2", "<").sum())))
                    except codecs.CodecError as e:
                        rows.append((key, code, str(e), None))
            yield pd.DataFrame(rows, columns=["r_regionkey", "code", "error", "total"]).astype({"total": "Int64"})

    return B.read(spark, sf, "region").select("r_regionkey").mapInPandas(run, "r_regionkey int, code int, error string, total long")


@filled("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'codestream' WHEN 1 THEN 'container' END AS kind FROM part", kind='')
def jxl_sniff(spark, sf):
    heads = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.lit("FF0A00"))).when(F.col("p_partkey") % 3 == 1, F.unhex(F.lit("0000000C4A584C200D0A870A00"))).otherwise(F.encode("p_name", "UTF-8"))
    return parts(spark, sf).select("p_partkey", P.jxl_kind(heads).alias("kind"))


STEPS = {"x1": 1, "x2": 2, "x4": 4}


@query(WITH + LINEAR + f""" SELECT step, image_id, "row", col, {sql_q("CAST(CAST(x AS FLOAT) AS DOUBLE)", 1e5)} AS v FROM lin, (VALUES ('x1'), ('x2'), ('x4')) t(step)""")
def predictor_float_steps(spark, sf):
    """32-bit floats through the byte-plane predictor with each distance, and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = np.stack([np.asarray(v, "f4") for v in b["vals"]])
            for name, step in STEPS.items():
                yield b.assign(step=name, vals=list(codecs.undo_float(codecs.do_float(lines, step), lines.shape[1], 4, step).astype("f8")))

    lines = R.to_scanlines(linear(spark, sf)).mapInPandas(run, "image_id long, row int, plane int, vals array<double>, step string")
    return R.to_pixels(lines).select("step", *AT, q(F.col("value"), 1e5).alias("v"))


# --- metadata --------------------------------------------------------------------------------------------------


def raw_tags(key: int, size: int) -> bytes:
    """Levels, mosaic and areas; every third file has none of them."""
    extra = []
    if key % 3:
        extra = [tiff.entry(50713, 3, [2, 2]), tiff.entry(50714, 5, [(size * 4 + i, 4) for i in range(4)]), tiff.entry(50717, 4, 4000 + size), tiff.entry(50712, 3, list(range(size))), tiff.entry(50715, 10, [(-1, 2), (size, 4)]), tiff.entry(50716, 5, [(1, 1)])]
        extra += [tiff.entry(33421, 3, [2, 2]), tiff.entry(33422, 1, [0, 1, 1, 2] if key % 2 else [2, 1, 1, 0]), tiff.entry(50737, 4, size % 4), tiff.entry(50975, 4, 2)]
        extra += [tiff.entry(50829, 4, [2, 3, 2 + size, 3 + 2 * size]), tiff.entry(50719, 5, [(size, 2), (1, 2)]), tiff.entry(50720, 3, [size, size // 2])]
    return tiff.write([tiny(*extra)])


@filled("""SELECT p_partkey AS file_id, CASE WHEN k THEN 2 ELSE 1 END AS rows, CASE WHEN k THEN CAST(round((p_size + 0.75) * 100) AS BIGINT) ELSE 0 END AS last_black, CAST(CASE WHEN k THEN 4000 + p_size ELSE 65535 END AS BIGINT) AS white, CASE WHEN k THEN p_size END AS lut,
 CASE WHEN k THEN CAST(p_size * 25 AS BIGINT) END AS delta_h, CAST(NULL AS BIGINT) AS delta_v FROM (SELECT *, p_partkey % 3 > 0 AS k FROM part)""", lut=-1, delta_h=-1, delta_v=-1)
def linearization_tags(spark, sf):
    """Levels with their defaults; deltas that are not signed rationals don't count."""
    t = metadata.linearizations(made(parts(spark, sf), raw_tags, "p_partkey", "p_size"))
    last = F.element_at("black", -1)
    return t.select("file_id", "rows", F.round(last * 100).cast("long").alias("last_black"), F.col("white")[0].cast("long").alias("white"), F.when(F.col("lut").isNotNull(), F.size("lut")).alias("lut"), F.round(F.element_at("delta_h", -1) * 100).cast("long").alias("delta_h"), F.round(F.element_at("delta_v", -1) * 100).cast("long").alias("delta_v"))


@filled("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 1 THEN '0,1,1,2' ELSE '2,1,1,0' END AS pattern, CASE WHEN p_partkey % 3 > 0 THEN p_size % 4 END AS split, CASE WHEN p_partkey % 3 > 0 THEN 2 END AS row_interleave, CASE WHEN p_partkey % 3 > 0 THEN 1 END AS col_interleave FROM part", pattern='', split=-1, row_interleave=-1, col_interleave=-1)
def mosaic_tags(spark, sf):
    t = metadata.mosaics(made(parts(spark, sf), raw_tags, "p_partkey", "p_size"))
    return t.select("file_id", F.array_join(F.transform("pattern", lambda x: x.cast("string")), ",").alias("pattern"), "split", "row_interleave", "col_interleave")


@filled("""WITH a AS (SELECT p_partkey, p_size, 2 + CAST(round_even(1 / 2, 0) AS INT) AS t, 3 + CAST(round_even(p_size / 2, 0) AS INT) AS l, p_size // 2 AS h, p_size AS w FROM part WHERE p_partkey % 3 > 0),
 b AS (SELECT p_partkey, p_size, CASE WHEN t + h > 2 + p_size THEN greatest(2, 2 + p_size - h) ELSE t END AS t, least(t + h, 2 + p_size) AS b, CASE WHEN l + w > 3 + 2 * p_size THEN greatest(3, 3 + 2 * p_size - w) ELSE l END AS l, least(l + w, 3 + 2 * p_size) AS r FROM a)
 SELECT p.p_partkey AS file_id, CASE WHEN p.p_partkey % 3 > 0 THEN '2,3,' || (2 + p.p_size) || ',' || (3 + 2 * p.p_size) END AS active, CASE WHEN b.b > b.t AND b.r > b.l THEN b.t || ',' || b.l || ',' || b.b || ',' || b.r END AS crop FROM part p LEFT JOIN b USING (p_partkey)""", active='', crop='')
def crop_tags(spark, sf):
    """Active areas and default crops: rounded half to even, slid back into the active area."""
    t = metadata.areas(made(parts(spark, sf), raw_tags, "p_partkey", "p_size"))
    return t.select("file_id", *[F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in ("active", "crop")])


@query("SELECT o_orderkey AS file_id, l AS list, CAST(k AS INT) AS ord, CASE k WHEN 0 THEN 8 ELSE 6 END AS id, 1300 AS version, CAST(CASE k WHEN 0 THEN 44 ELSE 16 END AS BIGINT) AS size FROM orders, (VALUES (1), (2), (3)) t(l), range(2) r(k) WHERE o_orderkey % 200 = 0 AND o_orderkey % l = 0 AND k <= o_orderkey % 3 AND NOT (l = 3 AND o_orderkey % 3 <> 0) AND k < 2")
def opcode_tags(spark, sf):
    """The correction lists in files' tags, entry by entry."""

    def make(key: int) -> bytes:
        body = struct.pack(">4i4I", 0, 0, 1, 1, 0, 1, 1, 1) + struct.pack(">I1d", 0, 0.5)
        some = [(8, body), (6, struct.pack(">4i", 0, 0, 1, 1))][: 1 + min(key % 3, 1)]
        return tiff.write([tiny(*[tiff.entry({1: 51008, 2: 51009, 3: 51022}[n], 7, O.pack(some)) for n in (1, 2, 3) if key % n == 0])])

    files = made(B.read(spark, sf, "orders").where("o_orderkey % 200 = 0"), make, "o_orderkey")
    return O.entries(files).select("file_id", "list", "ord", "id", "version", "size")


def profiled(key: int, size: int) -> bytes:
    """A camera profile: two calibrations with diagonal matrices; a neutral, or a white that displaces it."""

    def matrix(*on: float) -> list[tuple[int, int]]:
        return [(round(1000 * on[i]), 1000) if i == j else (0, 1) for i in range(3) for j in range(3)]

    shot = [tiff.entry(50728, 5, [(50 + size, 100), (100, 100), (150 - size, 100)])]
    if key % 2:
        shot.append(tiff.entry(50729, 5, [(300 + size, 1000), (310 + size, 1000)]))
    forward = [] if key % 5 == 0 else [tiff.entry(50964, 10, matrix(0.9, 1.0, 0.7)), tiff.entry(50965, 10, matrix(0.95, 1.0, 0.85))]
    extra = [*shot, *forward, tiff.entry(50721, 10, matrix(1.2, 1.0, 1.4)), tiff.entry(50722, 10, matrix(1.1, 1.0, 1.2)), tiff.entry(50723, 10, matrix(1.0, 1.0, 1.1)), tiff.entry(50724, 10, matrix(1.0, 1.0, 0.9)), tiff.entry(50727, 5, [(1, 1), (1, 1), (2, 1)]), tiff.entry(50778, 3, 17), tiff.entry(50779, 3, 21), tiff.entry(50730, 10, [(size - 25, 10)]), tiff.entry(50940, 11, [0.0, 0.0, 0.5, 0.25, 1.0, 1.0])]
    return tiff.write([tiny(*extra)])


@filled("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(50 + p_size AS BIGINT) END AS neutral, CASE WHEN p_partkey % 2 = 1 THEN CAST(300 + p_size AS BIGINT) END AS white, CAST((p_size - 25) * 10 AS BIGINT) AS exposure, 3 AS knots, '17,21' AS illuminants, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 9 END AS forward FROM part", neutral=-1, white=-1)
def camera_profile_tags(spark, sf):
    """The camera profile; of a neutral and a white, the white counts."""
    t = metadata.profiles(made(parts(spark, sf), profiled, "p_partkey", "p_size"))
    return t.select("file_id", F.round(F.get("neutral", F.lit(0)) * 100).cast("long").alias("neutral"), F.round(F.get("white_xy", F.lit(0)) * 1000).cast("long").alias("white"), F.round(F.col("exposure") * 100).cast("long").alias("exposure"), F.expr("size(curve) div 2").cast("int").alias("knots"), F.array_join(F.transform("illuminants", lambda x: x.cast("string")), ",").alias("illuminants"), F.size(F.col("forward")[0]).alias("forward"))


#: Temperature of a chromaticity (x, y of `c`): signed distances to the isotherms, the first that is not positive.
KELVIN_SQL = f"""iso AS (SELECT i, r, u, v, atan(s) AS a FROM (VALUES {ISO}) t(i, r, u, v, s)), uv AS (SELECT k, 2 * x / ({d(1.5)} - x + 6 * y) AS uu, 3 * y / ({d(1.5)} - x + 6 * y) AS vv FROM c),
 far AS (SELECT k, i, r, (vv - v) * cos(a) - (uu - u) * sin(a) AS e FROM uv, iso), two AS (SELECT k, i, r, e, lag(r) OVER w AS r0, lag(e) OVER w AS e0 FROM far WINDOW w AS (PARTITION BY k ORDER BY i)),
 hit AS (SELECT k, arg_min(CASE WHEN i = 1 THEN r ELSE r0 + (r - r0) * (e0 / (e0 - e)) END, i) AS m FROM two WHERE i > 0 AND e <= 0 GROUP BY k), kelvin AS (SELECT c.k, {d(1e6)} / coalesce(m, {d(600)}) AS kelvin FROM c LEFT JOIN hit USING (k))"""


@query(f"WITH c AS (SELECT p_partkey AS k, (300 + p_size) / {d(1000)} AS x, (310 + p_size * 2) / {d(1000)} AS y FROM part), {KELVIN_SQL} SELECT k AS p_partkey, {sql_q('kelvin', 1e3)} AS kelvin FROM kelvin")
def robertson_temperature(spark, sf):
    """Chromaticity to temperature, the other way of robertson_cct: distances to 31 isotherms, a table of fixed size."""

    @F.pandas_udf("double")
    def kelvin(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([colour.to_temperature(xy)[0] for xy in zip(x, y, strict=True)])

    p = parts(spark, sf).select("p_partkey", ((F.col("p_size") + 300) / 1000.0).alias("x"), ((F.col("p_size") * 2 + 310) / 1000.0).alias("y"))
    return p.select("p_partkey", q(kelvin("x", "y"), 1e3).alias("kelvin"))


@query(f"""WITH n AS (SELECT p_partkey AS k, (50 + p_size) / {d(100)} AS a, {d(1)} AS b, (150 - p_size) / {d(100)} AS e FROM part), c AS (SELECT k, a / (a + b + e) AS x, b / (a + b + e) AS y FROM n), {KELVIN_SQL} SELECT k AS file_id, {sql_q('kelvin', 1e2)} AS kelvin FROM kelvin""")
def as_shot_temperature(spark, sf):
    """The temperature that a neutral settles at, under a camera whose numbers are XYZ."""

    @F.pandas_udf("double")
    def kelvin(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([colour.settle_temperature([x, 1.0, y], lambda _: np.eye(3)) for x, y in zip(a, b, strict=True)])

    return parts(spark, sf).select(F.col("p_partkey").alias("file_id"), q(kelvin((F.col("p_size") + 50) / 100.0, (F.lit(150) - F.col("p_size")) / 100.0), 1e2).alias("kelvin"))


def _camera_sql() -> str:
    """Diagonal matrices, so each channel by itself: forward or inverse colour matrix, the white's neutral, the calibration."""
    low, high = 2856.0, 6504.0
    weight = f"least(greatest(({d(1)} / kelvin - {d(1 / high)}) / {d(1 / low - 1 / high)}, {d(0)}), {d(1)})"
    channels = []
    for n, (f1, f2, c1, c2, ab) in {"r": (0.9, 0.95, 1.0, 1.0, 1.0), "g": (1.0, 1.0, 1.0, 1.0, 1.0), "b": (0.7, 0.85, 1.1, 0.9, 2.0)}.items():
        matrix = f"({weight} * {d(f1)} + ({d(1)} - {weight}) * {d(f2)})"
        # bracket() gives the lower illuminant but above the higher one
        calibration = f"({d(ab)} * CASE WHEN kelvin >= {d(high)} THEN {d(c2)} ELSE {d(c1)} END)"
        channels.append((n, matrix, calibration))
    white = {"r": f"(x / y)", "g": d(1), "b": f"(({d(1)} - x - y) / y)"}
    raw = {n: f"{white[n]} / {m}" for n, m, _ in channels}
    most = f"greatest({', '.join(raw.values())})"
    cells = ", ".join(f"{sql_q(f'{m} / ({raw[n]} / {most}) / {c}', 1e5)} AS {n}" for n, m, c in channels)
    return f"WITH c AS (SELECT p_partkey AS k, (300 + p_size) / {d(1000)} AS x, (310 + p_size) / {d(1000)} AS y FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 > 0), {KELVIN_SQL} SELECT k AS file_id, {cells} FROM kelvin JOIN c USING (k)"


@query(_camera_sql())
def camera_matrices(spark, sf):
    """Camera to XYZ of each file: between its calibrations, balanced by the neutral of its white, calibration undone."""
    files = made(parts(spark, sf).where("p_partkey % 2 = 1 and p_partkey % 5 > 0"), profiled, "p_partkey", "p_size")
    m = D.settings(files)
    return m.select("file_id", *[q(F.col("matrix")[4 * i], 1e5).alias(n) for i, n in enumerate("rgb")])


DIVISIONS = (6, 3, 4)
OTHER = [(h * 0.5, s * 0.9, v * 1.1) for h, s, v in deltas(*DIVISIONS)]


def _blended_hue_sql() -> str:
    """The SQL of one table, its numbers replaced by those of two in proportion to the weight."""
    weight = f"(l_linenumber / {d(8)})"
    sql = WITH + RGB + hue_sat_sql(*DIVISIONS)
    for k in range(3):
        one, two = (B.arr([t[k] for t in table]) for table in (deltas(*DIVISIONS), OTHER))
        sql = sql.replace(f"list_extract({one}, ", f"list_extract(list_transform(list_zip({one}, {two}), lambda z: {weight} * z[1] + ({d(1)} - {weight}) * z[2]), ")
    return sql + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql_q(x, 1e4)} AS {x}" for x in "rgb") + " FROM k4 WHERE l_orderkey % 20 = 0"


@query(_blended_hue_sql().replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey % 20 = 0)").replace(" FROM k4 WHERE l_orderkey % 20 = 0", " FROM k4"))
def hue_tables_blended(spark, sf):
    """The hue tables of two illuminants, by a weight that each row has."""
    px = B.rgb(spark, sf).where("l_orderkey % 20 = 0").withColumn("weight", F.col("l_linenumber") / 8.0)
    return tone.hue_sat(px, deltas(*DIVISIONS), DIVISIONS, OTHER, F.col("weight")).select(*KEY, *[q(F.col(c), 1e4).alias(c) for c in "rgb"])


@filled("SELECT event_id AS file_id, 'maker ' || user_id AS make, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 1000 AS BIGINT) END AS iso, CAST(event_id % 50 AS BIGINT) * 250 AS f_number, strftime(ts, '%Y:%m:%d %H:%M:%S') AS date_original, CAST(year(ts) AS INT) AS year, CAST(hour(ts) AS INT) AS hour, 1 AS others FROM events", iso=-1)
def exif_tags(spark, sf):
    """The exposure record of files, its dates read in the JVM; tags that it doesn't know are kept."""

    def make(key: int, user: int, date: str) -> bytes:
        tags = [tiff.entry(271, 2, f"maker {user}"), tiff.entry(33437, 5, [(key % 50, 4)]), tiff.entry(36867, 2, date), tiff.entry(60000, 7, b"?")]
        return tiff.write([tiff.Page(tags + ([tiff.entry(34855, 3, key % 1000)] if key % 2 == 0 else []))])

    e = B.read(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("date"))
    r = metadata.exif_records(made(e, make, "event_id", "user_id", "date"))
    at = P.exif_date(F.col("date_original"))
    return r.select("file_id", "make", "iso", F.round(F.col("f_number") * 1000).cast("long").alias("f_number"), "date_original", at["year"].alias("year"), at["hour"].alias("hour"), F.size("unknown").alias("others"))


@query("SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(floor(second(ts)) AS INT) AS second FROM events")
def iim_dates(spark, sf):
    """CCYYMMDD and HHMMSS with an offset that is dropped."""
    e = B.read(spark, sf, "events")
    day, time = P.iim_date(F.date_format("ts", "yyyyMMdd")), P.iim_time(F.concat(F.date_format("ts", "HHmmss"), F.lit("+0100")))
    return e.select("event_id", *[c.alias(n) for n, c in (day | time).items()])


@filled("SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE coalesce(text, '') END AS packet FROM documents", packet='(none)')
def xmp_packets(spark, sf):
    """Packets are handed on as they are; a file without one has none."""

    def make(key: int, text: str | None) -> bytes:
        return tiff.write([tiny(*([] if key % 4 == 0 else [tiff.entry(700, 7, (text or "").encode())]))])

    docs = B.read(spark, sf, "documents").select("doc_id", "text")
    return metadata.packets(made(docs, make, "doc_id", "text")).select("file_id", F.decode("packet", "UTF-8").alias("packet"))


@filled("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 4 > 0 THEN '1,' || p_size % 9 || ',' || p_partkey % 3 || ',0' END AS needs, p_partkey % 4 = 0 OR p_size % 9 < 7 OR (p_size % 9 = 7 AND p_partkey % 3 <= 1) AS readable FROM part", needs='')
def reader_gate(spark, sf):
    """Whether a reader of version 1.7.1.0 may read a file: versions compare number by number."""

    def make(key: int, size: int) -> bytes:
        return tiff.write([tiny(*([tiff.entry(50707, 1, [1, size % 9, key % 3, 0])] if key % 4 else []))])

    g = tiff.readable(tiff.entries(made(parts(spark, sf), make, "p_partkey", "p_size")))
    return g.select("file_id", F.array_join(F.transform("needs", lambda x: x.cast("string")), ",").alias("needs"), "readable")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE p_size % 9 >= 8 AND p_partkey % 4 > 0) AS refused FROM part")
def refused_files(spark, sf):
    """Development refuses files that need a newer reader, and tells which."""
    def make(key: int, size: int) -> bytes:
        return tiff.write([tiny(*([tiff.entry(50707, 1, [1, size % 9, 0, 0])] if key % 4 else []))])

    s = D.settings(made(parts(spark, sf), make, "p_partkey", "p_size"))
    return s.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("kind") == D.UNSUPPORTED, 1)).alias("refused"))


FLAGS = {"opcodes": (2, 1300), "float_pixels": (3, 1400), "deflate": (5, 1400), "lossy_jpeg": (7, 1400), "proxy": (11, 1400), "depth_map": (13, 1500), "enhanced": (17, 1500), "semantic_mask": (19, 1600), "third_illuminant": (23, 1600), "jxl": (29, 1700), "gain_table_2": (31, 1700), "hdr_profile": (37, 1700), "image_stats": (41, 1700), "image_sequence": (43, 1700), "column_interleave": (47, 1710)}


@query("SELECT o_orderkey, greatest(1000, " + ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN {v} ELSE 0 END" for m, v in FLAGS.values()) + ") AS version FROM orders")
def backward_version_all(spark, sf):
    """The oldest reader by every feature of a file."""
    k = F.col("o_orderkey")
    return B.read(spark, sf, "orders").select("o_orderkey", P.backward_version({n: k % m == 0 for n, (m, _) in FLAGS.items()}).alias("version"))


# --- correction lists, defects, masks --------------------------------------------------------------------------

BAD = "(\"row\" BETWEEN 20 AND 22 AND col BETWEEN 10 AND 12) OR (\"row\" = 3 AND col = 5)"


@query(WITH + MOSAIC + f""", px AS (SELECT *, {BAD} AS bad FROM rb1), off AS (SELECT * FROM (VALUES (1, -1, -1), (1, -1, 1), (1, 1, -1), (1, 1, 1), (0, -2, 0), (0, 2, 0), (0, 0, -2), (0, 0, 2)) o(green, dr, dc)),
 fixed AS (SELECT p.image_id, p."row", p.col, sum(n.value) AS s, count(*) AS n FROM px p JOIN off ON off.green = 1 - (p."row" + p.col) % 2 JOIN px n ON n.image_id = p.image_id AND n."row" = p."row" + dr AND n.col = p.col + dc AND NOT n.bad WHERE p.bad GROUP BY ALL),
 one AS (SELECT p.image_id, p."row", p.col, CASE WHEN f.n = 4 THEN (f.s + 2) // 4 WHEN f.n > 0 THEN (f.s + f.n // 2) // f.n ELSE p.value END AS v FROM px p LEFT JOIN fixed f ON f.image_id = p.image_id AND f."row" = p."row" AND f.col = p.col)
 SELECT image_id, "row" - 2 AS "row", col - 4 AS col, CAST(list_extract({[min(65535, i * 3) for i in range(100)]}, CAST(least(v, 99) AS BIGINT) + 1) AS BIGINT) AS v FROM one WHERE "row" BETWEEN 2 AND 97 AND col BETWEEN 4 AND 59""")
def opcode_list_1(spark, sf):
    """A first list on stored numbers: defects by a list, trimming, a table; a warp in it is passed over."""
    table = [min(65535, i * 3) for i in range(100)]
    defects = struct.pack(">III", 0, 1, 1) + struct.pack(">2i", 3, 5) + struct.pack(">4i", 20, 10, 23, 13)
    trim, whole = struct.pack(">4i", 2, 4, 98, 60), struct.pack(">4i4I", 0, 0, 96, 56, 0, 1, 1, 1)
    packed = O.pack([(5, defects), (1, b"passed over"), (6, trim), (7, whole + struct.pack(">I100H", 100, *table))])
    px, _ = O.apply(B.mosaic_pixels(spark, sf), O.parse(packed), BOUNDS, 1)
    return px.select(*AT, F.col("value").cast("long").alias("v"))


_reach = 50.0**2 + 32.0**2
_r2 = f'least((("row" + {d(0.5)} - {d(50)}) * ("row" + {d(0.5)} - {d(50)}) + (col + {d(0.5)} - {d(32)}) * (col + {d(0.5)} - {d(32)})) * {d(1 / _reach)}, {d(1)})'
_gain = d(0)
for _k in reversed(VIGNETTE):
    _gain = f"({_r2}) * ({d(_k)} + {_gain})"


@query(WITH + LINEAR + f""", w AS (SELECT image_id, "row", col, least(x * ({_gain} + {d(1)}), {d(1)}) AS x FROM lin) SELECT image_id, "row", col, {sql_q(f'CASE WHEN "row" BETWEEN 10 AND 89 AND (("row" - 10) // 2) < 20 AND ("row" - 10) % 2 = 0 THEN least(greatest(x * (({d(0.5)} + (("row" - 10) // 2) / {d(32)})), {d(-1)}), {d(1)}) ELSE x END')} AS v FROM w""")
def opcode_list_3(spark, sf):
    """A third list on the picture: a warp without effect, a vignette, factors by row; a table in it is passed over."""
    still = struct.pack(">I6d2d", 1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5)
    vignette = struct.pack(">7d", *VIGNETTE, 0.5, 0.5)
    factors = struct.pack(">4i4I", 10, 0, 90, 64, 0, 1, 2, 1) + struct.pack(">I20f", 20, *[0.5 + i / 32 for i in range(20)])
    packed = O.pack([(1, still), (3, vignette), (7, b"passed over"), (12, factors)])
    px, _ = O.apply(linear(spark, sf), O.parse(packed), BOUNDS, 3)
    return px.select(*AT, q(F.col("value")).alias("v"))


@query(WITH + LINEAR + f' SELECT image_id, "row", col, {sql_q("x")} AS v FROM lin')
def warp_identity(spark, sf):
    """A warp without effect is left out of the plan."""
    return W.warp(linear(spark, sf), BOUNDS, W.Rectilinear([1.0, 0.0, 0.0, 0.0])).select(*AT, q(F.col("value")).alias("v"))


@query(WITH + MOSAIC + """, pts AS (SELECT DISTINCT p_partkey % 7 AS image_id, CAST(p_size AS INT) AS "row", CAST(p_partkey % 64 AS INT) AS col FROM part), rects AS (SELECT s_suppkey % 7 AS image_id, CAST(s_suppkey % 90 AS INT) AS t, CAST(s_suppkey % 60 AS INT) AS l, CAST(s_suppkey % 90 + s_nationkey % 5 AS INT) AS b, CAST(s_suppkey % 60 + 4 AS INT) AS r FROM supplier)
 SELECT image_id, "row", col, CAST(value AS BIGINT) AS v FROM rb1 x WHERE EXISTS (SELECT 1 FROM pts p WHERE p.image_id = x.image_id AND p."row" = x."row" AND p.col = x.col) OR EXISTS (SELECT 1 FROM rects s WHERE s.image_id = x.image_id AND x."row" >= t AND x."row" < b AND x.col >= l AND x.col < r)""")
def defects_listed(spark, sf):
    """Points by a semi join, rectangles by a range join, both as one set."""
    points = parts(spark, sf).select((F.col("p_partkey") % 7).alias("image_id"), F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % 64).cast("int").alias("col")).distinct()
    s = B.read(spark, sf, "supplier")
    top, left = (s.s_suppkey % 90).cast("int"), (s.s_suppkey % 60).cast("int")
    rects = s.select((F.col("s_suppkey") % 7).alias("image_id"), top.alias("top"), left.alias("left"), (top + s.s_nationkey % 5).cast("int").alias("bottom"), (left + 4).alias("right"))
    return R.listed(B.mosaic_pixels(spark, sf), points, rects).select(*AT, F.col("value").cast("long").alias("v"))


def with_mask(lines: DataFrame) -> DataFrame:
    """(file_id, content): three planes from each mosaic, and a mask: opaque but for a frame in even images, soft in odd ones."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        key = int(g["image_id"].iloc[0])
        raw = np.stack(g.sort_values("row")["vals"].to_numpy()).astype("u2")
        r, c = np.indices(raw.shape)
        soft = ((r * 7 + c * 13) % 256).astype("u1")
        framed = np.where((r >= 10) & (r < 90) & (c >= 4) & (c < 60), 255, 100).astype("u1")
        page = tiff.image_page(np.stack([raw, raw // 2, raw // 3], axis=2), photometric=D.LINEAR, extra=[tiff.entry(50717, 4, 4095)])
        page.subs = [tiff.image_page((soft if key % 2 else framed)[:, :, None], sub_type=4)]
        return pd.DataFrame({"file_id": [key], "content": [tiff.write([page])]})

    return lines.select("image_id", "row", "vals").groupBy("image_id").applyInPandas(run, "file_id long, content binary")


MASK_SQL = """alpha AS (SELECT image_id, "row", col, CASE WHEN image_id % 2 = 1 THEN ("row" * 7 + col * 13) % 256 WHEN "row" BETWEEN 10 AND 89 AND col BETWEEN 4 AND 59 THEN 255 ELSE 100 END AS a FROM rb1)"""


@query(WITH + MOSAIC + ", " + MASK_SQL + ' SELECT image_id, "row", col, CAST(a AS BIGINT) AS v FROM alpha')
def mask_samples(spark, sf):
    """The transparency mask of files, which is a sub-IFD."""
    return tiff.samples(with_mask(B.mosaic_lines(spark, sf)), "mask").select(*AT, F.col("value").cast("long").alias("v"))


_to_srgb = colour.to_output("srgb")


@query(
    WITH + MOSAIC + ", " + MASK_SQL
    + f""", lin3 AS (SELECT image_id, "row", col, least(value * {d(1 / 4095)}, {d(1)}) AS r, least((value // 2) * {d(1 / 4095)}, {d(1)}) AS g, least((value // 3) * {d(1 / 4095)}, {d(1)}) AS b FROM rb1),
 m1 AS (SELECT image_id, "row", col, """ + ", ".join(f"{e} AS {n}" for e, n in zip(matrix_sql(_to_srgb.tolist()), "rgb", strict=True))
    + f" FROM lin3), m2 AS (SELECT *, {d(0.2126)} * r + {d(0.7152)} * g + {d(0.0722)} * b AS y FROM m1), m3 AS (SELECT *, {s_curve_sql('y')} AS ny FROM m2), m4 AS (SELECT image_id, \"row\", col, "
    + ", ".join(f"CASE WHEN y <= {d(1e-8)} THEN ny ELSE greatest({x} * (ny / y), {d(0)}) END AS {x}" for x in "rgb")
    + ' FROM m3), m5 AS (SELECT m4.image_id, m4."row", m4.col, a / ' + d(255) + " AS a, " + ", ".join(f"{quantize_sql(x)} AS {x}" for x in "rgb")
    + ' FROM m4 JOIN alpha k ON k.image_id = m4.image_id AND k."row" = m4."row" AND k.col = m4.col) SELECT image_id, CASE WHEN image_id % 2 = 0 THEN "row" - 10 ELSE "row" END AS "row", CASE WHEN image_id % 2 = 0 THEN col - 9 ELSE col END AS col, '
    + ", ".join(f"CAST(CASE WHEN a >= 1 THEN {x} ELSE floor(a * {x} + ({d(1)} - a) * {d(255)} + {d(0.5)}) END AS INT) AS {x}" for x in "rgb")
    + ' FROM m5 WHERE image_id % 2 = 1 OR ("row" BETWEEN 10 AND 89 AND col BETWEEN 9 AND 54)'
)
def masked_render(spark, sf):
    """Whole development of files with a mask: cut to its opaque part where it has one, else laid over white. Ten rounds
    bring the upper edge to row 10; in nine of them the left edge, which still has holes above that row, moves too."""
    return D.develop(with_mask(B.mosaic_lines(spark, sf)))


@query(demosaic_sql([0, 1, 1, 2]) + ', u AS (SELECT image_id, "row", col, ' + ", ".join(f"{quantize_sql(x)} AS {x}" for x in "rgb") + ' FROM wide) SELECT * FROM u')
def rgb8_tiff_roundtrip(spark, sf):
    """A picture of 8 bits as a TIFF of three planes, and back. A file is blank where the table has no sample; no rows come of that."""
    px = demosaiced(spark, sf).select(*AT, F.posexplode(F.array(*[P.quantize(F.col(c)) for c in "rgb"])).alias("plane", "value"))
    found = R.those_of(tiff.scanlines(tiff.build(px, "u1", rows_per_strip=50)), B.mosaic_lines(spark, sf))
    return R.to_wide(R.to_pixels(found)).select(*AT, *[F.col(c).cast("int").alias(c) for c in "rgb"])


# --- scalars, geometry, algebra --------------------------------------------------------------------------------

@query("""WITH g AS (SELECT p_partkey, p_size AS a_t, 0 AS al, p_size + p_partkey % 20 AS ab, 5 AS ar, 10 AS bt, 2 AS bl, 40 AS bb, p_size % 9 AS br FROM part), f AS (SELECT *, (a_t >= ab OR al >= ar) AS ea, (bt >= bb OR bl >= br) AS eb, greatest(a_t, bt) AS it, greatest(al, bl) AS il, least(ab, bb) AS ib, least(ar, br) AS ir FROM g)
 SELECT p_partkey, (a_t <= bt AND al <= bl AND ab >= bb AND ar >= br) AS inside, CASE WHEN it >= ib OR il >= ir THEN '0,0,0,0' ELSE it || ',' || il || ',' || ib || ',' || ir END AS both, CASE WHEN ea THEN bt || ',' || bl || ',' || bb || ',' || br WHEN eb THEN a_t || ',' || al || ',' || ab || ',' || ar ELSE least(a_t, bt) || ',' || least(al, bl) || ',' || greatest(ab, bb) || ',' || greatest(ar, br) END AS around, al || ',' || a_t || ',' || ar || ',' || ab AS turned FROM f""")
def rect_algebra(spark, sf):
    """Contains, intersect, union, transpose; empty rectangles give way."""
    p = parts(spark, sf)
    s = F.col("p_size")
    a = [s, F.lit(0), (s + F.col("p_partkey") % 20), F.lit(5)]
    b = [F.lit(10), F.lit(2), F.lit(40), s % 9]

    def text(rect: list[Column]) -> Column:
        return F.concat_ws(",", *[c.cast("string") for c in rect])

    return p.select("p_partkey", P.rect_contains(a, b).alias("inside"), text(P.rect_intersect(a, b)).alias("both"), text(P.rect_union(a, b)).alias("around"), text(P.rect_transpose(a)).alias("turned"))


@query("WITH c AS (SELECT CAST(code AS INT) AS code FROM range(11) r(code)) SELECT code, CASE code WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 1 WHEN 7 THEN 5 WHEN 8 THEN 3 WHEN 9 THEN 8 ELSE 0 END AS element, CASE WHEN code BETWEEN 1 AND 9 THEN code ELSE 1 END AS again FROM c")
def orientation_codes(spark, sf):
    codes = spark.range(11).select(F.col("id").cast("int").alias("code"))
    element = P.tiff_to_dihedral(F.col("code"))
    return codes.select("code", element.alias("element"), P.dihedral_to_tiff(element).alias("again"))


_mat = [f"(p_size % 7 + {i} + {d(1)})" if i % 4 else f"(p_size + {i} + {d(3)})" for i in range(9)]
_det = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*[f"m{i}" for i in range(9)])


@query("WITH m AS (SELECT p_partkey, " + ", ".join(f"{e} AS m{i}" for i, e in enumerate(_mat)) + f") SELECT p_partkey, {sql_q('m0 * m1 + m1 * m4 + m2 * m7')} AS square_01, {sql_q('m3')} AS turned_01, {sql_q(_det, 1e3)} AS det, {sql_q(f'(m4 * m8 - m5 * m7) / {_det}', 1e9)} AS inverse_00, {sql_q(f'-(m1 * m8 - m2 * m7) / {_det}', 1e9)} AS inverse_01, {sql_q('m8 * ' + d(2.5))} AS scaled_22, {sql_q('greatest(m0, m1, m2, m3, m4, m5, m6, m7, m8)')} AS most, {sql_q('least(m0, m1, m2, m3, m4, m5, m6, m7, m8)')} AS least, true AS even FROM m".replace(") SELECT", " FROM part) SELECT", 1))
def matrix_algebra(spark, sf):
    """Products, transposes, determinants, inverses, scales and extremes of 3 x 3 matrices; a matrix times its inverse."""
    s = F.col("p_size")
    cells = [(s % 7 + i + 1.0) if i % 4 else (s + i + 3.0) for i in range(9)]
    m = parts(spark, sf).select("p_partkey", F.array(*[c.cast("double") for c in cells]).alias("m"))
    m = m.withColumns({"square": A.matrix_product(F.col("m"), F.col("m")), "inverse": A.inverse(F.col("m"))})
    unit = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    even = A.distance(A.matrix_product(F.col("m"), F.col("inverse")), unit) < 1e-6
    return m.select("p_partkey", q(F.col("square")[1]).alias("square_01"), q(A.transposed(F.col("m"))[1]).alias("turned_01"), q(A.determinant(F.col("m")), 1e3).alias("det"), q(F.col("inverse")[0], 1e9).alias("inverse_00"), q(F.col("inverse")[1], 1e9).alias("inverse_01"), q(A.scaled(F.col("m"), F.lit(2.5))[8]).alias("scaled_22"), q(F.array_max("m")).alias("most"), q(F.array_min("m")).alias("least"), even.alias("even"))


@query(f"SELECT a.vec_id, {sql_q('list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))', 1e5)} AS dot, {sql_q('sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))', 1e5)} AS distance, {sql_q('list_max(a.embedding)', 1e5)} AS most FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_algebra(spark, sf):
    """Dot products and distances of each vector and the next."""
    e = B.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", q(A.dot(F.col("a"), F.col("b")), 1e5).alias("dot"), q(A.distance(F.col("a"), F.col("b")), 1e5).alias("distance"), q(F.array_max("a"), 1e5).alias("most"))


_big = "(CAST(o_orderkey AS HUGEINT) * 61489146912)"


@filled(f"SELECT o_orderkey, CASE WHEN {_big} * 100000 BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST({_big} * 100000 AS BIGINT) END AS product, CASE WHEN {_big} + 9223372036854000000 <= 9223372036854775807 THEN CAST({_big} + 9223372036854000000 AS BIGINT) END AS total, CASE WHEN -9223372036854000000 - {_big} >= -9223372036854775808 THEN CAST(-9223372036854000000 - {_big} AS BIGINT) END AS difference FROM orders", product=-1, total=-1, difference=-1)
def checked_arithmetic(spark, sf):
    """What passes the range of a type is null, not another number."""
    big = F.col("o_orderkey") * F.lit(61489146912)
    return B.read(spark, sf, "orders").select("o_orderkey", F.try_multiply(big, F.lit(100000).cast("long")).alias("product"), F.try_add(big, F.lit(9223372036854000000)).alias("total"), F.try_subtract(F.lit(-9223372036854000000), big).alias("difference"))


def _denominator_sql(x: str) -> str:
    powers = " ".join(f"WHEN {x} * {d(10.0**p)} = floor({x} * {d(10.0**p)}) OR abs({x}) * {d(10.0 ** (p + 1))} >= {d(2.0**31)} THEN {d(10.0**p)}" for p in range(9))
    return f"CASE {powers} ELSE {d(1e9)} END"


@query(f"WITH r AS (SELECT o_orderkey, o_totalprice AS x, {_denominator_sql('o_totalprice')} AS d FROM orders) SELECT o_orderkey, CAST(round(x * d) AS BIGINT) AS n, CAST(d AS BIGINT) AS d FROM r")
def rationals(spark, sf):
    n, den = A.rational(F.col("o_totalprice"))
    return B.read(spark, sf, "orders").select("o_orderkey", n.alias("n"), den.alias("d"))


@query(f"WITH c AS (SELECT p_partkey, (300 + p_size) / {d(1000)} AS x, (310 + p_size) / {d(1000)} AS y FROM part) SELECT p_partkey, {sql_q('x / y')} AS tx, {sql_q(f'({d(1)} - x - y) / y')} AS tz, {sql_q(f'(x / y) / (x / y + 1 + ({d(1)} - x - y) / y)')} AS back FROM c")
def chromaticities(spark, sf):
    """xy to XYZ at Y = 1, and back."""

    @F.pandas_udf("array<double>")
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [colour.xyz(p) for p in zip(x, y, strict=True)]
        return pd.Series([[v[0], v[2], colour.xy_of(v)[0]] for v in out])

    p = parts(spark, sf).select("p_partkey", both((F.col("p_size") + 300) / 1000.0, (F.col("p_size") + 310) / 1000.0).alias("v"))
    return p.select("p_partkey", *[q(F.col("v")[i]).alias(n) for i, n in enumerate(("tx", "tz", "back"))])


@filled("SELECT p_partkey, CASE WHEN code IN (34892, 2) THEN 'pass' WHEN code = 32803 AND p_partkey % 2 = 0 THEN 'demosaic' END AS does FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 34892 WHEN 1 THEN 2 WHEN 2 THEN 32803 ELSE 1 END AS code FROM part)", does='')
def photometric_dispatch(spark, sf):
    code = F.when(F.col("p_size") % 4 == 0, 34892).when(F.col("p_size") % 4 == 1, 2).when(F.col("p_size") % 4 == 2, 32803).otherwise(1)
    return parts(spark, sf).select("p_partkey", P.can_develop(code, F.col("p_partkey") % 2 == 0).alias("does"))


@query(WITH + PLANES + ' SELECT image_id, "row", col, plane, CAST(7 AS BIGINT) AS v FROM rb2')
def fill(spark, sf):
    """A constant in every sample."""
    return B.plane_pixels(spark, sf).select("image_id", "row", "col", "plane", F.lit(7).cast("long").alias("v"))


@query("""WITH s AS (SELECT s_suppkey, list_value(p_a, p_b, p_c) AS black FROM (SELECT s_suppkey, s_suppkey % 5 + 2 AS p_a, s_nationkey + 1 AS p_b, s_suppkey % 3 + 4 AS p_c FROM supplier)) SELECT s_suppkey, CAST(list_min(black) AS BIGINT) AS least, CAST(list_max(black) AS BIGINT) AS most FROM s""")
def least_black(spark, sf):
    """The least of a table of black levels, which scales all of them."""
    s = B.read(spark, sf, "supplier").select("s_suppkey", F.array((F.col("s_suppkey") % 5 + 2).cast("long"), (F.col("s_nationkey") + 1).cast("long"), (F.col("s_suppkey") % 3 + 4).cast("long")).alias("black"))
    return s.select("s_suppkey", F.array_min("black").alias("least"), F.array_max("black").alias("most"))


SYNTHETIC = {
    "gradient": (lambda spark: synthetic.gradient(spark, 40, 50, 1000, 1), 40, 50, f"CAST(floor(c * {d(1000)} / 49 + {d(0.5)}) AS INT)"),
    "circle": (lambda spark: synthetic.circle(spark, 40, 0.5, 9, 1), 40, 40, "CASE WHEN (r + 0.5 - 20) * (r + 0.5 - 20) + (c + 0.5 - 20) * (c + 0.5 - 20) <= 100 THEN 0 ELSE 9 END"),
    "checkerboard": (lambda spark: synthetic.checkerboard(spark, 30, 40, 4, 9, 1), 30, 40, "CASE WHEN (r // 4 + c // 4) % 2 = 0 THEN 9 ELSE 0 END"),
    "bordered": (lambda spark: synthetic.bordered(spark, 30, 5, 20, 2, 1000, 1), 30, 30, "CASE WHEN r < 5 OR c < 5 OR r >= 25 OR c >= 25 THEN 150 WHEN r < 7 OR c < 7 OR r >= 23 OR c >= 23 THEN 1000 ELSE 0 END"),
    "stripes": (lambda spark: synthetic.stripes(spark, 30, 40), 30, 40, "(r * 7 + c * 13) & 4095"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, CAST({e} AS BIGINT) AS v FROM range({h}) a(r), range({w}) b(c)" for n, (_, h, w, e) in SYNTHETIC.items()))
def synthetic_patterns(spark, sf):
    """Images by formula."""
    out = None
    for n, (f, *_) in SYNTHETIC.items():
        one = f(spark).select(F.lit(n).alias("name"), "row", "col", F.col("value").cast("long").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out
