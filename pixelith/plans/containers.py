"""Queries over containers, codecs, metadata and correction lists. Importing adds them to the catalog."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pixelith.operators import raster as R
from pixelith.plans import bindings as B
from pixelith.plans import opcodes as O
from pixelith.plans.bindings import BOUNDS, LINEAR, MOSAIC, d, q, sql_q
from pixelith.plans.catalog import AT, GAINS, IN_AREA, POLY, WITH, gain_sql, linear, query
from pixelith.sources import codecs, metadata, tiff

SAME = WITH + MOSAIC + ' SELECT image_id, "row", col, CAST(value AS BIGINT) AS v FROM rb1'


def _there_and_back(name, sql, build):
    def run(spark, sf):
        return tiff.samples(build(B.mosaic_pixels(spark, sf))).select("image_id", "row", "col", F.col("value").cast("long").alias("v"))

    query(sql, name)(run)


_there_and_back("tiff_roundtrip", SAME, lambda px: tiff.build(px, rows_per_strip=16))
_there_and_back("tiff_tiled_deflate", SAME, lambda px: tiff.build(px, code=codecs.DEFLATE, tile=(32, 48)))
_there_and_back("tiff_big_endian", SAME, lambda px: tiff.build(px, order=">", rows_per_strip=7))


@query(SAME)
def deflate_roundtrip(spark, sf):
    """Scanlines through the deflate codec and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["vals"] = [codecs.decode_deflate(codecs.encode_deflate(np.asarray(v, "u2"), ">"), len(v), "u2", ">").astype(int) for v in b["vals"]]
            yield b

    lines = B.mosaic_lines(spark, sf)
    return R.to_pixels(lines.mapInPandas(run, lines.schema)).select(*AT, F.col("value").cast("long").alias("v"))


@query(SAME)
def lossless_jpeg_roundtrip(spark, sf):
    """A tile for each scanline, coded with every prediction in turn and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, v in zip(b["row"], b["vals"], strict=True):
                tile = np.asarray(v, "u2").reshape(4, -1, 2)
                out.append(codecs.decode_lossless_jpeg(codecs.encode_lossless_jpeg(tile, 16, 1 + row % 7)).astype(int))
            b["vals"] = out
            yield b

    lines = B.mosaic_lines(spark, sf)
    return R.to_pixels(lines.mapInPandas(run, lines.schema)).select(*AT, F.col("value").cast("long").alias("v"))


@query(WITH + LINEAR + f' SELECT image_id, "row", col, {sql_q("CAST(CAST(x AS FLOAT) AS DOUBLE)", 1e5)} AS v FROM lin')
def predictor_float(spark, sf):
    """32-bit floats through the byte-plane predictor and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = np.stack([np.asarray(v, "f4") for v in b["vals"]])
            b["vals"] = list(codecs.undo_float(codecs.do_float(lines, 1), lines.shape[1], 4, 1).astype("f8"))
            yield b

    lines = R.to_scanlines(linear(spark, sf))
    return R.to_pixels(lines.mapInPandas(run, "image_id long, row int, plane int, vals array<double>")).select(*AT, q(F.col("value"), 1e5).alias("v"))


def _files(spark, sf):
    """A file for each image, of the size that all have: lines that the table lacks are blank."""
    return tiff.build(B.mosaic_pixels(spark, sf), size=(B.HEIGHT, B.WIDTH), rows_per_strip=16)


@query('WITH n AS (SELECT DISTINCT vec_id // 100 AS file_id FROM embeddings), t AS (SELECT * FROM (VALUES (254, 4, 1), (256, 4, 1), (257, 4, 1), (258, 3, 1), (259, 3, 1), (262, 3, 1), (273, 4, 7), (277, 3, 1), (278, 4, 1), (279, 4, 7), (284, 3, 1), (339, 3, 1)) v(tag, "type", "count")) SELECT file_id, tag, "type", CAST("count" AS BIGINT) AS "count" FROM n, t')
def ifd_entries(spark, sf):
    return tiff.entries(_files(spark, sf)).select("file_id", "tag", "type", "count")


@query("SELECT DISTINCT vec_id // 100 AS file_id, CAST(1 AS BIGINT) AS ifds, CAST(12 AS BIGINT) AS entries, 'main' AS role FROM embeddings")
def ifd_roles(spark, sf):
    return tiff.summary(tiff.entries(_files(spark, sf))).select("file_id", "ifds", "entries", F.array_join("roles", ",").alias("role"))


@query("SELECT DISTINCT vec_id // 100 AS file_id, CAST(64 AS BIGINT) AS width, CAST(100 AS BIGINT) AS height FROM embeddings")
def ifd_tags(spark, sf):
    """Sizes by tag, the numbers taken from the payloads in the JVM."""
    t = tiff.tags(tiff.entries(_files(spark, sf)), {"w": 256, "h": 257})
    return t.select("file_id", tiff.byte_at(F.col("w"), 0, 4).alias("width"), tiff.byte_at(F.col("h"), 0, 4).alias("height"))


def _whole_records(spark, sf):
    """Language, source and the whole text of each document, written as IIM blocks and read again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [metadata.iim_block([(5, x), (25, y), (120, z)]) for x, y, z in zip(b["lang"], b["source"], b["text"], strict=True)]
            yield pd.DataFrame({"file_id": b["doc_id"], "content": blocks})

    docs = B.read(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return metadata.iim_records(docs.mapInPandas(run, "file_id long, content binary"), join=True)


@query("SELECT doc_id AS file_id, CAST(0 AS INT) AS ord, 'title' AS name, lang AS text FROM documents UNION ALL SELECT doc_id, 1, 'keyword', source FROM documents UNION ALL SELECT doc_id, 2, 'description', text FROM documents")
def iptc_records(spark, sf):
    """All records with their whole texts, as they are read."""
    return _whole_records(spark, sf)


def _area(t=10, l=4, b=90, r=60, plane=0, planes=1, rp=2, cp=3) -> bytes:
    return struct.pack(">4i4I", t, l, b, r, plane, planes, rp, cp)


#: The gains of the list's map, as 32-bit floats have them.
GAINS_32 = [struct.unpack(">f", struct.pack(">f", g))[0] for g in GAINS]
LIST_2 = O.pack([(8, _area() + struct.pack(">I4d", 3, *POLY)), (99, b"unknown"), (9, _area(0, 0, 100, 64, 0, 1, 1, 1) + struct.pack(">2I4dI9f", 3, 3, 0.4, 0.45, 0.1, 0.05, 1, *GAINS)), (6, struct.pack(">4i", 2, 4, 98, 60))])
POLY_SQL = f"least(greatest({d(POLY[0])} + x * ({d(POLY[1])} + abs(x) * ({d(POLY[2])} + abs(x) * {d(POLY[3])})), {d(-1)}), {d(1)})"


@query(WITH + LINEAR + f', p AS (SELECT image_id, "row", col, CASE WHEN {IN_AREA} THEN {POLY_SQL} ELSE x END AS x FROM lin) SELECT image_id, "row" - 2 AS "row", col - 4 AS col, {sql_q(gain_sql("x", GAINS_32))} AS v FROM p WHERE "row" BETWEEN 2 AND 97 AND col BETWEEN 4 AND 59')
def opcode_list(spark, sf):
    """A parsed correction list folded over the raster: polynomial, an unknown entry, a gain map, trimming."""
    px, _ = O.apply(linear(spark, sf), O.parse(LIST_2), BOUNDS, 2)
    return px.select(*AT, q(F.col("value")).alias("v"))
