"""Containers, codecs, metadata and correction lists on bytes made here."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelith.plans import opcodes as O
from pixelith.sources import codecs, metadata, tiff


def image(h=20, w=13, planes=1, kind="u2", seed=1):
    return np.random.default_rng(seed).integers(0, 4000, (h, w, planes)).astype(kind)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("layout", [{}, {"rows_per_strip": 3}, {"tile": (16, 8)}])
@pytest.mark.parametrize("code", [codecs.RAW, codecs.DEFLATE, codecs.JPEG])
@pytest.mark.parametrize("planes", [1, 3])
def test_image_round_trip(order, layout, code, planes):
    src = image(planes=planes)
    data = tiff.write([tiff.image_page(src, order=order, code=code, **layout)], order)
    c = tiff.parse(data)
    assert (tiff.read_image(data, c, c.ifds[0]) == src).all()
    again = tiff.rewrite(data)
    c = tiff.parse(again)
    assert (tiff.read_image(again, c, c.ifds[0]) == src).all()


def test_roles_and_sub_ifds():
    main = tiff.image_page(image())
    sub = tiff.image_page(image(4, 4), sub_type=4)
    preview = tiff.image_page(image(5, 5, 3, "u1"), sub_type=1)
    main.subs = [sub, tiff.image_page(image(6, 6), sub_type=4)]
    c = tiff.parse(tiff.write([main, preview]))
    assert tiff.roles(c) == {"main": [0], "mask": [1], "preview": [3]}
    assert [i.parent for i in c.ifds] == [None, 0, 0, None]


@pytest.mark.parametrize("data", [b"", b"II*\0", b"XX*\0\x08\0\0\0", b"II*\0\xff\xff\0\0", b"II*\0\x08\0\0\0\x05\0"])
def test_broken_files(data):
    with pytest.raises(tiff.FormatError):
        tiff.parse(data)


def test_circle():
    data = bytearray(tiff.write([tiff.Page([tiff.entry(256, 4, 1)])]))
    at = struct.unpack_from("<I", data, 4)[0]
    struct.pack_into("<I", data, at + 2 + 12, at)
    with pytest.raises(tiff.FormatError):
        tiff.parse(bytes(data))


def test_last_duplicate_wins():
    ifd = tiff.Ifd([tiff.entry(256, 4, 1), tiff.entry(256, 4, 7)])
    assert ifd.number(256, "<") == 7 and ifd.number(257, "<", 5) == 5


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 7), st.integers(1, 6), st.integers(1, 6), st.integers(1, 3), st.randoms(use_true_random=False))
def test_lossless_jpeg(mode, h, w, parts, rnd):
    src = np.array([[[rnd.choice((0, 1, 65535, 32768, rnd.randrange(65536))) for _ in range(parts)] for _ in range(w)] for _ in range(h)], "u2")
    assert (codecs.decode_lossless_jpeg(codecs.encode_lossless_jpeg(src, 16, mode)) == src.reshape(-1)).all()


def test_codec_errors():
    with pytest.raises(codecs.CodecError):
        codecs.decode(5, b"", 1, 1, 1, "u1", "<")
    with pytest.raises(codecs.CodecError):
        codecs.decode(codecs.DEFLATE, b"no", 1, 1, 1, "u1", "<")
    with pytest.raises(codecs.CodecError):
        codecs.decode_raw(b"\0", 2, "u2", "<")
    with pytest.raises(codecs.CodecError):
        codecs.sample_type(12, 1)
    assert codecs.jxl_kind(b"\xff\x0a..") == "codestream" and codecs.jxl_kind(b"..") is None


@pytest.mark.parametrize("kind", ["f2", "f4"])
@pytest.mark.parametrize("step", [1, 2])
def test_float_predictor(kind, step):
    lines = np.random.default_rng(2).standard_normal((5, 12)).astype(kind)
    assert (codecs.undo_float(codecs.do_float(lines, step), 12, lines.dtype.itemsize, step) == lines).all()
    whole = image(5, 12)[:, :, 0]
    assert (codecs.undo_horizontal(codecs.do_horizontal(whole, step), step) == whole).all()


def test_readers():
    ifd = tiff.Ifd([tiff.entry(50714, 5, [(64, 1), (0, 0)]), tiff.entry(50717, 4, 4095), tiff.entry(50719, 5, [(5, 2), (3, 1)]), tiff.entry(50720, 3, [90, 50]), tiff.entry(50829, 4, [0, 0, 52, 92]), tiff.entry(50728, 5, [(1, 2)] * 3), tiff.entry(50729, 5, [(3457, 10000), (3585, 10000)]), tiff.entry(50716, 5, [(1, 1)])])
    lin = metadata.linearization(ifd, "<")
    assert lin["black"] == [64.0, 0.0] and lin["white"] == [4095.0] and lin["delta_v"] is None
    active = metadata.active_area(ifd, "<")
    assert active == (0, 0, 52, 92) and metadata.default_crop(ifd, "<", active) == (2, 2, 52, 92)
    assert metadata.profile(ifd, "<")["neutral"] == []
    assert metadata.mosaic(ifd, "<") is None


def test_iim():
    block = b"junk" + metadata.iim_block([(5, "Titel"), (25, "eins"), (25, "zwei"), (199, "unknown")])
    assert metadata.iim(block) == [("title", "Titel"), ("keyword", "eins"), ("keyword", "zwei")]
    with pytest.raises(tiff.FormatError):
        metadata.iim(block[:-3])
    assert metadata.iim_date("20240131") == (2024, 1, 31) and metadata.iim_time("1") is None


def test_iim_keeps_long_texts():
    for text in ("é" * 40_000, "a" + "中" * 50_000, "x" * 65_534 + "\0" * 5 + "y", "x" * 65_535, "b" * 200_000):
        block = metadata.iim_block([(5, "Titel"), (120, text), (25, "eins"), (25, "zwei")])
        assert metadata.iim_joined(metadata.iim(block)) == [("title", "Titel"), ("description", text), ("keyword", "eins"), ("keyword", "zwei")]
    for dataset, text in ((25, "x" * 65_536), (120, "\0" * 70_000 + "x")):
        with pytest.raises(tiff.FormatError):
            metadata.iim_block([(dataset, text)])


def test_shown():
    assert metadata.shown(tiff.entry(270, 2, 'a"\n'), "<") == '"a\\"\\x0A"'
    assert metadata.shown(tiff.entry(258, 3, list(range(10))), "<", 3) == "[0, 1, 2, … (+7 more)]"
    assert metadata.shown(tiff.entry(50714, 5, [(1, 4)]), "<") == "[1/4 (0.25)]"


def test_opcode_lists():
    data = O.pack([(6, struct.pack(">4i", 0, 0, 1, 1)), (8, b"")])
    assert [o.id for o in O.parse(data)] == [6, 8]
    for bad in (data[:-1], data + b"\0", b"\0\0"):
        with pytest.raises(O.OpcodeError):
            O.parse(bad)


def test_a_registered_decoder_reaches_the_executors(spark, monkeypatch):
    monkeypatch.setattr(codecs, "REGISTERED", {})
    monkeypatch.setattr(codecs, "DECODERS", dict(codecs.DECODERS))
    codecs.register(codecs.JXL, lambda data, count, kind, order: np.full(count, data[0], kind))
    page = tiff.image_page(image(4, 4, kind="u1"), extra=[])
    page.entries = [tiff.entry(259, 3, codecs.JXL) if e.tag == 259 else e for e in page.entries]
    page.blobs = [bytes([42, 1, 2])]
    files = spark.createDataFrame([(1, bytearray(tiff.write([page])))], "file_id long, content binary")
    assert [r.value for r in tiff.samples(files).collect()] == [42.0] * 16


def test_more_ifds_than_a_chain_may_have():
    ten, eleven = (tiff.write([tiff.image_page(image(2, 2)) for _ in range(n)]) for n in (10, 11))
    assert len(tiff.parse(ten).ifds) == 10 and len(tiff.parse(tiff.rewrite(ten)).ifds) == 10
    with pytest.raises(tiff.FormatError):
        tiff.parse(eleven)


def test_scalars_of_wrong_type_or_count():
    for e in (tiff.Entry(254, 4, 0, b""), tiff.entry(254, 5, [(1, 1)]), tiff.entry(254, 4, [0, 1])):
        with pytest.raises(tiff.FormatError):
            tiff.Ifd([e]).role("<")


def test_entries_of_broken_files(spark):
    files = spark.createDataFrame([(1, bytearray(tiff.write([tiff.image_page(image())]))), (2, bytearray(b"no")), (3, None)], "file_id long, content binary")
    got = tiff.entries(files).groupBy("file_id").count().collect()
    assert dict(map(tuple, got)) == {1: 12, 2: 1, 3: 1}
