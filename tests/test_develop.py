"""Container to picture, and the command line."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelith import cli
from pixelith.functions import colour
from pixelith.plans import develop as D
from pixelith.plans import opcodes as O
from pixelith.sources import synthetic, tiff
from tests.test_raster import grid


def raw(height=20, width=16, *, extra=(), photometric=D.CFA, seed=1):
    image = np.random.default_rng(seed).integers(64, 4095, (height, width, 1)).astype("u2")
    tags = [tiff.entry(33421, 3, [2, 2]), tiff.entry(33422, 1, [0, 1, 1, 2]), tiff.entry(50714, 5, [(64, 1)]), tiff.entry(50717, 4, 4095), *extra]
    return image, tiff.write([tiff.image_page(image, photometric=photometric, extra=tags)])


def rows(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")


def test_stages(spark):
    image, data = raw()
    files = rows(spark, data)
    assert (grid(D.develop(files, 1)) == image[:, :, 0]).all()
    assert np.allclose(grid(D.develop(files, 2)), (image[:, :, 0] - 64) / (4095 - 64))
    three = D.develop(files, 3)
    red = grid(three.where("plane = 0"))
    assert np.allclose(red[::2, ::2], ((image[:, :, 0] - 64) / (4095 - 64))[::2, ::2])
    out = D.develop(files).collect()
    assert len(out) == 320 and all(0 <= v <= 255 for r in out for v in (r.r, r.g, r.b))


def test_lists_and_crops_apply(spark):
    scale = struct.pack(">4i4I", 0, 0, 20, 16, 0, 1, 1, 1) + struct.pack(">I1d", 0, 0.25)
    extra = [tiff.entry(51009, 7, O.pack([(8, scale)])), tiff.entry(50829, 4, [2, 2, 18, 14]), tiff.entry(50719, 3, [1, 1]), tiff.entry(50720, 3, [8, 10])]
    _, data = raw(extra=extra)
    assert np.allclose(grid(D.develop(rows(spark, data), 2)), 0.25)
    got = D.develop(rows(spark, data)).agg(F.max("row"), F.max("col"), F.countDistinct("r")).first()
    assert tuple(got) == (9, 7, 1)


def test_each_header_has_its_plan(spark):
    (a, x), (b, y) = raw(seed=2), raw(12, 10, seed=3)
    got = D.develop(rows(spark, x, y), 1)
    assert (grid(got.where("image_id = 0")) == a[:, :, 0]).all() and (grid(got.where("image_id = 1")) == b[:, :, 0]).all()


def test_metadata_beyond_the_first_bytes_counts(spark):
    def scaled(by):
        lists = O.pack([(8, struct.pack(">4i4I", 0, 0, 20, 16, 0, 1, 1, 1) + struct.pack(">I1d", 0, by))])
        return raw(extra=[tiff.entry(37500, 7, bytes(9000)), tiff.entry(51009, 7, lists)])[1]

    x, y = scaled(0.25), scaled(0.5)
    assert x[:4096] == y[:4096] and x != y
    got = D.develop(rows(spark, x, y), 2)
    assert np.allclose(grid(got.where("image_id = 0")), 0.25) and np.allclose(grid(got.where("image_id = 1")), 0.5)


def test_samples_make_no_group(spark):
    (_, x), (_, y), (_, z) = raw(seed=2), raw(seed=3), raw(12, 10)
    found = {r.file_id: r.plan for r in D.settings(rows(spark, x, y, z)).collect()}
    assert found[0] == found[1] != found[2]


def test_unsupported(spark):
    _, data = raw(photometric=1)
    with pytest.raises(D.NotYet):
        D.develop(rows(spark, data))
    with pytest.raises(ValueError):
        D.develop(rows(spark))


def test_synthetic(spark):
    g = grid(synthetic.gradient(spark, 3, 5, 100).where("plane = 0"))
    assert (np.diff(g, axis=1) > 0).all() and g[0, -1] == 100
    board = grid(synthetic.checkerboard(spark, 8, 8, 2, 9, 1))
    assert board[0, 0] == 9 and board[0, 2] == 0 and board[2, 2] == 9
    disc = grid(synthetic.circle(spark, 16, planes=1))
    assert disc[8, 8] == 0 and disc[0, 0] == synthetic.MOST and (disc == disc.T).all()
    frame = grid(synthetic.bordered(spark, 20, 4, 10, 2, planes=1))
    assert (frame == 0).sum() == 36 and frame[0, 0] == round(0.15 * synthetic.MOST)
    assert synthetic.stripes(spark, 4, 4).count() == 16


def test_cli(spark, tmp_path):
    image, data = raw()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(data)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert cli.main([src, "--out", out], spark) == 0
    assert spark.read.parquet(out).where("tag = 256").count() == 1
    assert cli.main([src, "--stage", "1", "--tif", "--out", out], spark) == 0
    back = bytes(spark.read.parquet(out).first().content)
    c = tiff.parse(back)
    assert (tiff.read_image(back, c, c.ifds[0]) == image).all()
    assert cli.main([src, "--picture", "--space", "p3", "--out", out], spark) == 0


def shot(*extra, size=(4, 6), value=(900, 600, 300), mask=None):
    """Three planes of one colour, with a profile, and a mask as a sub-IFD."""
    image = np.broadcast_to(np.array(value, "u2"), (*size, 3)).copy()
    page = tiff.image_page(image, photometric=D.LINEAR, extra=[tiff.entry(50717, 4, 1000), *extra])
    if mask is not None:
        page.subs = [tiff.image_page(mask[:, :, None], sub_type=4)]
    return tiff.write([page])


def diagonal(*on):
    return [(round(1000 * on[i]), 1000) if i == j else (0, 1) for i in range(3) for j in range(3)]


CALIBRATED = [tiff.entry(50778, 3, 17), tiff.entry(50779, 3, 21), tiff.entry(50964, 10, diagonal(0.9, 1.0, 0.7)), tiff.entry(50965, 10, diagonal(0.95, 1.0, 0.85))]


def profile(*extra):
    data = shot(*CALIBRATED, *extra)
    return D.read_meta(data).profile


def test_temperature_of_a_neutral():
    assert D.shot_kelvin(profile()) == 6500.0
    warm, cool = (D.shot_kelvin(profile(tiff.entry(50728, 5, [(a, 10), (8, 10), (b, 10)]))) for a, b in ((10, 6), (6, 10)))
    assert warm < 3500 < 8000 < cool
    kelvin = colour.settle_temperature([1.0, 1.0, 1.0], lambda _: np.eye(3))
    assert 5200 < kelvin < 5700 and colour.settle_temperature([0, 0, 0], lambda _: np.eye(3)) == 6500.0
    white = D.shot_kelvin(profile(tiff.entry(50729, 5, [(3457, 10000), (3585, 10000)])))
    assert 4900 < white < 5100


def test_matrix_of_a_shot():
    """A white becomes even; its neutral comes from the matrix; a calibration is undone."""
    p = profile(tiff.entry(50729, 5, [(3457, 10000), (3585, 10000)]))
    kelvin = D.shot_kelvin(p)
    plain = colour.camera_to_xyz(kelvin, [2856.0, 6504.0], None, [np.diag([0.9, 1, 0.7]), np.diag([0.95, 1, 0.85])])
    neutral = colour.invert(plain) @ colour.xyz((0.3457, 0.3585))
    assert np.allclose(D.camera_matrix(p) @ (neutral / neutral.max()), np.diag(plain))
    other = profile(tiff.entry(50729, 5, [(3457, 10000), (3585, 10000)]), tiff.entry(50723, 10, diagonal(2.0, 1.0, 1.0)), tiff.entry(50727, 5, [(1, 1), (1, 1), (4, 1)]))
    assert np.allclose(np.diag(D.camera_matrix(other)), np.diag(D.camera_matrix(p)) / [2, 1, 4])
    assert np.allclose(D.camera_matrix({}), np.eye(3))
    only = [tiff.entry(50778, 3, 21), tiff.entry(50721, 10, diagonal(2.0, 1.0, 1.0))]
    got = D.camera_matrix(D.read_meta(shot(*only)).profile)
    want = colour.adaptation(colour.from_temperature(6504.0), colour.WHITE["D50"]) @ np.diag([0.5, 1, 1])
    assert np.allclose(got, want)


def test_two_illuminants_in_the_middle():
    low, high = 2856.0, 6504.0
    middle = 2 / (1 / low + 1 / high)
    a, b = np.diag([1.0, 2.0, 3.0]), np.diag([3.0, 4.0, 5.0])
    assert np.allclose(colour.camera_to_xyz(middle, [low, high], None, [a, b]), (a + b) / 2)
    assert np.allclose(colour.between(middle, [low, high], [a, b]), (a + b) / 2) and np.allclose(colour.between(middle, [low, high], [None, b]), b)
    with pytest.raises(ValueError):
        colour.camera_to_xyz(middle, [low, high], [a, None], [a, None])


def test_shots_of_one_camera_share_a_plan(spark):
    neutrals = [[(a, 10), (10, 10), (b, 10)] for a, b in ((5, 7), (6, 6), (9, 4))]
    files = rows(spark, *[shot(*CALIBRATED, tiff.entry(50728, 5, n), tiff.entry(50730, 10, [(i, 2)])) for i, n in enumerate(neutrals)])
    found = D.settings(files).collect()
    assert len({r.plan for r in found}) == 1 and len({tuple(r.matrix) for r in found}) == 3 and [r.gain for r in sorted(found)] == [1.0, 2**0.5, 2.0]
    got = {r.image_id: (r.r, r.g, r.b) for r in D.develop(files, hdr=True).where("row = 0 and col = 0").collect()}
    for r in found:
        want = colour.to_output("srgb") @ np.reshape(r.matrix, (3, 3)) @ [0.9, 0.6, 0.3] * r.gain
        assert np.allclose(got[r.file_id], want)


def test_hue_tables_of_two_lights(spark):
    dims = [tiff.entry(50937, 4, [1, 2, 1])]
    first, second = [(0.0, 1.0, 1.0)] * 2, [(0.0, 1.0, 3.0)] * 2
    tables = [tiff.entry(t, 11, [x for e in table for x in e]) for t, table in ((50938, first), (50939, second))]
    white = tiff.entry(50729, 5, [(3457, 10000), (3585, 10000)])
    files = rows(spark, shot(*CALIBRATED, *dims, *tables, white), shot(*CALIBRATED, white))
    known = {r.file_id: r for r in D.settings(files).collect()}
    got = {r.image_id: np.array([r.r, r.g, r.b]) for r in D.develop(files, hdr=True, space="prophoto").where("row = 0 and col = 0").collect()}
    w = known[0].weight
    assert 0.05 < w < 0.95 and np.allclose(got[0], got[1] * (w * 1.0 + (1 - w) * 3.0))


def test_mask_cuts_and_composites(spark):
    solid, framed, soft = (np.full((4, 6), v, "u1") for v in (255, 255, 100))
    framed[0], framed[:, 5] = 0, 10
    files = rows(spark, shot(mask=solid), shot(mask=framed), shot(mask=soft), shot())
    got = {r.image_id: r for r in D.develop(files).groupBy("image_id").agg(F.max("row").alias("row"), F.max("col").alias("col"), F.min("r").alias("r"), F.max("r").alias("most")).collect()}
    assert [(got[i].row, got[i].col) for i in range(4)] == [(3, 5), (1, 4), (3, 5), (3, 5)], "row 3 goes, too: its hole in the last column is there in the first round"
    plain = got[3].r
    assert got[0].r == got[1].r == plain and got[2].r == got[2].most == int(100 / 255 * plain + (1 - 100 / 255) * 255 + 0.5)


def test_a_file_that_needs_a_newer_reader(spark):
    files = rows(spark, shot(), shot(tiff.entry(50707, 1, [1, 8, 0, 0])))
    with pytest.raises(D.Unsupported):
        D.develop(files)
    assert D.develop(files, on_error="skip").select("image_id").distinct().count() == 1


def test_broken_files_among_whole_ones(spark):
    files = rows(spark, shot(), b"II*\0\x08\0\0\0", b"", shot()[:-4])
    assert {r.file_id for r in tiff.failures(files).collect()} >= {1, 2}
    assert D.develop(files, 1, on_error="skip").where("image_id = 0").count() == 72
    with pytest.raises(tiff.FormatError):
        D.develop(files, 1)


def test_tiles_are_put_side_by_side(spark):
    image = np.random.default_rng(1).integers(0, 999, (37, 29, 2)).astype("u2")
    files = rows(spark, tiff.write([tiff.image_page(image, tile=(16, 16), code=8)]))
    lines = {(r.row, r.plane): r.vals for r in tiff.scanlines(files).collect()}
    assert len(lines) == 74 and all((np.array(v) == image[row, :, plane]).all() for (row, plane), v in lines.items())
    assert tiff.parts(files).count() == 6


def test_exit_codes_and_orientation(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(shot(tiff.entry(274, 3, 6)))
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert cli.main([src, "--picture", "--tif", "--out", out, "--timing"], spark) == 0
    assert "total" in capsys.readouterr().err
    back = tiff.parse(bytes(spark.read.parquet(out).first().content))
    assert back.ifds[0].number(274, back.order) == 6 and back.ifds[0].number(262, back.order) == 2
    for flag in ("--summary", "--rewrite", "--tags"):
        assert cli.main([src, flag, "--out", out], spark) == 0
    (tmp_path / "in" / "b.tif").write_bytes(b"no")
    assert cli.main([src, "--stage", "1", "--out", out], spark) == 106
    (tmp_path / "in" / "b.tif").write_bytes(shot(tiff.entry(50707, 1, [2, 0, 0, 0])))
    assert cli.main([src, "--picture", "--out", out], spark) == 115
    assert cli.main([f"file://{tmp_path}/nowhere", "--out", out], spark) == 2
