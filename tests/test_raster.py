"""Operators on tiny rasters with answers that can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelith.functions import colour
from pixelith.functions import pixels as P
from pixelith.operators import raster as R
from pixelith.operators import tone
from pixelith.operators import warp as W


def pixels(spark, image, image_id=0):
    image = np.asarray(image)
    if image.ndim == 2:
        image = image[:, :, None]
    data = [(image_id, r, c, p, image[r, c, p].item()) for r, c, p in np.ndindex(image.shape)]
    return spark.createDataFrame(data, "image_id long, row int, col int, plane int, value " + ("double" if image.dtype.kind == "f" else "long"))


def grid(df, name="value"):
    rows = df.select("row", "col", name).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for r, c, v in rows:
        out[r, c] = v
    return out


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_linearize(spark):
    got = values(spark, *[P.linearize(F.lit(v), black=64.0, white=4095.0) for v in (64, 0, 4095, 5000)])
    assert got[0] == 0 and got[1] < 0 and got[2] == pytest.approx(1) and got[3] == 1
    assert values(spark, *[P.linearize(F.lit(v), white=6.0, lut=[0, 2, 4, 6]) for v in (1, 3, 9)]) == pytest.approx([2 / 6, 1, 1])
    with pytest.raises(ValueError):
        P.linearize(F.lit(1), black=5.0, white=5.0)


def test_polynomial_is_odd_in_the_magnitude(spark):
    got = values(spark, P.polynomial(F.lit(-0.5), [0.1, 0.5, 0.2]), P.polynomial(F.lit(0.5), [0.1, 0.5, 0.2]), P.polynomial(F.lit(9.0), [0.0, 1.0]))
    assert got == pytest.approx([0.1 - 0.5 * 0.6, 0.1 + 0.5 * 0.6, 1.0])


def test_tone(spark):
    got = values(spark, P.s_curve(F.lit(0.0)), P.s_curve(F.lit(1.0)), P.reinhard(F.lit(1.0)), P.hdr_decode(P.hdr_encode(F.lit(3.0))), P.srgb_gamma(F.lit(0.001)), P.quantize(F.lit(1.5)), P.quantize(F.lit(-1.0)))
    assert got == pytest.approx([0.03, 0.03 + 0.97 / 1.08, 0.5, 3.0, 0.01292, 255, 0])


def test_hue_sat_map_identity(spark):
    same = [(0.0, 1.0, 1.0)] * 24
    for rgb in ((0.2, 0.5, 0.1), (0.9, 0.1, 0.4), (0.3, 0.3, 0.3), (0.0, 0.2, 0.8)):
        for shape in ((6, 4, 1), (4, 3, 2)):
            assert values(spark, *P.hue_sat_map([F.lit(x) for x in rgb], same, shape)) == pytest.approx(rgb)


@pytest.mark.parametrize("shape", [(6, 4, 1), (5, 3, 3), (1, 2, 1)])
def test_hue_tables_as_steps_and_as_one_expression(spark, shape):
    rng = np.random.default_rng(1)
    deltas = [(rng.normal(0, 5), *rng.uniform(0.5, 1.5, 2)) for _ in range(shape[0] * shape[1] * shape[2])]
    df = spark.createDataFrame([(i, *map(float, rng.random(3))) for i in range(50)] + [(50, 0.0, 0.0, 0.0), (51, 1.0, 1.0, 1.0), (52, -0.1, 0.5, 2.0)], "id int, r double, g double, b double")
    steps = tone.hue_sat(df, deltas, shape).orderBy("id").collect()
    whole = df.select("id", *[c.alias(n) for c, n in zip(P.hue_sat_map([F.col(c) for c in "rgb"], deltas, shape), "rgb", strict=True)]).orderBy("id").collect()
    assert np.allclose(np.array(steps), np.array(whole))


@pytest.mark.parametrize("size", [(8, 8), (9, 7), (130, 4)])
def test_demosaic_of_grey_is_grey(spark, size):
    lines = R.to_scanlines(pixels(spark, np.full(size, 0.25)))
    wide = R.demosaic(lines)
    for c in "rgb":
        assert (grid(wide, c) == 0.25).all()


def test_demosaic_red_only(spark):
    image = np.zeros((6, 6))
    image[::2, ::2] = 1.0
    wide = R.demosaic(R.to_scanlines(pixels(spark, image)))
    assert (grid(wide, "r") == 1).all() and (grid(wide, "b") == 0).all()


def test_demosaic_needs_four_colours(spark):
    with pytest.raises(ValueError):
        R.demosaic(R.to_scanlines(pixels(spark, np.zeros((4, 4)))), (0, 1))


def test_crop_and_trim(spark):
    image = np.arange(30).reshape(5, 6)
    assert (grid(R.crop(pixels(spark, image), 1, 2, 4, 5)) == image[1:4, 2:5]).all()
    with pytest.raises(ValueError):
        R.crop(pixels(spark, image), 3, 0, 3, 2)
    with pytest.raises(ValueError):
        R.trim_bounds(pixels(spark, image), (0, 0, 6, 2), (0, 0, 5, 6))


def test_area_pitch(spark):
    got = pixels(spark, np.zeros((6, 6))).where(R.area((0, 0, 6, 6), (1, 1, 6, 6), pitch=(2, 3))).select("row", "col").collect()
    assert sorted(map(tuple, got)) == [(r, c) for r in (1, 3, 5) for c in (1, 4)]
    with pytest.raises(ValueError):
        R.area((0, 0, 6, 6), pitch=(2, 1))


def test_bad_pixels(spark):
    image = np.arange(36).reshape(6, 6) + 100
    image[2, 2] = 0
    want = image.copy()
    want[2, 2] = (image[1, 1] + image[1, 3] + image[3, 1] + image[3, 3] + 2) // 4
    assert (grid(R.fix_constant(pixels(spark, image), 0)) == want).all()
    beside = image.copy()
    beside[2, 2] = (image[0, 2] + image[4, 2] + image[2, 0] + image[2, 4] + 2) // 4
    assert (grid(R.fix_constant(pixels(spark, image), 0, phase=1)) == beside).all()
    listed = grid(R.fix_list(pixels(spark, image), [(2, 2)], [(0, 0, 1, 1)]))
    assert listed[2, 2] == want[2, 2] and listed[0, 0] == image[1, 1]


def test_bad_pixel_without_good_neighbours_stays(spark):
    assert (grid(R.fix_constant(pixels(spark, np.zeros((3, 3), int)), 0)) == 0).all()


def test_deinterleave(spark):
    image = np.arange(35).reshape(7, 5)
    stored = np.concatenate([image[f::3] for f in range(3)])
    stored = np.concatenate([stored[:, f::2] for f in range(2)], axis=1)
    assert (grid(R.deinterleave(pixels(spark, stored), 3, 2, 7, 5)) == image).all()


def test_opaque_rect(spark):
    mask = np.full((6, 8), 255)
    mask[0, 3] = mask[2, 0] = 0
    got = R.opaque_rect(pixels(spark, mask), 255.0).first()
    assert tuple(got) == (0, 1, 1, 6, 7) or tuple(got)[1] >= 1
    t, l, b, r = tuple(got)[1:]
    assert (mask[t:b, l:r] == 255).all()
    assert R.opaque_rect(pixels(spark, np.zeros((3, 3), int)), 255.0).count() == 0


def test_warp_identity_and_shift(spark):
    rng = np.random.default_rng(1)
    image = rng.random((16, 12))
    same = pixels(spark, image)
    assert W.warp(same, (0, 0, 16, 12), W.Rectilinear([1.0, 0.0, 0.0, 0.0])) is same
    got = grid(W.warp(same, (0, 0, 16, 12), W.Rectilinear2([1.0] + [0.0] * 14, (1e-12, 0.0))))
    assert np.allclose(got[2:9, 2:6], image[2:9, 2:6], atol=0.2)
    with pytest.raises(ValueError):
        W.warp(pixels(spark, np.zeros((4, 4))), (0, 0, 4, 4), W.Fisheye([1.0, 0, 0, 0]))


def test_warp_of_a_flat_image_is_flat(spark):
    got = grid(W.warp(pixels(spark, np.full((20, 20), 0.5)), (0, 0, 20, 20), W.Fisheye([1.0, 0.1, 0.0, 0.0])))
    assert np.allclose(got, 0.5)


def test_temperature_round_trip():
    for kelvin in (2000, 2856, 4000, 5003, 6504, 9000, 15000):
        for tint in (-20, 0, 15):
            k, t = colour.to_temperature(colour.from_temperature(kelvin, tint))
            assert k == pytest.approx(kelvin, rel=2e-3) and t == pytest.approx(tint, abs=0.5)


def test_matrices():
    m = colour.adaptation(colour.WHITE["D50"], colour.WHITE["D65"])
    assert np.allclose(m @ colour.xyz(colour.WHITE["D50"]), colour.xyz(colour.WHITE["D65"]))
    assert colour.bracket(4000, [6504, 2856]) == (1, 0) and colour.bracket(100, [6504, 2856]) == (1, 1)
    assert colour.lower_weight(2856, 2856, 6504) == 1 and colour.lower_weight(9000, 2856, 6504) == 0
    with pytest.raises(ValueError):
        colour.invert(np.zeros((3, 3)))
    assert colour.rational(0.125) == (125, 1000) and colour.as_real(1, 0) == 0.0
