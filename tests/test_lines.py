"""The stages on scanlines against those on samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelith.functions import pixels as P
from pixelith.operators import lines as L
from pixelith.operators import raster as R
from pixelith.operators import tone
from tests.test_raster import pixels

BOUNDS = (0, 0, 70, 21)


@pytest.fixture(scope="module")
def raw(spark):
    return R.to_scanlines(pixels(spark, np.random.default_rng(1).integers(0, 4096, (70, 21)).astype(float))).cache()


def line(df, name, image_id=0):
    return np.stack([r[1] for r in sorted((r["row"], r[name]) for r in df.where(F.col("image_id") == image_id).select("row", name).collect())])


def grid(df, name):
    rows = df.select("row", "col", name).collect()
    out = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1))
    for r, c, v in rows:
        out[r, c] = v
    return out


def test_maps(raw):
    px = R.to_pixels(raw)
    linear = L.linearize(raw, black=64.0, white=4095.0)
    value = P.linearize(F.col("value"), black=64.0, white=4095.0)
    assert np.allclose(line(linear, "vals"), grid(px.withColumn("value", value), "value"), atol=1e-6)
    c, k = [0.01, 0.9, -0.05, 0.12], [0.3, -0.05, 0.02, 0.01, -0.004]
    assert np.allclose(line(L.polynomial(linear, c), "vals"), grid(px.withColumn("value", P.polynomial(value, c)), "value"), atol=1e-6)
    shaded = P.vignette(value, F.col("row"), F.col("col"), BOUNDS, (0.55, 0.45), k)
    assert np.allclose(line(L.vignette(linear, BOUNDS, (0.55, 0.45), k), "vals"), grid(px.withColumn("value", shaded), "value"), atol=1e-5)
    assert L.vignette(linear, BOUNDS, (0.5, 0.5), [0.0] * 5) is linear
    with pytest.raises(ValueError):
        L.linearize(raw, black=5.0, white=5.0)


@pytest.mark.parametrize("pattern", [(0, 1, 1, 2), (1, 0, 2, 1)])
def test_render(spark, raw, pattern):
    m, knots = [[0.5, 0.3, 0.1], [0.2, 0.9, -0.1], [0.0, 0.1, 0.8]], [(0.0, 0.0), (0.18, 0.25), (0.5, 0.62), (1.0, 1.0)]
    linear = L.linearize(raw, black=64.0, white=4095.0)
    wide, want = L.demosaic(linear, pattern), R.demosaic(raw.withColumn("vals", F.transform("vals", lambda v: P.linearize(v, black=64.0, white=4095.0))), pattern)
    for n in "rgb":
        assert np.allclose(line(wide, n), grid(want, n), atol=1e-6)
    rgb = [P.tone_curve(c, knots) for c in P.matrix([F.col(c) for c in "rgb"], m, 0.5)]
    want = want.select("row", "col", *[c.alias(n) for c, n in zip(P.tone_map(rgb), "rgb", strict=True)])
    got = L.tone_map(L.tone_curve(L.matrix(wide, m, 0.5), knots))
    for n in "rgb":
        assert np.allclose(line(got, n), grid(want, n), atol=1e-4)
    codes = L.quantize(got)
    for n in "rgb":
        assert (line(L.render(raw, black=64.0, white=4095.0, m=m, exposure=0.5, knots=knots, pattern=pattern), n) == line(codes, n)).all()
        assert np.abs(line(codes, n) - grid(want.select("row", "col", P.quantize(F.col(n)).alias(n)), n)).max() <= 1


def test_quantize_is_exact_at_every_code(spark):
    x = np.concatenate([np.linspace(-0.1, 1.1, 20_001), np.arange(0, 400) / 1e5]).astype(np.float32)
    df = spark.createDataFrame([(0, 0, x.tolist(), x.tolist(), x.tolist())], "image_id long, row int, r array<float>, g array<float>, b array<float>")
    c = np.clip(x.astype(float), 0, 1)
    want = np.floor(np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055) * 255 + 0.5)
    got = np.array(L.quantize(df).first().r)
    assert (got == want).mean() > 0.9995 and np.abs(got - want).max() <= 1


@pytest.mark.parametrize("shape", [(6, 4, 1), (5, 3, 3), (1, 2, 1)])
def test_hue_tables(spark, shape):
    rng = np.random.default_rng(1)
    deltas = [(rng.normal(0, 5), *rng.uniform(0.5, 1.5, 2)) for _ in range(shape[0] * shape[1] * shape[2])]
    rgb = np.concatenate([rng.random((200, 3)), [[0, 0, 0], [1, 1, 1], [-0.1, 0.5, 2.0], [0.5, 0.5, 0.1]]]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rgb)], "id int, r double, g double, b double")
    want = tone.hue_sat(df, deltas, shape).orderBy("id").toPandas()[["r", "g", "b"]].to_numpy()
    wide = spark.createDataFrame([(0, 0, *[v.tolist() for v in rgb.T])], "image_id long, row int, r array<float>, g array<float>, b array<float>")
    got = L.hue_sat(wide, deltas, shape).first()
    assert np.allclose(np.array([got.r, got.g, got.b]).T, want, atol=2e-5)


def test_two_images(spark, raw):
    both = raw.unionByName(raw.withColumn("image_id", F.lit(1).cast("long")))
    wide = L.demosaic(both)
    assert wide.count() == 140 and (line(wide, "g", 0) == line(wide, "g", 1)).all()
