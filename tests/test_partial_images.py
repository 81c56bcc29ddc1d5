"""Queries against their SQL on a table whose last image lacks scanlines, as that of the grown tables does."""

import duckdb
import pytest

from pixelith.plans import catalog, containers, records  # noqa: F401
from tests.conftest import SF
from tests.test_catalog import same

NAMES = [
    "demosaic_bggr",
    "demosaic_grbg",
    "demosaic_bilinear",
    "pipeline_render",
    "render_stats",
    "rgb8_tiff_roundtrip",
    "row_col_deinterleave",
    "ifd_entries",
    "ifd_tags",
    "orientation_tags",
    "warp_rectilinear",
    "warp_rectilinear2",
    "warp_fisheye",
]


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """Image 0 is whole, image 1 has 56 scanlines of 100."""
    path = tmp_path_factory.mktemp("partial")
    duckdb.sql(f"copy (select * from '{SF}/embeddings.parquet' where vec_id < 156) to '{path}/embeddings.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_partial_image(spark, partial, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{partial}/embeddings.parquet'")
    got = catalog.QUERIES[name](spark, partial).toPandas()
    assert same(got, con.sql(catalog.SQL[name]).df()) == 0


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Image 0 is whole; image 1 lacks scanlines 20 to 29 and 50, and 24 numbers of its scanline 40."""
    path = tmp_path_factory.mktemp("gaps")
    vectors = "case when vec_id = 150 then null when vec_id = 140 then embedding[1:40] else embedding end as embedding"
    duckdb.sql(f"copy (select vec_id, {vectors} from '{SF}/embeddings.parquet' where vec_id < 200 and vec_id not between 120 and 129) to '{path}/embeddings.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["rgb8_tiff_roundtrip"])
def test_gaps(spark, gaps, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{gaps}/embeddings.parquet'")
    got = catalog.QUERIES[name](spark, gaps).toPandas()
    assert same(got, con.sql(catalog.SQL[name]).df()) == 0
