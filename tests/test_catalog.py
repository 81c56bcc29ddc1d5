"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from pixelith.plans import catalog, containers  # noqa: F401
from tests.conftest import SF


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True).astype(str) for x in (a, b))
    assert len(a) == len(b)
    return int((a != b).any(axis=1).sum())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.SQL:
        assert same(got, duck.sql(catalog.SQL[name]).df()) == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("parts", ["1", "7", "32"])
def test_partitions_do_not_matter(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = catalog.QUERIES["pipeline_render"](spark, SF).toPandas()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = catalog.QUERIES["pipeline_render"](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert same(want, got) == 0
