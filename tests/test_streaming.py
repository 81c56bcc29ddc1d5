"""A stream of containers gives what the batch operators give."""

import numpy as np

from pixelith.sources import tiff
from pixelith.streaming import ingest


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 100, (5, 4, 1)).astype("u2") for _ in range(3)]
    for i, image in enumerate(images):
        (tmp_path / f"{i}.tif").write_bytes(tiff.write([tiff.image_page(image)]))
    (tmp_path / "broken.tif").write_bytes(b"no")
    files = ingest.arriving(spark, f"file://{tmp_path}", files_per_batch=2)
    q = ingest.entries(files).writeStream.format("memory").queryName("tags").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tags").where("error is not null").count() == 1
    assert spark.table("tags").where("tag = 256").count() == 3
    (tmp_path / "broken.tif").unlink()
    q = ingest.image_stats(ingest.arriving(spark, f"file://{tmp_path}", files_per_batch=2)).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.total for r in spark.table("stats").collect()) == sorted(float(i.sum()) for i in images)
