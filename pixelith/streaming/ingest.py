"""Files that arrive over time: the operators of sources and plans on a stream of containers.

The batch operators are maps over rows, so they run on a stream as they are; statistics are kept per image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelith.sources import tiff

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, pattern: str = "*.tif*", files_per_batch: int = 64) -> DataFrame:
    """(file_id, modificationTime, content) of new files below a path; file_id is a hash of the path."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select(F.xxhash64("path").alias("file_id"), "modificationTime", "content")


def entries(files: DataFrame) -> DataFrame:
    """Tag entries of the files as they arrive; a broken file is a row with its error."""
    return tiff.entries(files)


def image_stats(files: DataFrame) -> DataFrame:
    """Count, extremes and sum of the samples of each image, for complete or update mode."""
    return tiff.samples(files).groupBy("image_id", "plane").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"))


def arrivals(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by window of modification time; a file later than `late` is left out."""
    timed = files.withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", window)).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("bytes"))
