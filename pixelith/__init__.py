"""A Spark-native analytics engine for raster images and their tag metadata."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytecodes above which the JIT leaves a method alone, and it crawls.
JIT_LIMIT = "8000"


def small_methods(spark) -> None:
    """Has Spark generate code operator by operator, in small methods, where one method for all would pass JIT_LIMIT."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder the driver runs in."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
