"""python -m pixelith.cli FILES --out DIR: tags, stages or pictures of containers, as Parquet or TIFF."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelith.functions.colour import OUTPUT
from pixelith.plans import develop
from pixelith.sources import codecs, metadata, tiff


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pixelith", description=__doc__)
    p.add_argument("path")
    p.add_argument("--pattern", default="*.tif*")
    p.add_argument("--out", help="folder for Parquet, or for TIFF files with --tif")
    what = p.add_mutually_exclusive_group()
    what.add_argument("--tags", action="store_true", help="tags as text (the default)")
    what.add_argument("--summary", action="store_true", help="a row for each file")
    what.add_argument("--rewrite", action="store_true", help="(file_id, content) rows: the containers written again")
    what.add_argument("--stage", type=int, choices=(1, 2, 3))
    what.add_argument("--picture", action="store_true")
    p.add_argument("--tif", action="store_true", help="write (file_id, content) rows with a TIFF each")
    p.add_argument("--space", choices=sorted(OUTPUT), default="srgb")
    p.add_argument("--hdr", action="store_true")
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--timing", action="store_true", help="seconds of each step")
    return p.parse_args(argv)


#: The exit code of each kind of error, 100 and its place in the list of error kinds (fixed values); others: 1.
EXITS = {develop.NotYet: 101, tiff.FormatError: 106, codecs.CodecError: 106, develop.Unsupported: 115}


class Timer:
    """Seconds of each step, where they are asked for."""

    def __init__(self, wanted: bool):
        self.wanted, self.began, self.steps = wanted, time.perf_counter(), []

    def lap(self, name: str) -> None:
        now = time.perf_counter()
        self.steps.append((name, now - self.began))
        self.began = now

    def show(self) -> None:
        if self.wanted:
            for name, seconds in [*self.steps, ("total", sum(s for _, s in self.steps))]:
                print(f"pixelith: {name:<12} {seconds:8.3f} s", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").getOrCreate()
    timer = Timer(a.timing)
    try:
        files = tiff.files(spark, a.path, a.pattern).select(F.xxhash64("path").alias("file_id"), "content")
        if a.rewrite:
            out = tiff.rewritten(files)
        elif a.stage or a.picture:
            out = develop.develop(files, a.stage) if a.stage else develop.develop(files, space=a.space, hdr=a.hdr)
            if a.tif:
                long = out if a.stage else out.select("image_id", "row", "col", F.posexplode(F.array("r", "g", "b")).alias("plane", "value"))
                kind = "f4" if a.hdr or (a.stage or 0) > 1 else "u2" if a.stage else "u1"
                out = tiff.build(long, kind, develop.orientations(files))
        elif a.summary:
            out = tiff.summary(tiff.entries(files))
        else:
            out = metadata.dump(files)
        timer.lap("plan")
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        else:
            out.show(50, truncate=60)
        timer.lap("run")
    except AnalysisException as e:
        print(f"pixelith: {e}", file=sys.stderr)
        return 2 if e.getCondition() == "PATH_NOT_FOUND" else 1
    except (*EXITS, ValueError) as e:
        print(f"pixelith: {e}", file=sys.stderr)
        return next((code for kind, code in EXITS.items() if isinstance(e, kind)), 1)
    timer.show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
