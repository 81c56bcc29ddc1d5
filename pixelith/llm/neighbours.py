"""Approximate nearest neighbours: p-stable hashing with probes in order of their estimated success.

A table has K random directions; along each the line is cut at the sample's median, floor((a . v + b) / width) held to
two cells, so a vector's cell is K bits. A neighbour's place along a direction is normal around `slope` times the
query's, as pairs of the sample have it, so the chance that it lies in a cell is a product of K normal probabilities.
A query visits cells in descending order of that chance until they hold `share` of it: those whose log chance is above
a threshold, which two halves of the directions tell without listing 2 ** K cells. What the tables find is merged and
ranked by exact distances.

Cells that agree in their leading directions lie side by side in a block of about BLOCK vectors, so a query goes only to
blocks that can hold a cell it visits; a run of cells with more vectors than that is split by a hash of vec_id. A block
gets its vectors and each query that has a probe in it, once, and returns the query's nearest there: no pairs leave a
block but k per query. Queries that find fewer than k, or whose k-th is farther than the index was made for, look
everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelith.llm.common import arrow_limits, mixed, scratch, stored

#: Vectors that fit an index (medians, slopes, the neighbours' distance): the first in order of a hash of vec_id.
SAMPLE = 4000
#: Vectors in a block, 4 MB of them at 64 dimensions, and queries that a block takes at once. Larger blocks need fewer copies of queries.
BLOCK, QUERIES = 16_000, 256
#: Directions of a table; leading ones, by which blocks are told apart: as many as the blocks need, no more than this.
DIRECTIONS, LEADING = 24, 12
#: Of the sample's k-th distances: the part from which pairs are fitted, and the distance that the index is made for.
FITTED, MADE_FOR = 0.75, 0.95
_ERF = np.vectorize(erf, otypes=[float])


def spread_out(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The log chance of each cell of some directions (n x m log chances of 1 and of 0), the first the highest bit."""
    out = np.zeros((len(one), 1))
    for j in range(one.shape[1]):
        out = (out[:, :, None] + np.stack([zero[:, j], one[:, j]], axis=1)[:, None, :]).reshape(len(one), -1)
    return out


@dataclass
class Index:
    """directions: tables x K x dimensions; middle: tables x K, the medians; slope, spread: of each table's pairs."""

    directions: np.ndarray
    middle: np.ndarray
    slope: np.ndarray
    spread: np.ndarray
    radius: float
    share: float
    leading: int

    def project(self, v: np.ndarray, t: int) -> np.ndarray:
        return v @ self.directions[t].T - self.middle[t]

    def bits(self, v: np.ndarray, t: int) -> np.ndarray:
        return self.project(v, t) > 0

    def runs(self, v: np.ndarray, t: int) -> np.ndarray:
        """The leading bits of each vector's cell, as a number."""
        return self.bits(v, t)[:, : self.leading] @ (1 << np.arange(self.leading)[::-1])

    def chances(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and direction, the log chance that a neighbour's bit is 1, and that it is 0."""
        p = 0.5 * (1 + _ERF(self.slope[t] * self.project(q, t) / (self.spread[t] * np.sqrt(2))))
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return np.log(p), np.log1p(-p)

    def thresholds(self, one: np.ndarray, zero: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query: the log chance down to which cells hold `share` together, and per run of cells its best one's."""
        half = one.shape[1] // 2
        high, low = spread_out(one[:, :half], zero[:, :half]), -np.sort(-spread_out(one[:, half:], zero[:, half:]), axis=1)
        held = np.concatenate([np.zeros((len(low), 1)), np.cumsum(np.exp(low), axis=1)], axis=1)
        out = np.empty(len(one))
        for i in range(len(one)):
            lo, hi = -28.0 * one.shape[1], 0.0
            for _ in range(30):
                at = (lo + hi) / 2
                some = np.searchsorted(-low[i], high[i] - at, "right")
                lo, hi = (at, hi) if np.exp(high[i]) @ held[i][some] >= share else (lo, at)
            out[i] = lo
        rest = np.maximum(one, zero)[:, self.leading :].sum(axis=1)
        return out, spread_out(one[:, : self.leading], zero[:, : self.leading]) + rest[:, None]


def fit(sample: np.ndarray, rows: int, *, k: int = 10, tables: int = 3, share: float = 0.5, seed: int = 7) -> Index:
    """An index for `rows` vectors from a sample of them. The sample's k-th neighbours are farther than those of the whole
    table, so chances are estimated from below; pairs are taken where neighbours are far, as tight groups are easy."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    leading = int(np.clip(np.ceil(np.log2(max(rows, 1) / BLOCK)) + 3, 1, LEADING))
    directions = rng.standard_normal((tables, DIRECTIONS, d))
    some = sample[:256]
    square = (sample**2).sum(axis=1)
    gaps = np.maximum(square[: len(some), None] + square[None] - 2 * some @ sample.T, 0)
    gaps[np.arange(len(some)), np.arange(len(some))] = np.inf
    near = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, max(len(sample) - 1, 1))]
    last = np.sqrt(np.take_along_axis(gaps, near[:, -1:], axis=1)[:, 0])
    last = np.where(np.isfinite(last), last, 0.0)
    far = last >= (np.quantile(last[last > 0], FITTED) if (last > 0).any() else 0)
    middle, slope, spread = [], [], []
    for a in directions:
        place = sample @ a.T
        middle.append(np.median(place, axis=0))
        place = place - middle[-1]
        x, y = np.repeat(place[: len(some)][far], near.shape[1], axis=0).reshape(-1), place[near[far].reshape(-1)].reshape(-1)
        slope.append(float(x @ y / max(x @ x, 1e-30)))
        spread.append(max(float(np.sqrt(((y - slope[-1] * x) ** 2).mean())), 1e-9))
    radius = float(np.quantile(last, MADE_FOR))
    return Index(directions, np.array(middle), np.array(slope), np.array(spread), radius, share, leading)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null, not zero, and has finite components only."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def search(base: DataFrame, is_query, *, k: int = 10, vector: str = "embedding", tables: int = 3, share: float = 0.53) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` admits, its k nearest among the rows of other vec_id.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Queries for which the probes
    find fewer than k search every cell, so each has k results or all there are. Unusable vectors (see usable())
    take no part, nor do those whose length is not the most frequent one, as a distance needs equal lengths; a vec_id
    that is null takes none either, and equal rows of one vec_id count once. An empty table gives an empty result.
    """
    with scratch(base.sparkSession):
        return stored(_search(base, is_query, k, vector, tables, share), "neighbours", keep=True)


def _search(base: DataFrame, is_query, k: int, vector: str, tables: int, share: float) -> DataFrame:
    spark = base.sparkSession
    arrow_limits(spark)
    kind = np.dtype("<f4") if base.schema[vector].dataType.elementType.typeName() == "float" else np.dtype("<f8")
    element = "float" if kind.itemsize == 4 else "double"
    rows = usable(base.where(F.col("vec_id").isNotNull()).withColumns({"_q": F.coalesce(is_query, F.lit(False))}).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("v"), "_q"), "v")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths.d)
    asked = rows.where("_q")

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)

    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = fit(np.array(some.column("v").to_pylist(), np.float64).reshape(-1, lengths.d), lengths.n, k=k, tables=tables, share=share)
    runs = 1 << index.leading

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors(batch).astype(np.float64)
            for t in range(tables):
                run, n = np.unique(index.runs(v, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(run), pa.array(n)], names=["t", "run", "n"])

    sizes = np.zeros((tables, runs), np.int64)  # tables * 2 ** LEADING numbers at most
    for r in rows.select("v").mapInArrow(counted, "t int, run long, n long").groupBy("t", "run").agg(F.sum("n").alias("n")).collect():
        sizes[r.t, r.run] = r.n
    parts = np.maximum(1, -(-sizes // BLOCK))  # blocks of a run by itself
    first = np.zeros_like(sizes)  # its first block; small runs share one
    for t in range(tables):
        block, held = 0, 0
        for i, (n, p) in enumerate(zip(sizes[t].tolist(), parts[t].tolist(), strict=True)):
            if held and held + n > BLOCK:
                block, held = block + 1, 0
            first[t, i] = block
            held += n
            if p > 1:
                block, held = block + p, 0
    sent = spark.sparkContext.broadcast((index, first, parts))

    def dealt(everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, first, parts = sent.value
            for batch in batches:
                v, ids = vectors(batch), batch.column("vec_id").to_numpy()
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                for t in range(1 if everything else tables):
                    at = index.runs(v.astype(np.float64), t)
                    block = first[t][at] + (mixed(ids.astype(np.uint64)) % parts[t][at].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(block.astype(np.int32)), pa.array(ids), raw], names=["t", "block", "vec_id", "v"])

        return run

    def probed(everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, first, parts = sent.value
            for batch in batches:
                raw, ids = vectors(batch), batch.column("vec_id").to_pylist()
                for a in range(0, len(ids), QUERIES):
                    v = raw[a : a + QUERIES].astype(np.float64)
                    out: dict[str, list] = {"t": [], "block": [], "vec_id": [], "least": [], "v": []}
                    for t in range(1 if everything else tables):
                        least, best = (np.full(len(v), -np.inf), np.zeros((len(v), runs))) if everything else index.thresholds(*index.chances(v, t), index.share)
                        for i in range(len(v)):
                            open_ = np.flatnonzero(best[i] >= least[i])
                            p = parts[t][open_]
                            blocks = np.unique(np.repeat(first[t][open_], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p))
                            out["t"] += [t] * len(blocks)
                            out["block"] += blocks.tolist()
                            out["vec_id"] += [ids[a + i]] * len(blocks)
                            out["least"] += [least[i]] * len(blocks)
                            out["v"] += [raw[a + i].tobytes()] * len(blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(out["t"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["vec_id"], pa.int64()), pa.array(out["least"], pa.float64()), pa.array(out["v"], pa.binary())], names=["t", "block", "vec_id", "least", "v"])

        return run

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float, int]] = []
        if len(left) and len(right):
            index = sent.value[0]
            t = int(left["t"].iloc[0])
            ids, v = left["vec_id"].to_numpy(), np.frombuffer(b"".join(left["v"]), kind).reshape(len(left), -1).astype(np.float64)
            bits = index.bits(v, t).astype(np.float64)
            for a in range(0, len(right), QUERIES):
                some = right.iloc[a : a + QUERIES]
                asked = np.frombuffer(b"".join(some["v"]), kind).reshape(len(some), -1).astype(np.float64)
                one, zero = index.chances(asked, t)
                visited = (one - zero) @ bits.T + zero.sum(axis=1)[:, None] >= some["least"].to_numpy()[:, None] - 1e-9
                for q, row, hit in zip(some["vec_id"].tolist(), asked, visited, strict=True):
                    at = np.flatnonzero(hit & (ids != q))
                    if not len(at):
                        continue
                    looked = len(at)
                    score = np.sqrt(((v[at] - row) ** 2).sum(axis=1))
                    _, once = np.unique(ids[at], return_index=True)
                    at, score = at[once], score[once]
                    if len(at) > k:  # ties with the k-th stay until they are ordered by vec_id
                        close = score <= np.partition(score, k - 1)[k - 1]
                        at, score = at[close], score[close]
                    best = np.lexsort((ids[at], score))[:k]
                    found += [(q, int(i), float(s), looked if n == 0 else 0) for n, (i, s) in enumerate(zip(ids[at][best], score[best], strict=True))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "looked"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "looked": "int64"})

    def results(queries: DataFrame, everything: bool) -> DataFrame:
        left = rows.select("vec_id", "v").mapInArrow(dealt(everything), "t int, block int, vec_id long, v binary")
        right = queries.select("vec_id", "v").mapInArrow(probed(everything), "t int, block int, vec_id long, least double, v binary")
        pairs = left.groupBy("t", "block").cogroup(right.groupBy("t", "block")).applyInPandas(nearest, "query_id long, vec_id long, score double, looked long")
        best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("looked").alias("looked"))
        place = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = best.withColumns({"rank": F.row_number().over(place), "looked": F.sum("looked").over(Window.partitionBy("query_id"))})
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "looked")

    found = stored(results(asked, False), "neighbours")
    enough = min(k, lengths.n - 1)
    fine = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far")).where((F.col("n") >= enough) & (F.col("far") <= index.radius))
    short = stored(asked.join(fine, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "v"), "far-queries")
    if not short.isEmpty():
        rest = results(short, True)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").select(*rest.columns).unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score", F.col("looked").alias("n_distances"))
