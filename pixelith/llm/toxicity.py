"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is taken by its characters: letters of any script in lower case, all other characters of the basic plane spaces,
runs of spaces one space. Its features are the distinct n-grams of characters, hashed into 2 ** BITS places. Training
takes the place's log ratio of smoothed document frequencies in the two classes, r, then fits a logistic regression on
r-scaled presence. Both run on a bounded sample of labelled rows, on the driver; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelith.llm.common import arrow_limits, distinct, expand, passes, scratch, spare, squeeze, stored, text_buffers

BITS = 22
SIZES = (3, 5, 7)
#: Tasks that count the training sample's places, and the parts that the places fall into to be added up.
BAG_TASKS, SLICES = 12, 16
#: Characters whose n-grams are hashed at once.
SLAB = 1 << 20
MULTIPLY, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def fold() -> np.ndarray:
    """For each character of the basic plane: itself in lower case if it is a letter, else a space."""
    low = [chr(c).lower() if chr(c).isalpha() else " " for c in range(1 << 16)]
    return np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)


def folded(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of several texts, each with a space before and after, and the text of each character."""
    n = len(ends) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
    sizes = np.diff(chars) + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    out = np.full(at[-1], 32, np.uint32)
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    out[inside] = np.where(points < 1 << 16, fold()[np.minimum(points, (1 << 16) - 1)], points)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (owner[1:] != owner[:-1])
    return out[keep], owner[keep]


def places(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram, SLAB by SLAB: the place and the text of every n-gram, repeats included."""
    text, owner = folded(raw, ends)
    with np.errstate(over="ignore"):
        for n in SIZES:
            for at in range(0, len(text) - n + 1, SLAB):
                code = text[at : at + SLAB + n - 1].astype(np.uint64)
                whose = owner[at : at + SLAB + n - 1]
                m = len(code) - n + 1
                mixed_ = np.zeros(m, np.uint64)
                for k in range(n):
                    mixed_ = mixed_ * MULTIPLY + code[k : k + m]
                mixed_ = (mixed_ + np.uint64(n)) * FINISH
                mixed_ ^= mixed_ >> np.uint64(32)
                whole = whose[:m] == whose[n - 1 :]
                yield ((mixed_ * FINISH) >> np.uint64(64 - BITS))[whole].astype(np.int64), whose[:m][whole].astype(np.int64)


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct places of each text."""
    raw, ends = text_buffers(column)
    out: list[np.ndarray] = []
    for a, b in passes(ends):
        some = ends[a : b + 1] - ends[a]
        got = list(places(raw[ends[a] : ends[b]], some))
        key = distinct(np.concatenate([w << BITS | p for p, w in got])) if got else np.zeros(0, np.int64)
        out += np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, b - a)))
    return out


@dataclass
class Model:
    """weight: of each place (r times the regression's coefficient), 32-bit; bias."""

    weight: np.ndarray
    bias: float

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The places that weigh something, their weights, the bias: what goes to the executors."""
        used = np.flatnonzero(self.weight)
        return used, self.weight[used], float(self.bias)

    @classmethod
    def dense(cls, used: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        whole = np.zeros(1 << BITS, np.float32)
        whole[used] = weights
        return cls(whole, bias)

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, ends = text_buffers(column)
        z = np.full(len(ends) - 1, self.bias)
        for a, b in passes(ends):
            keys = []
            for place, who in places(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]):
                hit = np.flatnonzero(self.weight[place])  # most n-grams weigh nothing
                keys.append(who[hit] << BITS | place[hit])
            if keys:
                key = distinct(np.concatenate(keys))
                z[a:b] += np.bincount(key >> BITS, self.weight[key & ((1 << BITS) - 1)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def ratios(c1: np.ndarray, c0: np.ndarray, n1: float, n0: float, *, alpha: float = 1.0, least: float = 12.0) -> np.ndarray:
    """The log-count ratio of each place, from its document frequencies among n1 texts of label 1 and n0 of label 0.

    0, so out of the model, where the frequencies tell too little: a log-likelihood ratio (G squared) below `least`.
    """
    n = max(n1 + n0, 1)
    out = np.zeros(len(c1), np.float32)

    def part(seen, due):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0)

    for at in range(0, len(c1), 1 << 18):  # a part at a time: the driver's memory is small
        a, b = c1[at : at + (1 << 18)].astype(np.float64), c0[at : at + (1 << 18)].astype(np.float64)
        share = (a + b) / n
        told = 2 * (part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
        r = np.log((a + alpha) / (n1 + 2 * alpha)) - np.log((b + alpha) / (n0 + 2 * alpha))
        out[at : at + (1 << 18)] = np.where(told < least, 0, r)
    return out


def fit(bags: list[np.ndarray], labels: np.ndarray, r: np.ndarray, *, l2: float = 0.02, rounds: int = 200, least: float = 0.02) -> Model:
    """The model from bags of places, 0/1 labels and the places' ratios. Weights below `least` of the largest become 0.

    One class only, or no rows: a constant score on that class's side.
    """
    size = 1 << BITS
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 4.0 if len(labels) and labels[0] else -4.0)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    flat, owner = np.concatenate(bags).astype(np.int64), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    hit = r[flat] != 0
    flat, row = flat[hit], owner[hit]
    used, column = np.unique(flat, return_inverse=True)
    value = r[flat]
    # full-batch gradient steps with Nesterov's momentum on the mean logistic loss, classes weighted alike
    cost = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(used)), 0.0
    vw, vb = w.copy(), 0.0
    square = np.bincount(row, value**2, minlength=len(labels))
    rate = 1 / (0.25 * (cost * (square + 1)).sum() + l2 * 1e-3)
    for k in range(rounds):
        z = np.bincount(row, value * vw[column], minlength=len(labels)) + vb
        g = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        gw, gb = np.bincount(column, value * g[row], minlength=len(used)) + l2 * 1e-3 * vw, g.sum()
        nw, nb = vw - rate * gw, vb - rate * gb
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    weight = np.zeros(size, np.float32)
    weight[used] = w * r[used]
    weight[np.abs(weight) < least * np.abs(weight).max()] = 0
    z = np.bincount(row, weight[flat], minlength=len(labels))
    # the bias half way between the classes, at the fewest errors on the sample
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    edges = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    cut = edges[best].mean() if np.ptp(best) == len(best) - 1 else edges[best[len(best) // 2]]
    scale = 6.0 / max(1e-9, np.percentile(np.abs(z - cut), 50))
    return Model((weight * scale).astype(np.float32), float(-cut * scale))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, toxic_rows: int = 2500, clean_rows: int = 5000, label: str = "toxic") -> Model:
    """Fits on a sample of the labelled rows that `allowed` admits: at most toxic_rows and clean_rows of each class.

    The sample is the first rows in order of a hash of doc_id, so it is the same in every run. A label that is
    null or not 0 or 1 is left out; of several labels of a document the greatest holds; a document without a text
    counts as an empty one. Executors make the sample's bags, count its places and find those that tell the classes
    apart; the driver holds these, and their parts of the bags.
    """
    arrow_limits(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _train(docs, labels, allowed, toxic_rows, clean_rows, label)


def _train(docs: DataFrame, labels: DataFrame, allowed: Column, toxic_rows: int, clean_rows: int, label: str) -> Model:
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64("doc_id")
    some = known.where("_y = 1").orderBy(order, "doc_id").limit(toxic_rows).union(known.where("_y = 0").orderBy(order, "doc_id").limit(clean_rows))
    # toxic_rows + clean_rows rows of two numbers: a bounded broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "_y", "text").repartition(BAG_TASKS, "doc_id")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [b.astype("<u4").tobytes() for b in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), "<u2")
        for batch in batches:
            for y, b in zip(batch.column("y").to_pylist(), batch.column("bag"), strict=True):
                counts[y][np.frombuffer(b.as_buffer(), "<u4")] += 1
        if counts.any():
            parts = counts.reshape(2, SLICES, -1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([squeeze(parts[:, i].tobytes()) for i in range(SLICES)], pa.binary())})

    def tell(group: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(expand(x.as_buffer()), "<u2").reshape(2, -1).astype(np.int32) for x in group.column("counts"))
        r = ratios(c[1], c[0], n.get(1, 0), n.get(0, 0))
        used = np.flatnonzero(r)
        return pa.table({"place": used + group.column("slice")[0].as_py() * len(r), "r": r[used]})

    bags = stored(chosen.mapInArrow(bag, "doc_id long, y int, bag binary"), "toxicity-bags")
    n = {row.y: row["count"] for row in bags.groupBy("y").count().collect()}
    # the places that tell the classes apart, some thousands to some hundred thousands
    told = bags.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(tell, "place long, r float").toArrow()
    r = np.zeros(1 << BITS, np.float32)
    r[told.column("place").to_numpy()] = told.column("r").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(r != 0))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            kept = [b[tells[b]].tobytes() for b in (np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("bag"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(kept, pa.binary())], names=["doc_id", "y", "bag"])

    rows = bags.mapInArrow(telling, bags.schema).toArrow().sort_by("doc_id")
    return fit([np.frombuffer(b.as_py(), "<u4") for b in rows.column("bag")] or [np.zeros(0, "<u4")], rows.column("y").to_numpy(), r)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the model's score of each whole text, 0 to 1; a null text scores as an empty one, equal texts alike.

    Repeated rows stay, an empty table stays empty; a column that is called like `out` gives way to the score. A worker
    holds a pass of texts, or one longer text, in some 20 bytes for each of its own.
    Other columns pass through (keep: only those). Nothing but the text enters. The places that weigh something, some
    thousands at any size of the corpus, go to each task; all others drop out before repeats are removed.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(model.sparse())
    names = [c for c in (keep if keep is not None else docs.columns) if c != out]
    column = spare("_scored", names)
    work = docs.select(*names, F.col(text).alias(column))
    schema = work.drop(column).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.dense(*sent.value)
        for batch in batches:
            z = m.scores(batch.column(column))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(z, pa.float64())], names=schema.names)

    return work.mapInArrow(run, schema)
