"""Mixing sources to target weights by a Pfair schedule.

While all sources last, a source with weight w of W has, in any t slots, w * t / W blocks due. As soon as the blocks due
of a source are all it has, the others share its part by their weights. Block i of a source is released at the slot in
which i blocks become due, and has its deadline at the end of the slot in which i + 1 are; each slot takes the released
block with the earliest deadline. What is due of all sources is one block a slot, so this meets every deadline, and at
any slot a source is less than one block away from what is due.

Weights are taken as they are, not rounded: a float is a fraction, and releases and deadlines are whole-number
arithmetic on such fractions. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith import reachable
from pixelith.llm.common import hash_prefix, scratch, spare, stored

#: The largest sources, whose numbers are broadcast; rows of the others get theirs by a shuffled join. All are scheduled alike.
MOST_SOURCES = 256
#: Bytes of a block.
BLOCK_BYTES = 1 << 18


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights; 0 for what is not positive."""
    parts = [(w if w > 0 else 0).as_integer_ratio() for w in weights]
    common = math.lcm(*(d for _, d in parts)) if parts else 1
    return [n * (common // d) for n, d in parts]


def period(weights: list[int]) -> list[list[int]]:
    """The slots of each source in sum(weights) slots, where each has as many blocks as its weight tells."""
    schedule = plan(weights, weights)
    starts, slots = schedule if schedule else ([0] * (len(weights) + 1), np.zeros(0, np.int64))
    return [slots[starts[s] : starts[s + 1]].tolist() for s in range(len(weights))]


def earliest_first(weights: list[int], blocks: list[int]) -> Iterator[int]:
    """The source of each slot; all weights and numbers of blocks are positive."""
    whole, scale = sum(weights), 1 << (2 * max(weights).bit_length() + 2)  # tells any two of the fractions block / weight apart
    order = sorted(range(len(weights)), key=lambda s: blocks[s] * scale // weights[s])
    ends = [blocks[s] * scale // weights[s] for s in order]
    gone, rest = [0], [whole]  # of the sources that end before: their blocks, and the weight of all others
    for s in order:
        gone.append(gone[-1] + blocks[s])
        rest.append(rest[-1] - weights[s])

    def due(i: int, w: int) -> tuple[int, int]:
        """When i blocks of a source of weight w are due: the last slot that begins before or then, the first one after or then."""
        k = bisect_right(ends, i * scale // w - 1)
        n = rest[k] * i
        return gone[k] + n // w, gone[k] - (-n // w)

    waiting = [(0, s, 0) for s in range(len(weights))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    for t in range(gone[-1]):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i + 1, weights[s])[1], s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (due(i + 1, weights[s])[0], s, i + 1))


def plan(weights: list[int], blocks: list[int]) -> tuple[np.ndarray, np.ndarray] | list:
    """The slots of all blocks, source by source, and where each source's begin in them; nothing for no blocks.

    Sources of weight 0 come when all others are done, in equal parts. 8 bytes a block; some microseconds each.
    """
    starts = np.concatenate([[0], np.cumsum(np.asarray(blocks, np.int64))]).astype(np.int64)
    if not starts[-1]:
        return []
    slots, t = np.empty(starts[-1], np.int64), 0
    at = starts[:-1].tolist()
    for some in ([s for s, w in enumerate(weights) if w and blocks[s]], [s for s, w in enumerate(weights) if not w and blocks[s]]):
        if not some:
            continue
        for which in earliest_first([weights[s] or 1 for s in some], [blocks[s] for s in some]):
            s = some[which]
            slots[at[s]] = t
            at[s] += 1
            t += 1
    return starts, slots


def place(schedule: tuple[np.ndarray, np.ndarray] | list, source: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The slot of each (source, block)."""
    if not schedule:
        return np.full(len(block), -1, np.int64)
    starts, slots = schedule
    return slots[starts[source] + block]


def numbered(rows: DataFrame, names: list[str | None]) -> DataFrame:
    """Adds the place in names of each row's source. The first MOST_SOURCES names, which may have most of the rows, go by a bounded broadcast."""
    session, of = rows.sparkSession, "_name string, number int"
    pairs = [(n, i) for i, n in enumerate(names)]
    most = F.broadcast(session.createDataFrame(pairs[:MOST_SOURCES], of))
    same = F.col("source").eqNullSafe(F.col("_name"))
    out = rows.join(most, same).drop("_name")
    if len(names) > MOST_SOURCES:
        others = session.createDataFrame(pd.DataFrame(pairs[MOST_SOURCES:], columns=["_name", "number"]), of)
        out = out.unionByName(rows.join(most, same, "left_anti").join(others, same).drop("_name"))
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, temperature: float = 0.5, block_bytes: int = BLOCK_BYTES, source: str = "source", text: str = "text") -> DataFrame:
    """Per row: doc_id, source, size (UTF-8 bytes + 1), block, slot and offset (bytes of the source before the row).

    In order of (slot, offset) the rows run through the sources at their target weights, by bytes, in blocks of
    block_bytes. weights: the target of each source (None is the key of a null source), 0 where it has none; without, a
    source's bytes to the power `temperature`. Every source is scheduled by itself; lane is its number by size,
    MOST_SOURCES for all beyond. A null source is a source, a null text counts as empty; a row with a text longer than
    a block fills several. Within a source the order is a hash of doc_id, then doc_id; rows of one doc_id follow one
    another in any order, and each counts. An empty table gives an empty one. The driver holds a name and a weight for
    each source and a slot for each block (8 bytes each; the workers have these, too).
    """
    with scratch(docs.sparkSession):
        return stored(_mix(docs, weights, temperature, block_bytes, source, text), "mixed", keep=True)


def _mix(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, block_bytes: int, source: str, text: str) -> DataFrame:
    session = docs.sparkSession
    reachable(session)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    slim = stored(docs.select("doc_id", F.col(source).alias("source"), size.alias("size")), "mix-rows")
    sums = slim.groupBy("source").agg(F.sum("size").alias("bytes"))
    sums = sums.orderBy(F.desc("bytes"), F.asc_nulls_first("source")).toPandas()
    names = [None if pd.isna(x) else x for x in sums["source"]]
    bytes_of = [int(x) for x in sums["bytes"]]
    if weights is None:
        target = [float(b) ** temperature for b in bytes_of]
    else:
        target = [weights.get(n, 0.0) for n in names]
    schedule = plan(exact(target), [-(-b // block_bytes) for b in bytes_of])
    rows = numbered(slim, names)
    ranges = int(max(256, min(100_000, sum(bytes_of) // (16 << 20))))
    placed = hash_prefix(rows, ["number"], F.col("doc_id"), ranges, F.col("size"), "offset").withColumn("block", F.expr(f"offset div {block_bytes}"))
    sent = session.sparkContext.broadcast(schedule)  # 8 bytes a block: 1 MB for 30 GB in blocks of 256 KiB

    @F.pandas_udf("long")
    def slot(number: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series(place(sent.value, number.to_numpy(np.int64), block.to_numpy(np.int64)))

    return placed.withColumn("slot", slot("number", "block")).withColumn("lane", F.least("number", F.lit(MOST_SOURCES))).select("doc_id", "source", "size", "lane", "block", "slot", "offset")


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, *, place: tuple[str, str] | None = None, **options) -> DataFrame:
    """The rows of docs, all columns, in mixed order: range-partitioned and sorted by (slot, offset).

    place: names for slot and offset, which then come before the columns of docs.

    Rows whose doc_id repeats are told apart by position in neither table, so they share the first one's place. The places
    grow with docs, so they are never broadcast, however few.
    """
    at, key = spare("_at", docs.columns), spare("_key", docs.columns)
    order = mix(docs, weights, **options).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "offset")).alias(at))
    joined = docs.join(order.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = [F.col(at)[field].alias(name) for field, name in zip(("slot", "offset"), place or ())]
    return joined.repartitionByRange(parts, at).sortWithinPartitions(at, "doc_id").select(*placed, *docs.columns)
