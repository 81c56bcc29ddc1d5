"""Sharding by vector bin packing: bytes, tokens and rows together, whole groups of equal texts.

1. Equal texts form a group. A group above a shard's share of all bytes, tokens or rows falls into pieces by a
   hash of doc_id, as no balance is possible with it whole; there are at most 3 * shards * SPLIT such groups.
2. Groups spread over ranges by hash. In each range, from the largest down, a group goes to the bin of the range
   where the dot product of its vector with the bin's residual capacity is highest.
3. The bins of RANGES ranges are packed into bins in the same way, and those, 1 for each RANGES * RANGE_GROUPS groups
   and shard, on the driver into the shards.
The law that holds is `bytes`: the shards' sizes are near equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelith import reachable
from pixelith.llm.common import hash_prefix, scratch, stored

#: A group above 1 / (shards * SPLIT) of the whole in any dimension is split.
SPLIT = 1
#: Groups in a range, and ranges whose bins are packed together.
RANGE_GROUPS, RANGES = 50_000, 1000
#: What counts as a token where no counts are given: up to six Latin, Greek or Cyrillic letters or three digits in a row, and
#: any other character that is no white space, so each one of scripts without spaces. About as many as a subword
#: vocabulary makes. Plain ranges, as classes of Unicode properties cost five times as much.
TOKEN = r"[A-Za-z\u00C0-\u024F\u0370-\u052F]{1,6}|[0-9]{1,3}|[^ \t-\r]"
#: How much the dimensions weigh in the dot product: bytes, tokens, rows.
WEIGHTS = np.array([1.0, 0.1, 0.1])


def pack(vectors: np.ndarray, bins: int, capacity: np.ndarray | None = None) -> np.ndarray:
    """The bin of each vector (n x d, non-negative), largest first. Ties go to the smaller bin.

    Residual capacity begins at an equal share of the sum for each bin (or as given, bins x d), measured in units
    of that share, and may turn negative.
    """
    n = len(vectors)
    share = np.maximum(vectors.sum(axis=0) / bins, 1e-12)
    scaled = vectors / share
    residual = np.ones((bins, vectors.shape[1])) if capacity is None else capacity / share
    weight = WEIGHTS[: vectors.shape[1]]
    order = np.lexsort((np.arange(n), -(scaled * weight).max(axis=1)))
    out = np.zeros(n, np.int64)
    rest = [r.tolist() for r in residual * weight]
    small = scaled.tolist()
    for i in order.tolist():
        v = small[i]
        best, at = -1e300, 0
        for b, r in enumerate(rest):
            dot = v[0] * r[0] + v[1] * r[1] + v[2] * r[2]
            if dot > best:
                best, at = dot, b
        out[i] = at
        r = rest[at]
        r[0] -= v[0] * weight[0]
        r[1] -= v[1] * weight[1]
        r[2] -= v[2] * weight[2]
    return out


def shard(docs: DataFrame, shards: int = 8, *, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes + 1), text_crc32, n_tokens, law, shard, slot and grown_shard (null here).

    tokens: the number of tokens of each row, such as token_counts gives; without, matches of TOKEN. A null text counts
    as an empty one: size 1, no tokens; a null number as 0. Rows with equal texts share a shard, but for split groups and
    rows whose numbers of tokens differ. Slots are gapless from 0 in each shard, in order of a hash of doc_id; rows of one
    doc_id follow one another in any order. An empty table gives an empty one. The driver gets 4 sums, and a vector for
    each RANGES * RANGE_GROUPS groups and shard.
    """
    reachable(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stored(_shard(docs, shards, text, tokens), "shards", keep=True)


def _shard(docs: DataFrame, shards: int, text: str, tokens: Column | None) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    count = F.regexp_count(t, F.lit(TOKEN)) if tokens is None else F.coalesce(tokens, F.lit(0))
    slim = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("_text"), count.cast("long").alias("n_tokens"))
    slim = stored(slim, "shard-rows")
    key = ["_text", "text_crc32", "size", "n_tokens"]
    groups = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    weight = [F.col("size") * F.col("_rows"), F.col("n_tokens") * F.col("_rows"), F.col("_rows")]
    total = groups.agg(*[F.sum(w).alias(n) for w, n in zip(weight, "btr", strict=True)], F.count(F.lit(1)).alias("g")).first()
    sums = [float(x or 1) for x in (total.b, total.t, total.r)]
    parts = max(1, -(-total.g // RANGE_GROUPS))
    most = F.greatest(*[w / s for w, s in zip(weight, sums, strict=True)]) * (shards * SPLIT)
    # at most 3 * shards * SPLIT groups: a bounded broadcast
    hot = groups.where((most > 1) & (F.col("_rows") > 1)).select(*key, F.ceil(most).cast("long").alias("_pieces"))
    rows = slim.join(F.broadcast(hot), key, "left").withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(F.expr("pmod(xxhash64(doc_id), coalesce(_pieces, 1))"))).drop("_pieces")
    key = [*key, "_piece"]
    units = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_range", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("long"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_text", "text_crc32", "size", "n_tokens", "_piece"], kind="stable", ignore_index=True)
        count = batch["_rows"].to_numpy(np.float64)
        batch["_bin"] = pack(np.stack([batch["size"].to_numpy() * count, batch["n_tokens"].to_numpy() * count, count], axis=1), shards).astype(np.int32)
        return batch

    def run_bins(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_range", "_bin"], ignore_index=True)
        batch["_top"] = pack(batch[["b", "t", "r"]].to_numpy(np.float64), shards).astype(np.int32)
        return batch

    schema = T.StructType([*units.schema.fields, T.StructField("_bin", T.IntegerType())])
    placed = stored(units.groupBy("_range").applyInPandas(run, schema), "shard-bins")
    bins = placed.groupBy("_range", "_bin").agg(*[F.sum(w).alias(n) for w, n in zip(weight, "btr", strict=True)]).withColumn("_super", F.expr(f"_range div {RANGES}"))
    bins = stored(bins.groupBy("_super").applyInPandas(run_bins, T.StructType([*bins.schema.fields, T.StructField("_top", T.IntegerType())])), "shard-super")
    tops = bins.groupBy("_super", "_top").agg(*[F.sum(n).alias(n) for n in "btr"]).toPandas().sort_values(["_super", "_top"], ignore_index=True)
    tops["shard"] = pack(tops[["b", "t", "r"]].to_numpy(np.float64), shards) if len(tops) else []
    final = docs.sparkSession.createDataFrame(tops[["_super", "_top", "shard"]].astype({"_super": "int64", "_top": "int32", "shard": "int32"}), "_super long, _top int, shard int")
    units = placed.join(bins.join(final, ["_super", "_top"]).select("_range", "_bin", "shard"), ["_range", "_bin"]).select(*key, "shard")
    done = stored(rows.join(units, key).select("doc_id", "size", "text_crc32", "n_tokens", "shard"), "shard-done")
    ranges = int(max(64, min(100_000, -(-int(total.r or 0) // 50_000))))
    ranked = hash_prefix(done, ["shard"], F.col("doc_id"), ranges, F.lit(1), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
