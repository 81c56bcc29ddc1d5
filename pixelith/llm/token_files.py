"""Token ids as files: encoding, fixed-width bit packing in blocks, vectorised unpacking and random access.

The format. A file set is a Parquet table; each row is a block:
    block_start long     position of the block's first id among all ids
    n_ids int            ids in the block
    bits int             width of an id: the fewest bits that hold every id of the vocabulary
    doc_ids array<long>, doc_starts array<int>   the documents that begin in the block, and where
    packed binary        the ids, little-endian, bit i of id j at bit j * bits + i
A block holds whole documents, as many as fit in BLOCK_IDS; a longer document has a block of its own.
As the width is fixed, id j is found at bit j * bits; a position among all ids is found by its block's start.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelith.llm.common import arrow_limits, scratch, shared_dir, stored
from pixelith.llm.token_counts import LATER, SPACE, byte_symbols

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 16
KNOWN_WORDS = 800_000
#: Words as byte-level vocabularies of this family cut them (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The letters, numbers and white space of Latin-1 (fixed values).
LATIN = ("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0")


def in_classes(letters: str, numbers: str, space: str) -> str:
    """PATTERN with these classes written out."""
    to = {r"[^\s\p{L}\p{N}]": f"[^{space}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\s": f"[{space}]", r"\S": f"[^{space}]"}
    return re.sub("|".join(map(re.escape, to)), lambda m: to[m[0]], PATTERN)


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a little-endian bit string of bits per id."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """count ids from position start on; only the bytes that hold them are touched."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    if bits in (16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, start * (bits // 8)).astype(np.uint32)
    at = start * bits + np.arange(count, dtype=np.int64) * bits
    raw = np.frombuffer(packed, np.uint8)
    lo, hi = int(at[0] >> 3), int(((at[-1] + bits - 1) >> 3) + 1)
    raw = np.concatenate([raw[lo:hi], np.zeros(8, np.uint8)])
    byte, shift = (at >> 3) - lo, (at & 7).astype(np.uint64)
    word = sum(raw[byte + k].astype(np.uint64) << np.uint64(8 * k) for k in range(5))
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class WordIds(dict):
    """The ids of a word as little-endian u32 bytes; a word not known yet goes through the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokens = model.tokenize
        self.names = dict(enumerate(byte_symbols()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = [t.id for t in self.tokens(word.encode().decode("latin-1").translate(self.names))]
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids of texts as the tokenizers library gives them: its merges never cross words, so each word is encoded once,
    as long as a worker's memory of KNOWN_WORDS lasts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]) + 1
        self.words = WordIds(self.tokenizer.model)
        self.any = regex.compile(in_classes(r"\p{L}", r"\p{N}", SPACE)).findall
        self.latin = re.compile(in_classes(*LATIN)).findall
        self.marks = [t["content"] for t in spec["added_tokens"]]

    def find(self, text: str) -> list[str]:
        """The words of a text without characters from LATER; the faster module splits what is Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(m in text for m in self.marks) or (not text.isascii() and LATER(text)):  # the library's own cutting
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.find(text)))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCKS = T.StructType([
    T.StructField("block_start", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("bits", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_starts", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType()),
])


#: Ranges that the quantile sketch cuts, at most.
MOST_RANGES = 20_000


def ranges(df: DataFrame, key: str, size: Column, rows: int, most: int) -> list:
    """Splitters that cut df by key into ranges of about `most` bytes, or of 1 / MOST_RANGES of all.

    A quantile sketch of the keys gives ranges of about `rows` rows, and one aggregate the bytes of each; neighbours
    are then put together. What comes to the driver is a number for each of MOST_RANGES ranges at most.
    """
    n = df.count()
    parts = max(1, min(MOST_RANGES, -(-n // rows)))
    if parts == 1:
        return []
    cuts = df.select(F.col(key).cast("double").alias("_k")).approxQuantile("_k", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = sorted({int(c) for c in cuts})
    sums = in_ranges(df.select(F.col(key).cast("long").alias(key), size.cast("long").alias("_size")), key, cuts).groupBy("part").agg(F.sum("_size").alias("n")).collect()
    bytes_of = {r.part: r.n for r in sums}
    most = max(most, sum(bytes_of.values()) // MOST_RANGES)
    out, held = [], 0
    for part, cut in enumerate(cuts):
        held += bytes_of.get(part, 0)
        if held + bytes_of.get(part + 1, 0) > most:
            out.append(cut)
            held = 0
    return out


def in_ranges(df: DataFrame, key: str, cuts: list) -> DataFrame:
    """Adds part, the number of splitters up to the key; a null key comes before all."""
    if not cuts:
        return df.withColumn("part", F.lit(0))
    splits = [-float("inf"), *map(float, cuts), float("inf")]
    work = df.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(-float("inf"))))
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_part").transform(work).withColumn("part", F.col("_part").cast("int")).drop("_at", "_part")


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, *, text: str = "text", end_id: int = 0, range_rows: int = 2000, range_bytes: int = 16 << 20) -> None:
    """Encodes every text, appends end_id to each, and writes the ids in ascending doc_id order to path.

    Two written steps. First each range of doc_ids, about range_bytes of text or one doc_id's, is encoded by a task of
    its own, which streams it, and packed into blocks numbered within the range; then the blocks' starts come from a
    running sum over the ranges, whose totals are as many as there are ranges, and over the blocks within each range. A
    null text has the end id only. Rows with a null doc_id sort first. Ties of doc_id follow the text; repeated rows
    stay. An empty table gives an empty file set.
    """
    with scratch(docs.sparkSession):
        _write_ids(docs, tokenizer_path, path, text, end_id, range_rows, range_bytes)


def _write_ids(docs: DataFrame, tokenizer_path: str, path: str, text: str, end_id: int, range_rows: int, range_bytes: int) -> None:
    spark = docs.sparkSession
    arrow_limits(spark)
    cuts = ranges(docs, "doc_id", F.coalesce(F.octet_length(text), F.lit(0)) + 1, range_rows, range_bytes)
    work = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", cuts).select("part", "doc_id", "text")
    bits = width(encoder(tokenizer_path).vocabulary)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("sum_before", T.LongType()), *BLOCKS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        state = {"part": None, "block": 0, "before": 0}
        held: list[bytes] = []
        ids: list = []
        starts: list[int] = []
        size = 0

        def flush():
            nonlocal held, ids, starts, size
            row = {"part": [state["part"]], "block": [state["block"]], "sum_before": [state["before"]], "block_start": [0], "n_ids": [size], "bits": [bits], "doc_ids": [ids], "doc_starts": [starts], "packed": [pack(np.frombuffer(b"".join(held), "<u4"), bits)]}
            state["block"] += 1
            state["before"] += size
            held, ids, starts, size = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=ARROW)

        for batch in batches:
            for p, d, t in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                if ids and (p != state["part"]):
                    yield flush()
                if p != state["part"]:
                    state.update(part=p, block=0, before=0)
                coded = e.encode(t) + end
                if ids and size + len(coded) // 4 > BLOCK_IDS:
                    yield flush()
                ids.append(d)
                starts.append(size)
                held.append(coded)
                size += len(coded) // 4
        if ids:
            yield flush()

    ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("sum_before", pa.int64()), ("block_start", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("packed", pa.binary())])
    n = len(cuts) + 1
    blocks = stored(work.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text").mapInArrow(run, schema), "token-ranges")
    sums = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = sums.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    # one row for each range, 20,000 at most: a bounded broadcast
    done = blocks.join(F.broadcast(before), "part").withColumn("block_start", F.col("part_start") + F.col("sum_before"))
    done.select(*BLOCKS.names).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file set, as written."""
    return spark.read.schema(BLOCKS).parquet(path)


def slice_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Random access: count ids from a position among all ids; reads the blocks that hold them only."""
    rows = read_ids(spark, path).where((F.col("block_start") < start + count) & (F.col("block_start") + F.col("n_ids") > start)).orderBy("block_start").collect()
    parts = []
    for r in rows:
        lo, hi = max(0, start - r.block_start), min(r.n_ids, start + count - r.block_start)
        parts.append(unpack(bytes(r.packed), r.bits, lo, hi - lo))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def documents_of(blocks: DataFrame) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, unpacked from the blocks, in no order. A document
    that was written more than once comes as often; an empty file set gives an empty table."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["packed"], r["bits"], 0, r["n_ids"])
                at = np.array(r["doc_starts"] + [r["n_ids"]], np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(at[:-1] + r["block_start"], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the ids of docs to the shared folder, reads the files back and returns documents_of() them. The files stay
    there; see write_ids() for nulls, ties, repeated rows and empty tables."""
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_path, path, **options)
    return documents_of(read_ids(docs.sparkSession, path))
