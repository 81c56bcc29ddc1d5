"""Suffix-array dedup of repeated byte strings of a given length, across documents.

Equal strings of `length` bytes hold the same GRAM-byte grams, so they agree on which of those has the smallest hash:
their anchor, at the same distance from the start. Consecutive starts with one anchor form a run. So it is enough to
sort the suffixes at anchors, about 2 of every length - GRAM + 2, each with the bytes before it that its run needs.

1. Chunks: the documents of a partition fall into chunks of CHUNK bytes in order of doc_id, stored with their runs.
2. Each chunk sends the hashes of its grams, once each, to a bucket by range; a bucket answers which of them another
   chunk has too. All other suffixes are alone, and stay where they are.
3. The suffixes that are left go, once for equal ones of a chunk, to ranges by sampled splitters over their leading
   bytes; the splitters are at most RANGES, so beyond that a range falls into buckets by a hash of the gram. A bucket
   sorts its suffixes by a multikey quicksort, word by word until they differ, and compares neighbours: strings that
   begin o bytes before their anchors are equal where the neighbours' common prefixes reach length - o bytes and the o
   bytes before agree. The smallest doc_id of each string is settled there.
4. Strings whose suffix begins as a splitter does may be on both sides of it. Buckets send these, once each, to meet by
   their bytes, and get the smallest doc_id over all buckets back before they settle. So a gram that is in very many
   different surroundings spreads over as many buckets as it fills.
5. The answers, some bits for each start, go back to the chunks, which cut.

A passage that a third of all documents share reaches a bucket once for each chunk, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelith.llm.common import arrow_limits, checkpointed, expand, mixed, released, squeeze, text_buffers

GRAM = 24
#: Bytes of text in a chunk, unless a document is longer; bytes of text for each bucket.
CHUNK, BUCKET = 2 << 20, 8 << 20
#: Chunks that splitters are sampled from, suffixes of each, and the most ranges between splitters (50 bytes each, broadcast).
SAMPLE_CHUNKS, SAMPLE_GRAMS, RANGES = 2000, 200, 16_384
#: Bytes whose gram hashes are worked out at once, and the bits that tell a place among them.
SLAB, PLACE_BITS = 4 << 20, 28
BYTE = mixed(np.arange(256, dtype=np.uint64), 5)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first n powers modulo 2 ** 64; kept for the next call up to a chunk's size."""
    size = CHUNK + (1 << 16)
    return _powers(size, base)[:n] if n <= size else _powers.__wrapped__(n, base)


def gram_hashes(raw: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the GRAM bytes at each place, or at those in `at`."""
    n = len(raw)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(n), out=sums[1:])
        if at is None:
            return mixed((sums[GRAM:] - sums[:-GRAM]) * powers(n - GRAM + 1, INVERSE))
        return mixed((sums[at + GRAM] - sums[at]) * powers(n, INVERSE)[at])


def runs(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts of strings of `length` bytes inside one document: the sizes of the runs, in order, and the
    distance from a run's first start to its anchor."""
    starts = start_places(ends, length)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = np.empty(len(starts), np.int64)
    for at in range(0, len(raw), SLAB):
        lo, hi = np.searchsorted(starts, [at, at + SLAB])
        if lo == hi:
            continue
        hashes = gram_hashes(raw[at : at + SLAB + length - 1])
        least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        width, size = length - GRAM + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place[lo:hi] = (least[starts[lo:hi] - at] & mask).astype(np.int64) + at
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return np.diff(np.append(first, len(starts))).astype(np.uint8), (place[first] - starts[first]).astype(np.uint8)


def start_places(ends: np.ndarray, length: int) -> np.ndarray:
    """Where a string of `length` bytes begins and ends in the same document."""
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(total[-1]) + np.repeat(ends[:-1] - total[:-1], counts)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (n x m words) and the class of each in that order: rows are in one class if all words agree.

    A quicksort by one word after the other: rows that a word tells apart are done, and only the segments whose words
    are equal so far go on to the next one.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    edge = np.ones(n, bool)
    edge[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for j in range(1, words.shape[1]):
        segment = np.cumsum(edge) - 1
        open_ = np.flatnonzero(np.bincount(segment)[segment] > 1)
        if not len(open_):
            break
        rows, seg = order[open_], segment[open_]
        inner = np.lexsort((words[rows, j], seg))
        order[open_] = rows[inner]
        key = words[order[open_], j]
        edge[open_[1:]] |= (key[1:] != key[:-1]) & (seg[1:] == seg[:-1])
    return order, np.cumsum(edge) - 1


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of words (n x m): the first row of each class of equal ones, and the class of each row."""
    key = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        key = mixed(key ^ rows[:, j], j)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]) if len(rows) else np.zeros(0, bool)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    if not (rows[first[which]] == rows).all():  # two rows with one hash
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


class Chunk:
    """A chunk's documents in order of doc_id, its runs, and the suffixes at its anchors."""

    def __init__(self, doc_ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, sizes: np.ndarray, ahead: np.ndarray, length: int):
        self.doc_ids, self.ends, self.raw, self.length = doc_ids, ends, raw, length
        self.sizes = sizes.astype(np.int64)
        at = np.cumsum(self.sizes) - self.sizes  # of each run's first start among all starts
        total = np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - length + 1, 0))])
        self.doc = np.searchsorted(total, at, "right") - 1
        self.first = at + (ends[:-1] - total[:-1])[self.doc] if len(at) else np.zeros(0, np.int64)
        self.anchor = self.first + ahead
        self.hash = np.zeros(len(self.anchor), np.uint64)
        for at in range(0, len(raw), SLAB):  # anchors ascend
            lo, hi = np.searchsorted(self.anchor, [at, at + SLAB])
            if lo < hi:
                self.hash[lo:hi] = gram_hashes(raw[at : at + SLAB + GRAM - 1], self.anchor[lo:hi] - at) >> np.uint64(16)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of the anchors, and of each whether two documents of this chunk have it."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.doc_ids[self.doc[order]]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        shared = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.zeros(0, bool)
        return h[at], shared

    def suffixes(self, chosen: np.ndarray) -> np.ndarray:
        """For the chosen runs, bytes: those before the anchor, the anchor's suffix, its distances to the run's first
        and last start. Bytes that the run doesn't cover are 0. Rows are filled up to whole words."""
        width = self.length - GRAM + 1
        span = width - 1 + self.length
        out = np.zeros((len(chosen), -(-(span + 2) // 8) * 8), np.uint8)
        if not len(chosen):
            return out
        lead = self.anchor[chosen] - self.first[chosen]
        last = lead - self.sizes[chosen] + 1
        padded = np.zeros(len(self.raw) + span + width, np.uint8)
        padded[width - 1 : width - 1 + len(self.raw)] = self.raw
        out[:, :span] = np.lib.stride_tricks.sliding_window_view(padded, span)[self.anchor[chosen]]
        place = np.arange(span, dtype=np.int16)
        out[:, :span][(place < (width - 1 - lead).astype(np.int16)[:, None]) | (place >= (width - 1 - last + self.length).astype(np.int16)[:, None])] = 0
        out[:, span], out[:, span + 1] = lead, last
        return out

    def chosen(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose gram is shared; the suffixes of the distinct ones; each one's smallest doc_id; run to distinct."""
        hashes, _ = self.grams()
        runs_ = np.flatnonzero(shared[np.searchsorted(hashes, self.hash)]) if len(hashes) else np.zeros(0, np.int64)
        rows = self.suffixes(runs_)
        first, which = classes(rows.view(np.uint64))
        order = np.argsort(first)  # in order of first appearance, so of doc_id
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first))
        first = first[order]
        return runs_, rows[first], self.doc_ids[self.doc[runs_[first]]], rank[which]


def leads(rows: np.ndarray, length: int) -> np.ndarray:
    """The suffix that each row holds, from its anchor on; bytes that its run doesn't cover are 0."""
    at = length - GRAM
    return np.ascontiguousarray(rows[:, at : at + length])


def in_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of words that compare as the bytes do."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


class Sorted:
    """The distinct suffix rows of a bucket in suffix order, each with its smallest doc_id and with the length of the
    prefix that its suffix has in common with the one before it."""

    def __init__(self, rows: np.ndarray, docs: np.ndarray, length: int):
        self.length, self.width = length, length - GRAM + 1
        span = self.width - 1 + length
        order, which = multikey_sort(in_words(np.concatenate([leads(rows, length), rows[:, : self.width - 1], rows[:, span : span + 2]], axis=1)))
        self.all_docs, self.which = docs, np.empty(len(rows), np.int64)
        self.which[order] = which
        first = order[np.flatnonzero(np.diff(which, prepend=-1))]
        self.rows = rows[first]
        self.docs = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.docs, self.which, docs)
        self.suffix = leads(self.rows, length)
        differs = self.suffix[1:] != self.suffix[:-1]
        self.common = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), length)])
        self.lead, self.last = self.rows[:, span].astype(np.int64), self.rows[:, span + 1].astype(np.int64)

    def reach(self, cuts: list[bytes]) -> np.ndarray:
        """How long a prefix the suffix of each row has in common with one of the cuts."""
        out = np.zeros(len(self.rows), np.int64)
        for cut in cuts:
            differs = self.suffix != np.frombuffer(cut, np.uint8)
            out = np.maximum(out, np.where(differs.any(axis=1), differs.argmax(axis=1), self.length))
        return out

    def strings(self, o: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of `among` that have a start o bytes before the anchor; the class of each, rows of one class having
        the same string there; the smallest doc_id of each class. The common prefixes of neighbours tell the part from
        the anchor on, a sort the bytes before it."""
        some = np.flatnonzero(among & (self.lead >= o) & (self.last <= o))
        group = np.cumsum(self.common < self.length - o)[some]
        which = np.empty(len(some), np.int64)
        if len(some):
            before = in_words(self.rows[some, self.width - 1 - o : self.width - 1])
            order, sorted_ = multikey_sort(np.concatenate([group[:, None].astype(np.uint64), before], axis=1))
            which[order] = sorted_
        least = np.full(int(which.max()) + 1 if len(some) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.docs[some])
        return some, which, least

    def text(self, row: int, o: int) -> bytes:
        return self.rows[row, self.width - 1 - o : self.width - 1 - o + self.length].tobytes()

    def edges(self, cuts: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The distinct strings whose suffix begins as one of the cuts does, and the smallest doc_id of each."""
        reach = self.reach(cuts)
        strings: list[bytes] = []
        docs: list[int] = []
        for o in range(self.width):
            some, which, least = self.strings(o, reach >= self.length - o)
            strings += [self.text(r, o) for r in some[np.unique(which, return_index=True)[1]].tolist()]
            docs += least.tolist()
        return strings, docs

    def settle(self, cuts: list[bytes], outer: dict[bytes, int]) -> np.ndarray:
        """For the rows as they were given: bits, one for each distance from a start to the anchor, set if the string there
        has a smaller doc_id too, here or by `outer`, the smallest doc_id over all buckets of strings at the cuts."""
        out = np.zeros((len(self.rows), self.width), bool)
        reach = self.reach(cuts if outer else [])
        near = self.common >= GRAM
        near[:-1] |= near[1:]
        for o in range(self.width):
            edge = reach >= self.length - o
            some, which, least = self.strings(o, near | (edge if outer else False))
            if outer:
                for r, c in {c: r for r, c in zip(some[edge[some]].tolist(), which[edge[some]].tolist(), strict=True)}.items():
                    least[r] = min(least[r], outer.get(self.text(c, o), least[r]))
            out[some, o] = least[which] < self.docs[some]
        bits = out[self.which]
        bits[self.all_docs > self.docs[self.which]] = True  # a smaller document has the whole run
        return np.packbits(bits, axis=1, bitorder="little")


def dedup(docs: DataFrame, *, length: int = 50, text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = ("doc_id",), out: str = "kept", prefix: str = "", chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also starts in a document with a smaller key.

    Per row: the columns `extra`; n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that
    stay; and `out`: the text that stays (all of these with `prefix` before them). There a removed run leaves whole characters: bytes of a character that is
    cut go as well. Strings are judged on the input and overlap. A null text is empty; texts shorter than `length`
    stay whole; a null key is larger than any other, and rows of equal key don't remove from each other. length is
    from GRAM + 1 to 2 * GRAM + 200. A worker holds one chunk, so a single document takes about 100 times its bytes.
    An empty table gives an empty one. A column of `extra` that is called like a result is an error: give a prefix.
    """
    if not GRAM < length <= 2 * GRAM + 200:
        raise ValueError("length")
    if {c.lower() for c in extra} & {(prefix + n).lower() for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", out)}:
        raise ValueError("a column of extra is called like a result")
    spark = docs.sparkSession
    arrow_limits(spark)
    carried = [f for f in docs.schema.fields if f.name in extra]
    rest = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)])
    work = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("_key"), F.col(text).alias("_text"), F.struct(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(carried)]).alias("_rest"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "ends", "raw", "sizes", "ahead")], T.StructField("rest", T.ArrayType(rest))])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.take(pa.array(np.argsort(whole.column("_key").to_numpy(), kind="stable"))).combine_chunks()
            raw, ends = text_buffers(whole.column("_text"))
            sizes, ahead = runs(raw, ends, length)
            other = whole.column("_rest").combine_chunks()
            other = other.chunk(0) if isinstance(other, pa.ChunkedArray) else other
            number += 1
            row = [pa.array([number - 1], pa.int64()), pa.array([len(raw)], pa.int64()), *[pa.array([squeeze(x.tobytes())], pa.binary()) for x in (whole.column("_key").to_numpy(), ends, raw, sizes, ahead)], pa.ListArray.from_arrays(pa.array([0, len(other)], pa.int32()), other)]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            at, n = 0, batch.num_rows
            lengths = np.diff(text_buffers(batch.column("_text"))[1])
            for i in range(n):
                if size and size + lengths[i] > chunk_bytes:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield flush()
                    held, size, at = [], 0, i
                size += int(lengths[i])
            if n > at:
                held.append(batch.slice(at))
        if held:
            yield flush()

    def loaded(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, dict]]:
        for i in range(batch.num_rows):
            part = {c: expand(batch.column(c)[i].as_buffer()) for c in ("keys", "ends", "raw", "sizes", "ahead")}
            one = Chunk(np.frombuffer(part["keys"], np.int64), np.frombuffer(part["ends"], np.int64), np.frombuffer(part["raw"], np.uint8), np.frombuffer(part["sizes"], np.uint8), np.frombuffer(part["ahead"], np.uint8), length)
            yield one, {c: batch.column(c)[i] for c in batch.schema.names if c not in part}

    chunks = checkpointed(work.mapInArrow(chunked, schema))
    total = chunks.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    buckets = max(1, -(-int(total.n or 0) // bucket_bytes))
    slim = ["chunk", "keys", "ends", "raw", "sizes", "ahead"]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, _ in loaded(batch):
                if len(one.anchor):
                    some = one.anchor[np.linspace(0, len(one.anchor) - 1, SAMPLE_GRAMS).astype(np.int64)]
                    padded = np.concatenate([one.raw, np.zeros(length, np.uint8)])
                    suffixes = np.ascontiguousarray(padded[some[:, None] + np.arange(length)])
                    yield pa.RecordBatch.from_arrays([pa.array([suffixes.tobytes()], pa.binary())], names=["suffixes"])

    def bucket_of(suffixes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The bucket of each suffix: its range between the cuts, and inside it, if ranges hold several, by its gram."""
        at = np.searchsorted(cuts, suffixes.view(f"S{length}").reshape(-1), "right") if len(cuts) else np.zeros(len(suffixes), np.int64)
        if fine == 1 or not len(suffixes):
            return at
        return at * fine + (mixed(in_words(suffixes[:, :GRAM])[:, 0] ^ mixed(in_words(suffixes[:, 8:GRAM])[:, 0] ^ mixed(in_words(suffixes[:, 16:GRAM])[:, 0]))) % np.uint64(fine)).astype(np.int64)

    def cuts_of(bucket: int, cuts: np.ndarray) -> list[bytes]:
        """The cuts on either side of a bucket's range, filled up with bytes 0 as S strings have them."""
        at = bucket // fine
        return [bytes(cuts[i]).ljust(length, b"\0") for i in (at - 1, at) if 0 <= i < len(cuts)]

    def range_of(h: np.ndarray) -> np.ndarray:
        """The bucket of each gram hash, of 48 bits: ascending with it."""
        return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def say_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, more in loaded(batch):
                h, _ = one.grams()
                raw, which = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], range_of(h)
                at = np.flatnonzero(np.diff(which, prepend=-1, append=-1)).tolist() if len(h) else []
                parts = [(int(which[x]), x, y) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int32()), "chunk": pa.array([more["chunk"].as_py()] * len(parts), pa.int64()), "grams": pa.array([raw[x:y].tobytes() for _, x, y in parts], pa.binary())})

    def common(group: pa.Table) -> pa.Table:
        said = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in group.column("grams")]
        sizes = [len(x) for x in said]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.concatenate(said)
        h = wide.view("<u8").reshape(-1)
        order = np.argsort(h, kind="stable")
        twice = h[order[1:]] == h[order[:-1]]
        shared = np.zeros(len(h), bool)
        shared[order[1:][twice]] = True
        shared[order[:-1][twice]] = True
        parts = np.split(shared, np.cumsum(sizes)[:-1])
        keep = [i for i, p in enumerate(parts) if p.any()]
        return pa.table({"chunk": group.column("chunk").take(pa.array(keep, pa.int64())), "bucket": group.column("bucket").take(pa.array(keep, pa.int64())), "bits": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())})

    def shared_of(one: Chunk, answers) -> np.ndarray:
        h, own = one.grams()
        shared = own.copy()
        which = range_of(h)
        for a in answers.as_py() or []:
            x, y = np.searchsorted(which, [a["bucket"], a["bucket"] + 1])
            shared[x:y] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=y - x).astype(bool)
        return shared

    def say_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.frombuffer(sent.value, f"S{length}")
        for batch in batches:
            for one, more in loaded(batch):
                _, rows, ids, _ = one.chosen(shared_of(one, more["answers"]))
                bucket = bucket_of(leads(rows, length), cuts)
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist() if len(order) else []
                parts = [(int(bucket[order[x]]), order[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in parts], pa.int32()), "chunk": pa.array([more["chunk"].as_py()] * len(parts), pa.int64()), "rows": pa.array([squeeze(rows[i].tobytes()) for _, i in parts], pa.binary()), "ids": pa.array([squeeze(ids[i].tobytes()) for _, i in parts], pa.binary())})

    def bucketful(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
        """A bucket's suffix rows, by chunk, their doc_ids, and the bucket's cuts."""
        wide = -(-(2 * length - GRAM + 2) // 8) * 8
        rows = [np.frombuffer(expand(x.as_buffer()), np.uint8).reshape(-1, wide) for x in group.column("rows")]
        ids = np.concatenate([np.frombuffer(expand(x.as_buffer()), np.int64) for x in group.column("ids")])
        return rows, ids, cuts_of(group.column("bucket")[0].as_py(), np.frombuffer(sent.value, f"S{length}"))

    def edged(group: pa.Table) -> pa.Table:
        parts, ids, cuts = bucketful(group)
        rows = np.concatenate(parts)
        at_cut = np.zeros(len(rows), bool)
        for cut in cuts:
            at_cut |= (leads(rows, length)[:, :GRAM] == np.frombuffer(cut[:GRAM], np.uint8)).all(axis=1)
        strings, docs = Sorted(rows[at_cut], ids[at_cut], length).edges(cuts) if at_cut.any() else ([], [])
        return pa.table({"string": pa.array(strings, pa.binary()), "doc": pa.array(docs, pa.int64()), "at": pa.array([group.column("bucket")[0].as_py()] * len(docs), pa.int32())})

    def decided(group: pa.Table, outer: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
        parts, ids, cuts = bucketful(group)
        known = dict(zip(outer.column("string").to_pylist(), outer.column("doc").to_pylist(), strict=True))
        bits = np.split(Sorted(np.concatenate(parts), ids, length).settle(cuts, known), np.cumsum([len(r) for r in parts])[:-1])
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "bits": pa.array([squeeze(b.tobytes()) for b in bits], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.frombuffer(sent.value, f"S{length}")
        width = length - GRAM + 1
        for batch in batches:
            for one, more in loaded(batch):
                runs_, rows, ids, which = one.chosen(shared_of(one, more["answers"]))
                bits = np.zeros((len(rows), width), bool)
                bucket = bucket_of(leads(rows, length), cuts)
                order = np.argsort(bucket, kind="stable")
                in_order = bucket[order]
                for a in more["decided"].as_py() or []:
                    lo, hi = np.searchsorted(in_order, [a["bucket"], a["bucket"] + 1])
                    some = order[lo:hi]
                    bits[some] = np.unpackbits(np.frombuffer(expand(a["bits"]), np.uint8).reshape(len(some), -1), axis=1, count=width, bitorder="little")
                cover = np.zeros(len(one.raw) + 1, np.int32)
                if len(runs_):
                    whole = one.doc_ids[one.doc[runs_]] > ids[which]  # another document of the chunk has the run
                    first, size = one.first[runs_], one.sizes[runs_]
                    np.add.at(cover, first[whole], 1)
                    np.add.at(cover, first[whole] + size[whole] - 1 + length, -1)
                    part = np.flatnonzero(~whole & bits.any(axis=1)[which])
                    run = np.repeat(part, size[part])
                    step = np.arange(len(run)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                    gone = first[run] + step
                    gone = gone[bits[which[run], one.anchor[runs_][run] - gone]]
                    np.add.at(cover, gone, 1)
                    np.add.at(cover, gone + length, -1)
                yield answered(one, np.cumsum(cover[:-1]) > 0, more["rest"])

    def answered(one: Chunk, removed: np.ndarray, other) -> pa.RecordBatch:
        raw, ends = one.raw, one.ends
        n = len(ends) - 1
        inside = np.concatenate([[0], np.cumsum(removed)])
        head = removed.copy()
        head[1:] &= ~removed[:-1]
        begins = ends[:-1][np.diff(ends) > 0]
        head[begins] = removed[begins]
        heads = np.concatenate([[0], np.cumsum(head)])
        sha, texts = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part, gone = raw[a:b], removed[a:b]
            stays = part[~gone].tobytes()
            sha.append(hashlib.sha256(stays).hexdigest())
            texts.append(whole_characters(part, gone) if gone.any() else stays)
        values = other.values
        columns = [values.field(i) for i in range(len(carried))]
        columns += [pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(inside[ends]), pa.int64()), pa.array(np.diff(heads[ends]), pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        assert n == len(values)
        return pa.RecordBatch.from_arrays(columns, names=result.names)

    result = T.StructType([*carried, *[T.StructField(prefix + n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField(prefix + "kept_sha256", T.StringType()), T.StructField(prefix + out, T.StringType())])
    some = chunks.orderBy(F.xxhash64("chunk")).limit(SAMPLE_CHUNKS) if total.c > SAMPLE_CHUNKS else chunks
    suffixes = [np.frombuffer(r.suffixes, f"S{length}") for r in some.select(*slim).mapInArrow(sampled, "suffixes binary").toLocalIterator()]
    suffixes = np.sort(np.concatenate(suffixes)) if suffixes else np.zeros(0, f"S{length}")
    ranges = min(buckets, RANGES)
    fine = -(-buckets // ranges)  # buckets of a range
    cuts = np.unique(suffixes[np.linspace(0, len(suffixes) - 1, ranges + 1).astype(np.int64)[1:-1]]) if len(suffixes) else suffixes
    sent = spark.sparkContext.broadcast(cuts.tobytes())  # `length` bytes for each of RANGES cuts at most
    said = chunks.select(*slim).mapInArrow(say_grams, "bucket int, chunk long, grams binary")
    shared = checkpointed(said.groupBy("bucket").applyInArrow(common, "chunk long, bucket int, bits binary"))
    released(spark)
    answers = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    asked = chunks.select(*slim).join(answers, "chunk", "left").select(*slim, "answers")
    # both uses of told read one exchange
    told = asked.mapInArrow(say_suffixes, "bucket int, chunk long, rows binary, ids binary")
    edges = told.groupBy("bucket").applyInArrow(edged, "string binary, doc long, at int").groupBy("string").agg(F.min("doc").alias("doc"), F.collect_set("at").alias("ats"))
    outer = edges.where(F.size("ats") > 1).select(F.explode("ats").alias("bucket"), "string", "doc")
    done = checkpointed(told.groupBy("bucket").cogroup(outer.groupBy("bucket")).applyInArrow(decided, "chunk long, bucket int, bits binary"))
    released(spark)
    both = answers.join(done.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("decided")), "chunk", "full")
    return chunks.join(both, "chunk", "left").select(*slim, "rest", "answers", "decided").mapInArrow(cut, result)


def whole_characters(part: np.ndarray, gone: np.ndarray) -> bytes:
    """The bytes that stay, without those of characters that lost one."""
    lead = (part & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    lost = np.bincount(character[gone], minlength=int(character[-1]) + 1) > 0
    return part[~lost[character]].tobytes()
