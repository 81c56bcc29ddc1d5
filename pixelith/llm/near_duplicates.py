"""Near duplicates: fast similarity sketches, banding, exact verification, connected components.

1. A document's set holds the 64-bit hashes of its distinct shingles of words. Documents of equal sets form a class,
   whose smallest doc_id stands for it from then on, so copies cost one row each.
2. A sketch has BINS coordinates. In round i, i < BINS, each element goes to one bin, with a value that begins with
   i; a bin keeps its smallest. In round BINS + i all elements go to bin i. Most sets fill all bins in the first few
   rounds, and any set does by the last. Two sets agree in a coordinate with their similarity as probability.
3. ROWS coordinates make a band. Documents that agree in a band share a bucket: at similarity 0.8 all bands differ
   with a chance of (1 - 0.8 ** 5) ** 40 < 2e-7.
4. Each member of a bucket is held against the bucket's smallest one, the hub, by intersecting the full sets; hubs
   with many members meet them in many tasks. Components of the links found so far follow. Then the members outside a bucket's
   largest component are held against HUBS members of it, and the components grow again.
5. Buckets whose members are then in several components are settled exactly. The largest component's members fall
   into blocks, so do the others; each block of others meets each block in one task, which compares all pairs of
   different components. Pairs inside the largest component need no look, so that most buckets cost little more than
   their members. No candidate pair is left out, no task holds more than two blocks, and links alone are emitted.
6. A bucket of more than MANY members, such as pages of one template that differ in a fifth of their words, would cost
   the square of its blocks. It falls into finer ones first: its shingles that more than RARE members have are the
   template's. Two members that are linked share a shingle beyond these, which is then among the first of each by hash,
   and meet in that shingle's bucket; or they share the template's alone, and then it makes up so much of both, and
   still more of one of them, that the others need no look. This, too, leaves no candidate pair out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith.llm.common import arrow_limits, distinct, expand, mixed, passes, released, scratch, squeeze, stored, text_buffers
from pixelith.llm.graph import components

BINS, ROWS = 200, 5
BANDS = BINS // ROWS
#: Members that a hub meets in a task, for each of its BANDS buckets; members of the largest component tried in step 4;
#: members in a block.
HUB_TASK, HUBS, BLOCK = 25, 8, 400
#: Bands in a range; members of a bucket in one batch that make a crowd.
RANGE, CROWD = 250_000, 3
#: Members from which on a bucket falls into finer ones; members that have a shingle, from which on it is the template's.
MANY, RARE = 8 * BLOCK, BLOCK // 2
#: The bytes between words, and A-Z to a-z (fixed values).
GAP = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
BYTE = mixed(np.arange(256, dtype=np.uint64), 11)
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and how many words come before each text (and after all)."""
    solid = ~GAP[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = ends[:-1][ends[:-1] < len(raw)]
    first[begin] = solid[begin]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    starts = np.flatnonzero(first)
    index = np.searchsorted(at, starts)
    sizes = np.diff(np.append(index, len(at)))
    place = np.arange(len(at)) - np.repeat(index, sizes)
    with np.errstate(over="ignore"):
        value = BYTE[LOWER[raw[at]]] * powers(int(sizes.max()))[place]
        hashes = mixed(np.add.reduceat(value, index) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle; no words, none."""
    raw, ends = text_buffers(column)
    with np.errstate(over="ignore"):
        for a, b in passes(ends):
            words, before = word_hashes(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            m = max(len(words) - k + 1, 0)
            s = words[:m].copy()
            for j in range(1, k):
                s = mixed(s * np.uint64(BASE) + words[j : j + m], j)
            for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                if y - x >= k:
                    yield distinct(s[x : y - k + 1].copy())
                elif y > x:
                    one = words[x : x + 1].copy()
                    for j in range(1, y - x):
                        one = mixed(one * np.uint64(BASE) + words[x + j : x + j + 1], j)
                    yield mixed(one, 100 + y - x)
                else:
                    yield words[:0]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets, len(sets) x BINS."""
    e, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * BINS):
        h = mixed(e, 1000 + i)
        bins = (h >> np.uint64(48)).astype(np.int64) % BINS if i < BINS else np.full(len(e), i - BINS)
        np.minimum.at(out, owner * BINS + bins, np.uint64(i << 48) | (h & np.uint64((1 << 48) - 1)))
        empty = (out.reshape(-1, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        keep = empty[owner]
        e, owner = e[keep], owner[keep]
        if not len(e):
            break
    return out.reshape(-1, BINS)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A key for each band, n x BANDS."""
    key = np.zeros((len(sketches), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mixed(key * np.uint64(BASE) + sketches[:, j::ROWS], j)
        return mixed(key + np.arange(BANDS, dtype=np.uint64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, n - 1)] == b).sum())
    return 100 * common >= percent * (n + m - common)


def sketched(docs: DataFrame, text: str, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if it is empty) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("_text"), k))
            digest = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
            keys: list[bytes | None] = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            for j in range(0, len(full), 256):
                some = full[j : j + 256]
                for i, row in zip(some, bands(sketch([sets[i] for i in some])), strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands binary")


def texts_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, text (compressed) of the documents in nodes. Texts take less room than their sets, which tasks make anew.

    The join is a merge at every size of nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((x.as_py() or "").encode() for x in batch.column("_text"))
            packed = [squeeze(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "text"])

    small = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("_text")).mapInArrow(run, "node long, text binary")
    return small.join(nodes.hint("merge"), "node", "left_semi")


def sets_in(column: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """The sets of a column of compressed texts."""
    texts = [expand(x.as_buffer()) for x in column]
    return list(shingle_sets(pa.array(texts, pa.binary()), k)) if texts else []


def in_company(reps: DataFrame, parts: int) -> DataFrame:
    """(bucket, node) for the buckets that hold several nodes: reps are node, bands.

    Bands go to `parts` ranges of the key, packed, one row for each batch and range, and most stay there, being alone.
    A bucket with CROWD members or more in a batch is known to hold several, so they are told at once, from any part,
    and the bucket's own range gets one of them only: no range gathers a bucket with a large share of all rows.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)
            nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            size = np.diff(np.append(np.flatnonzero(first), len(keys)))
            crowd = np.repeat(size >= CROWD, size)
            sent = first | ~crowd
            k, n, told = keys[sent], nodes[sent], crowd[sent]
            part = ((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            at = np.searchsorted(part, np.arange(parts + 1)).tolist()
            rows = [(b, False, k[x:y].tobytes(), n[x:y].tobytes(), told[x:y].tobytes()) for b, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
            if crowd.any():
                rows.append((int(nodes[0]) % parts, True, keys[crowd].tobytes(), nodes[crowd].tobytes(), b""))
            kinds = {"part": pa.int32(), "direct": pa.bool_(), "keys": pa.binary(), "nodes": pa.binary(), "told": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    def meet(group: pa.Table) -> pa.Table:
        direct = group.column("direct").to_pylist()

        def whole(name: str, kind: type, which: bool) -> np.ndarray:
            return np.frombuffer(b"".join(x.as_py() for x, d in zip(group.column(name), direct, strict=True) if d == which), kind)

        keys, nodes, told = whole("keys", np.uint64, False), whole("nodes", np.int64, False), whole("told", bool, False)
        order = np.argsort(keys, kind="stable")
        keys, nodes, told = keys[order], nodes[order], told[order]
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared &= ~told
        return pa.table({"bucket": np.concatenate([keys[shared], whole("keys", np.uint64, True)]).view(np.int64), "node": np.concatenate([nodes[shared], whole("nodes", np.int64, True)])})

    packed = reps.mapInArrow(deal, "part int, direct boolean, keys binary, nodes binary, told binary")
    return packed.groupBy("part").applyInArrow(meet, "bucket long, node long")


def verify_stars(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (node, hub, n) that are linked, as (a, b); n: about how many members the hub meets where the pair is from.

    A hub meets about HUB_TASK members of each such place in a task, so BANDS * HUB_TASK at most. A pair tells its task by itself, so no step gathers a hub's
    pairs, and the hub's text goes to the tasks that its pairs have told.
    """
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HUB_TASK)).cast("int")
    salted = pairs.select("node", "hub", salt.alias("salt"))
    members = salted.join(texts, "node").select("hub", "salt", "node", "text")
    hubs = salted.select("hub", "salt").distinct().join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    hubs = hubs.select(F.col("hub").alias("h"), F.col("salt").alias("s"), "hub_text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heads = sets_in(right.column("hub_text"), k)
        hit = [any(linked(h, s, percent) for h in heads) for s in sets_in(left.column("text"), k)]
        good = left.filter(pa.array(hit, pa.bool_()))
        return pa.table({"a": good.column("hub"), "b": good.column("node")})

    return members.groupBy("hub", "salt").cogroup(hubs.groupBy("h", "s")).applyInArrow(run, "a long, b long")


def largest(tagged: DataFrame) -> DataFrame:
    """Of the buckets (bucket, node, root) with several components: the largest one's root, as main; the numbers of
    its members and of the others; HUBS of its members, the same ones in like buckets. Combines before its shuffles."""
    hubs = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.col("node").alias("node"))).alias(f"h{i}") for i in range(HUBS)]
    parts = tagged.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), *hubs)
    best = F.max(F.struct("n", "root", *[f"h{i}" for i in range(HUBS)])).alias("best")
    whole = parts.groupBy("bucket").agg(best, F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members")).where("roots > 1")
    return whole.select("bucket", F.col("best.root").alias("main"), F.col("best.n").alias("inside"), (F.col("members") - F.col("best.n")).alias("outside"), F.array(*[F.col(f"best.h{i}.node") for i in range(HUBS)]).alias("hubs"))


def verify_blocks(tagged: DataFrame, buckets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in each of the buckets, all pairs of them but those that
    other links of the same task have joined. tagged: bucket, node, root; buckets: see largest()."""
    rows = tagged.join(buckets.select(F.col("bucket").alias("_b"), "main", F.ceil(F.col("inside") / BLOCK).cast("int").alias("nin"), F.ceil(F.col("outside") / BLOCK).cast("int").alias("nout")), F.col("bucket") == F.col("_b"))
    inner = rows.where("root = main").withColumn("at", F.expr("cast(pmod(xxhash64(node), nin) as int)"))
    outer = rows.where("root <> main").withColumn("at", F.expr("cast(pmod(xxhash64(node), nout) as int)"))
    # tasks: (0, inner block, outer block), and (1, lower, upper) for two outer blocks
    with_outer = F.transform(F.sequence(F.lit(0), F.col("nout") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("at").alias("lo"), j.alias("hi"), F.lit(0).alias("side")))
    with_inner = F.transform(F.sequence(F.lit(0), F.col("nin") - 1), lambda j: F.struct(F.lit(0).alias("kind"), j.alias("lo"), F.col("at").alias("hi"), F.lit(1).alias("side")))
    with_each = F.transform(F.sequence(F.lit(0), F.col("nout") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least("at", j).alias("lo"), F.greatest("at", j).alias("hi"), (j < F.col("at")).cast("int").alias("side")))
    columns = ["bucket", "node", "root"]
    dealt = inner.select(*columns, F.explode(with_outer).alias("t")).unionByName(outer.select(*columns, F.explode(F.concat(with_inner, with_each)).alias("t")))
    dealt = dealt.select(*columns, "t.*").join(texts, "node")

    def run(group: pa.Table) -> pa.Table:
        nodes, root, side = (group.column(c).to_pylist() for c in ("node", "root", "side"))
        own = sets_in(group.column("text"), k)
        crossed = group.column("kind")[0].as_py() == 0 or group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        up: dict[int, int] = {r: r for r in root}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        order = sorted(range(len(own)), key=lambda i: len(own[i]))
        a, b = [], []
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if 100 * len(own[i]) < percent * len(own[j]):
                    break  # all later sets are larger still
                if crossed and side[i] == side[j]:
                    continue
                p, q = top(root[i]), top(root[j])
                if p != q and linked(own[j], own[i], percent):
                    up[max(p, q)] = min(p, q)
                    a.append(nodes[i])
                    b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "kind", "lo", "hi").applyInArrow(run, "a long, b long")


def finer(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(bucket, node, root) of the finer buckets of (bucket, node, root, members); those that hold no pair to look at are left
    out. A bucket's members are dealt to tasks of about BLOCK."""
    salts = F.ceil(F.col("members") / BLOCK).cast("int")
    salted = rows.select("bucket", "node", "root", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt")).join(texts, "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_in(batch.column("text"), k)
            if not sets:
                continue
            x, b = np.concatenate(sets).view(np.int64), np.repeat(batch.column("bucket").to_numpy(), [len(s) for s in sets])
            order = np.lexsort((x, b))
            x, b = x[order], b[order]
            at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (b[1:] != b[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array(x[at]), pa.array(np.diff(np.append(at, len(x))))], names=["bucket", "x", "n"])

    often = salted.select("bucket", "text").mapInArrow(count, "bucket long, x long, n long").groupBy("bucket", "x").agg(F.sum("n").alias("n")).where(F.col("n") > RARE)
    # a bucket's template: its shingles are no more than those of all its members by RARE
    template = often.groupBy("bucket").agg(F.collect_list("x").alias("xs")).join(rows.groupBy("bucket").agg(F.max(salts).alias("salts")), "bucket")
    template = template.select(F.col("bucket").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), "xs")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, int, int, bool]] = []
        if left.num_rows:
            common = np.sort(right.column("xs")[0].values.to_numpy().view(np.uint64)) if right.num_rows else np.zeros(0, np.uint64)
            here = np.uint64(left.column("bucket")[0].as_py() & (2**64 - 1))
            for node, root, s in zip(left.column("node").to_pylist(), left.column("root").to_pylist(), sets_in(left.column("text"), k), strict=True):
                n = len(s)
                own = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s] if len(common) else s
                with np.errstate(over="ignore"):
                    found.append((mixed(own[: n + percent * -n // 100 + 1] ^ mixed(here[None]), 3), node, root, True))
                    shared = n - len(own)
                    if 100 * shared >= percent * n:
                        found.append((mixed(here[None], 4), node, root, (100 + percent) * shared >= 2 * percent * n))
        sizes = [len(x[0]) for x in found]

        def spread(i: int, kind: pa.DataType) -> pa.Array:
            return pa.array(np.repeat(np.array([x[i] for x in found]), sizes) if found else [], kind)

        return pa.table({"bucket": pa.array(np.concatenate([x[0] for x in found]).view(np.int64) if found else [], pa.int64()), "node": spread(1, pa.int64()), "root": spread(2, pa.int64()), "light": spread(3, pa.bool_())})

    dealt = stored(salted.groupBy("bucket", "salt").cogroup(template.groupBy("b", "s")).applyInArrow(deal, "bucket long, node long, root long, light boolean"), "finer")
    worth = dealt.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("light").alias("light")).where("lo <> hi and light")
    return dealt.select("bucket", "node", "root").join(worth.select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Documents are linked at 100 * |intersection| >= percent * |union| of their sets of distinct word shingles;
    component_id is the smallest doc_id that a document reaches, itself included, and kept says that it is its own.
    Words are lower-cased (A-Z) runs without ASCII white space; fewer than `shingle` words make one shingle, and
    documents without words, or with a null text, link with nothing. A null doc_id takes no part and is kept. Rows of
    one doc_id are one node of the graph. Band keys fit similarities from 0.8 on; see the module for the chance of a
    miss. Texts are read twice, the second time only those in a bucket with others.
    """
    arrow_limits(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stored(_near_duplicates(docs, shingle, percent, text), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, text: str) -> DataFrame:
    rows = stored(sketched(docs, text, shingle), "sketches")
    usable = rows.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    reps = stored(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("digest", F.col("x.doc_id").alias("node"), F.col("x.bands").alias("bands")), "classes")
    parts = max(1, -(-reps.count() * BANDS // RANGE))
    cells = stored(in_company(reps.select("node", "bands"), parts), "bands")
    released(docs.sparkSession)
    buckets = cells.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("who"))
    buckets = stored(buckets.groupBy("hub", "n", "who").agg(F.min("bucket").alias("bucket")), "buckets")  # equal buckets once
    shared = stored(cells.join(buckets.select("bucket", "hub", "n"), "bucket"), "shared")
    pairs = stored(shared.where("node <> hub").groupBy("node", "hub").agg(F.max("n").alias("n")), "pairs")
    nodes = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    texts = stored(texts_of(docs, nodes, text), "texts")
    released(docs.sparkSession)
    links = stored(verify_stars(pairs, texts, shingle, percent), "links")
    found = components(links)
    released(docs.sparkSession)
    many = stored(shared.where("n > 2").select("bucket", "node"), "many")

    def tag(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        tagged = stored(many.join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "tagged")
        buckets = stored(largest(tagged), "open")
        return tagged, buckets

    tagged, open_ = tag(found)
    if not open_.isEmpty():
        others = tagged.join(open_.select(F.col("bucket").alias("_b"), "main", "hubs", F.col("outside").alias("n")), F.col("bucket") == F.col("_b")).where("root <> main")
        pairs = stored(others.select("node", F.explode("hubs").alias("hub"), "n").groupBy("node", "hub").agg(F.max("n").alias("n")), "pairs")
        links = stored(links.unionByName(verify_stars(pairs, texts, shingle, percent)), "links")
        found = components(links)
        released(docs.sparkSession)
        tagged, open_ = tag(found)
    if not open_.isEmpty():
        many = F.col("inside") + F.col("outside") > MANY
        more = stored(verify_blocks(tagged, open_.where(~many), texts, shingle, percent), "links")
        large = open_.where(many).select(F.col("bucket").alias("_b"), (F.col("inside") + F.col("outside")).alias("members"))
        if not large.isEmpty():
            rows_ = stored(tagged.join(large, F.col("bucket") == F.col("_b")).select("bucket", "node", "root", "members"), "large")
            fine = stored(finer(rows_, texts, shingle, percent), "finer")
            more = stored(more.unionByName(verify_blocks(fine, stored(largest(fine), "open"), texts, shingle, percent)), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        released(docs.sparkSession)
    by_class = reps.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("_root"))
    out = rows.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("_root", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
