"""Near duplicates, components and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pixelith.llm import graph, near_duplicates, suffix_dedup
from tests.conftest import SF


def words(text):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]


def shingles(text, k):
    w = words(text)
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(pairs, k, percent):
    sets = {i: shingles(t, k) for i, t in pairs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near(spark, pairs, k=2, percent=80, **patch):
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, shingle=k, percent=percent).collect()}


def groups(seed=1, sizes=(40, 15, 3)):
    """Groups of edited copies, whose members are near some of the others only."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for size in sizes:
        base = [rnd.choice(vocabulary) for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(60)] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join(rnd.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    out += ["a b", "A  b", "a b c", "a", "A", "", " \t", "b a"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    pairs = groups(seed)
    assert near(spark, pairs) == brute_components(pairs, 2, 80)


def test_blocks_settle_what_stars_leave(spark, monkeypatch):
    """Without the hubs of the largest component, blocks alone must find the same components."""
    monkeypatch.setattr(near_duplicates, "HUBS", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    pairs = groups(5, (60, 25))
    assert near(spark, pairs) == brute_components(pairs, 2, 80)


def test_finer_buckets_settle_templates(spark, monkeypatch):
    """Pages of one template with more or fewer words of their own, some of which are near each other in these."""
    monkeypatch.setattr(near_duplicates, "HUBS", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 10)
    monkeypatch.setattr(near_duplicates, "MANY", 12)
    monkeypatch.setattr(near_duplicates, "RARE", 8)
    calls, finer = [], near_duplicates.finer
    monkeypatch.setattr(near_duplicates, "finer", lambda *a: calls.append(1) or finer(*a))
    rnd = random.Random(11)
    template = [f"t{i}" for i in range(70)]
    shared = [[f"s{j}_{i}" for i in range(12)] for j in range(6)]
    out = []
    for i in range(90):
        words_ = [f"o{i}_{j}" for j in range(rnd.choice((rnd.randint(0, 30), rnd.randint(4, 9))))] + (rnd.choice(shared) if i % 3 == 0 else [])
        at = rnd.choice((0, 35, 70))
        out.append(" ".join(template[:at] + words_ + template[at:]))
    pairs = list(enumerate(out))
    assert near(spark, pairs) == brute_components(pairs, 2, 80) and calls


def test_near_duplicates_edge_cases(spark, docs, empty):
    got = near_duplicates.near_duplicates(docs, shingle=5).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[None][0].kept and by_id[None][0].component_id is None
    assert [(r.component_id, r.kept) for r in by_id[4]] == [(4, True)] * 2 and [(r.component_id, r.kept) for r in by_id[5]] == [(4, False)]
    assert all(r.n_shingles == 0 and r.kept for i in (0, 1, 2, 8) for r in by_id[i])
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    s = near_duplicates.sketch([a, np.unique(b), a[:1], a[:1]])
    assert (s != np.iinfo(np.uint64).max).all()
    assert (s[2] == s[3]).all()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.15


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(500, 560)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(pairs, length):
    first, out = {}, {}
    raw = sorted((i, (t or "").encode()) for i, t in pairs)
    for i, b in raw:
        for q in range(len(b) - length + 1):
            first[b[q : q + length]] = min(first.get(b[q : q + length], i), i)
    for i, b in raw:
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            if first[b[q : q + length]] < i:
                gone[q : q + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def cut(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, **options).collect()}


@pytest.mark.parametrize(("length", "chunk", "bucket"), [(50, 400, 300), (50, 2 << 20, 8 << 20), (100, 1000, 1000), (25, 700, 900)])
def test_suffix_dedup(spark, length, chunk, bucket):
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice((30, 49, 50, 51, 90, 200)))) for _ in range(8)]
    texts = ["".join(rnd.choice([*passages, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    texts += [texts[5], texts[5] + "!", "aa" * 200, "a" * 300, "ab" * 80, "", None, "a" * 49, "a" * 50]
    pairs = list(enumerate(texts))
    rnd.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert cut(df, length=length, chunk_bytes=chunk, bucket_bytes=bucket) == brute_cut(pairs, length)


@pytest.mark.parametrize("ranges", [16_384, 3])
def test_a_hot_gram_spreads_over_buckets(spark, monkeypatch, ranges):
    """One gram in many surroundings, equal strings on both sides of splitters, and ranges of several buckets."""
    monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
    rnd = random.Random(9)
    word = "".join(rnd.choice("pqrst") for _ in range(40))
    heads, tails = (["".join(rnd.choice("uvwxyz") for _ in range(30)) for _ in range(12)] for _ in range(2))
    texts = [rnd.choice(heads)[rnd.randrange(20) :] + word[rnd.randrange(3) :] + rnd.choice(tails)[: rnd.randrange(5, 30)] for _ in range(300)]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    assert cut(df, chunk_bytes=500, bucket_bytes=200) == brute_cut(pairs, 50)


def test_slabs_leave_no_trace(monkeypatch):
    raw = np.frombuffer(("abcabcabc" * 50 + "xyz" * 90).encode(), np.uint8)
    ends = np.array([0, 200, 200, len(raw)])
    whole = suffix_dedup.runs(raw, ends, 50)
    monkeypatch.setattr(suffix_dedup, "SLAB", 64)
    parts = suffix_dedup.runs(raw, ends, 50)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_results_that_clash_need_a_prefix(docs):
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, extra=("doc_id", "n_bytes"))


def test_suffix_dedup_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert cut(df, chunk_bytes=60_000, bucket_bytes=100_000) == brute_cut(pairs, 50)


def test_suffix_dedup_edge_cases(docs, empty):
    got = suffix_dedup.dedup(docs, extra=tuple(docs.columns), prefix="cut_").collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.cut_n_removed for r in by_id[4]] == [0, 0], "rows of one doc_id don't remove from each other"
    assert by_id[5][0].cut_n_removed == by_id[5][0].cut_n_bytes and by_id[5][0].cut_kept == ""
    assert by_id[0][0].cut_n_bytes == 0 and by_id[0][0].n_bytes == "x" and by_id[0][0].text is None and by_id[4][0]._text == "extra"
    assert suffix_dedup.dedup(empty).count() == 0


def test_text_keeps_whole_characters():
    raw = np.frombuffer("aéb".encode(), np.uint8)
    assert suffix_dedup.whole_characters(raw, np.array([0, 0, 1, 0], bool)) == b"ab"


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words_ = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, group = suffix_dedup.multikey_sort(words_)
    got = [tuple(r) for r in words_[order].tolist()]
    assert got == sorted(got)
    assert len(set(got)) == group.max() + 1
    first, which = suffix_dedup.classes(words_)
    assert (words_[first][which] == words_).all() and len(first) == len(set(got))


def test_shingles_of_slices_are_those_of_texts():
    texts = ["A b\tc", None, "", "x", "x y", "a b c"]
    sets = list(near_duplicates.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in sets] == [1, 0, 0, 1, 1, 1]
    assert sets[0].tolist() == sets[5].tolist()
