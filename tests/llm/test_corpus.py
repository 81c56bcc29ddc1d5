"""Mixing, toxicity, sharding, media, neighbours and the pipeline."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelith.llm import media, mixing, neighbours, queries, sharding, toxicity
from tests.conftest import SF
from tests.llm.conftest import TEXTS


# --- mixing ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1, 1], [3, 2, 1], [7, 1, 1, 1], [1], [500, 333, 167], [997, 1, 1, 1]])
def test_pfair_bound(weights):
    whole = sum(weights)
    slots = mixing.period(weights)
    assert sorted(sum(slots, [])) == list(range(whole))
    for w, own in zip(weights, slots, strict=True):
        served = np.zeros(whole + 1, int)
        served[np.array(own) + 1] = 1
        lag = np.arange(whole + 1) * w - np.cumsum(served) * whole
        assert (np.abs(lag) < whole).all(), "less than one block from the share at any slot"


def test_plan_uses_every_block_once():
    weights, blocks = [5, 3, 2, 0], [4, 50, 1, 3]
    phases = mixing.plan(weights, blocks)
    source = np.repeat(np.arange(4), blocks)
    block = np.concatenate([np.arange(b) for b in blocks])
    slots = mixing.place(phases, source, block)
    assert sorted(slots.tolist()) == list(range(sum(blocks)))
    assert (np.diff(slots[source == 1]) > 0).all()
    assert mixing.plan([1, 2], [0, 0]) == []


def lags(target, blocks, slots):
    """Per source, in blocks: the share of unrounded targets less what was served, after each slot while all last."""
    both = [np.array(slots[s]) for s in range(len(target))]
    t = min(int(own[-1]) for own in both if len(own))
    for w, own in zip(target, both, strict=True):
        served = np.searchsorted(own, np.arange(t + 1))
        yield np.arange(t + 1) * (w / sum(target)) - served


@pytest.mark.parametrize("sizes, temperature", [([10e9] + [1e9] * 20, 0.5), ([1e9, 3e8, 7.7e7, 12345.0], 0.7)])
def test_bound_against_unrounded_targets(sizes, temperature):
    target = [x**temperature for x in sizes]
    blocks = [int(np.ceil(130_000 * w / sum(target))) for w in target]
    starts, slots = mixing.plan(mixing.exact(target), blocks)
    own = [slots[starts[s] : starts[s + 1]] for s in range(len(sizes))]
    assert sorted(slots.tolist()) == list(range(sum(blocks))) and len(slots) > 100_000
    for lag in lags(target, blocks, own):
        assert len(lag) > 100_000 and np.abs(lag).max() < 1 + 1e-6


def test_a_small_target_is_not_raised():
    starts, slots = mixing.plan(mixing.exact([0.9999, 0.0001]), [120_000, 30])
    assert (slots[starts[1] :] < 100_000).sum() in (9, 10, 11)


def test_bound_holds_when_sources_end():
    weights, blocks = [5.5, 3.25, 2.0, 1.0], [40, 400, 30, 7]
    starts, slots = mixing.plan(mixing.exact(weights), blocks)
    got, due = [0] * 4, [0.0] * 4
    for t, s in enumerate(np.repeat(np.arange(4), blocks)[np.argsort(slots)].tolist()):
        got[s] += 1
        left = 1.0
        while left > 1e-12:  # the fluid share of one slot, by the weights of those that have blocks left
            live = [i for i in range(4) if due[i] < blocks[i] - 1e-9]
            if not live:
                break
            whole = sum(weights[i] for i in live)
            step = min([left, *((blocks[i] - due[i]) * whole / weights[i] for i in live)])
            due = [d + step * weights[i] / whole if i in live else d for i, d in enumerate(due)]
            left -= step
        assert all(abs(g - d) < 1 + 1e-6 for g, d in zip(got, due, strict=True)), t


def test_mix(spark, docs, empty):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(df, block_bytes=4096).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in df.select("doc_id").collect())
    by = {}
    for r in sorted(got, key=lambda r: (r.slot, r.offset)):
        assert r.block == r.offset // 4096
        assert r.offset == by.get(r.source, 0)
        by[r.source] = r.offset + r.size
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got})
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(docs, {"hot": 1.0}).where("slot < 0").count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).count() == docs.count()


def test_sources_beyond_the_lanes_share_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    df = spark.createDataFrame([(i, "t" * (i % 7), f"s{i % 5}") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(df, block_bytes=16).collect()
    assert len(got) == 100 and {r.lane for r in got} == {0, 1, 2} and min(r.slot for r in got) == 0


def test_a_null_source_is_not_the_empty_one(spark):
    rows = [(i, "t" * 15, (None, "", "a")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {None: 3.0, "a": 1.0}, block_bytes=16).collect()
    first = [r.source for r in got if r.slot < 40]
    assert (first.count(None), first.count("a"), first.count("")) == (30, 10, 0)


def test_every_source_is_scheduled(spark):
    rows = [(i, "t" * 15, None if i % 300 == 299 else f"s{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_bytes=16).collect()
    assert sorted(r.slot for r in got) == list(range(3000)) and len({r.doc_id for r in got}) == 3000
    for name in {r.source for r in got}:
        slots = sorted(r.slot for r in got if r.source == name)
        assert all(abs((t + 1) / 300 - (k + 1)) < 1 for k, t in enumerate(slots)), "one block of each source in 300 slots"
        assert sorted(r.offset for r in got if r.source == name) == [16 * k for k in range(10)]


def test_a_weight_beyond_the_largest_sources_counts(spark, monkeypatch):
    rows = [(i, "t" * 15, f"s{min(i // 100, 5)}") for i in range(560)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = {(r.doc_id, r.slot, r.offset) for r in mixing.mix(df, {"s5": 3.0, "s0": 1.0}, block_bytes=16).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    got = mixing.mix(df, {"s5": 3.0, "s0": 1.0}, block_bytes=16).collect()
    assert sum(r.source == "s5" for r in got if r.slot < 40) == 30 and sum(r.source == "s0" for r in got if r.slot < 40) == 10
    assert {(r.doc_id, r.slot, r.offset) for r in got} == whole, "the bound of the broadcast doesn't show"


# --- toxicity --------------------------------------------------------------------------------------------------


def crude(spark, n=400):
    rnd = random.Random(1)
    plain = ["river", "stone", "window", "garden", "letter", "morning", "paper", "silver"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(["blasted", "Rotter", "SCOUNDREL"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = crude(spark)
    model = toxicity.train(docs, labels, ~queries.held_out())
    out = toxicity.score(docs, model, keep=("doc_id",)).where(queries.held_out()).join(labels, "doc_id").collect()
    assert len(out) > 50
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in out) / len(out) > 0.97


def test_labels_held_out_are_never_learned(spark):
    docs, labels = crude(spark, 120)
    flipped = labels.withColumn("toxic", F.when(queries.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, ~queries.held_out()) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1), (4, None), (4, 1), (5, 0), (6, 0), (6, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, labels, F.lit(True))
    assert none.bias < 0 and not none.weight.any()


# --- sharding --------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(df, 8).collect()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    sizes = [0] * 8
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    home = {}
    for r in got:
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert sharding.shard(docs, 8).count() == docs.count()
    assert sharding.shard(empty, 8).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"other {i}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r.n for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.25 * sum(sizes) / 8


def test_packing_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_GROUPS", 20)
    monkeypatch.setattr(sharding, "RANGES", 3)
    got = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), 4).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r.n for r in got]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.1 * sum(sizes) / 4


def test_packing_against_a_plain_one():
    """The highest dot product with what is left, largest first, written out."""
    rng = np.random.default_rng(4)
    v = rng.integers(1, 100, (60, 3)).astype(float)
    share, weight = v.sum(axis=0) / 5, sharding.WEIGHTS
    left, want = np.ones((5, 3)), {}
    for i in sorted(range(60), key=lambda i: (-(v[i] / share * weight).max(), i)):
        want[i] = int(np.argmax([(v[i] / share * weight * left[b]).sum() for b in range(5)]))
        left[want[i]] -= v[i] / share
    assert sharding.pack(v, 5).tolist() == [want[i] for i in range(60)]


def test_given_token_counts_are_balanced(spark):
    df = spark.createDataFrame([(i, f"text {i:04d}", 1000 if i < 40 else 1) for i in range(400)], "doc_id long, text string, n long")
    got = sharding.shard(df, 4, tokens=F.col("n")).groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.sum("size").alias("b")).collect()
    assert len(got) == 4 and max(r.n for r in got) < 1.2 * min(r.n for r in got) and max(r.b for r in got) < 1.05 * min(r.b for r in got)


def test_tokens_by_pattern(spark):
    texts = ["", None, "two words", "internationalisation", "中文字", "a1234, b!", "é́x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in sharding.shard(df, 2).collect()} == {0: 0, 1: 0, 2: 2, 3: 4, 4: 3, 5: 6, 6: 3}


# --- media -----------------------------------------------------------------------------------------------------


def test_media(docs, empty):
    got = media.media_columns(docs, media=True, arrays=True).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = b"no id here" if r.doc_id is None else (TEXTS[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert len(r.print_codes) == len(r.print_times) and r.print_times == sorted(r.print_times)
    assert len({r.feature for r in got if r.doc_id in (4, 5)}) == 1
    assert media.media_columns(empty).count() == 0


def test_blocks_of_frames_leave_no_trace(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    whole = media.peaks(x)
    monkeypatch.setattr(media, "FRAMES", 17)
    assert all((a == b).all() for a, b in zip(whole, media.peaks(x), strict=True))


def plain_prints(samples):
    """Peaks and prints by loops and a transform written out."""
    x = np.array(samples, float) - 128 if len(samples) >= 128 else np.concatenate([np.array(samples, float) - 128, np.zeros(128 - len(samples))])
    n = (len(x) - 128) // 64 + 1
    turn = np.exp(-2j * np.pi * np.outer(np.arange(65), np.arange(128)) / 128)
    power = [np.abs(turn @ (x[64 * i : 64 * i + 128] * np.hanning(128))) for i in range(n)]
    found = []
    for i in range(n):
        for lo, hi in ((1, 9), (9, 25), (25, 64)):
            b = max(range(lo, hi), key=lambda k: (power[i][k], -k))
            v = power[i][b]
            before, after = power[i - 1][b] if i else 0, power[i + 1][b] if i + 1 < n else 0
            if v > 1e-9 and v >= before and v > after and v >= power[i][b - 1] and v >= power[i][b + 1]:
                found.append((i, b))
    pairs = []
    for j, (t, b) in enumerate(found):
        pairs += [(t, b << 12 | b2 << 6 | t2 - t) for t2, b2 in found[j + 1 : j + 6] if 1 <= t2 - t <= 63]
    return found, sorted(pairs)


def test_prints_against_loops(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    for text in [*texts, "", "short", "a sentence that is a little longer than the others " * 30]:
        raw = np.frombuffer(media.payload((text or "").encode()), np.uint8)
        found, pairs = plain_prints(raw)
        when, which = media.peaks(raw)
        code, time = media.prints(when, which)
        assert list(zip(when.tolist(), which.tolist(), strict=True)) == found
        assert list(zip(time.tolist(), code.tolist(), strict=True)) == pairs


def test_a_tone_has_its_peak():
    t = np.arange(8000)
    x = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000) * np.hanning(8000)).astype(np.uint8)
    when, which = media.peaks(x)
    strongest = [b for t, b in zip(when, which, strict=True) if 9 <= b < 25 and 20 < t < 100]
    assert strongest and np.median(strongest) == 16  # 1000 Hz of 62.5 Hz bins


# --- neighbours ------------------------------------------------------------------------------------------------


def exact(ids, x, q, k=10):
    s = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    s[ids == q] = np.inf
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, s))[:k] if np.isfinite(s[i])]


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = neighbours.search(df, F.col("vec_id") % 10 == 0).collect()
    hit = total = 0
    for q in range(0, len(ids), 10):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [r.score for r in own] == sorted(r.score for r in own)
        want = {i for i, _ in exact(ids, x, q)}
        hit += len(want & {r.vec_id for r in own})
        total += 10
        for r in own:
            assert r.score == pytest.approx(float(np.sqrt(((x[ids == r.vec_id][0] - x[ids == q][0]) ** 2).sum())), abs=1e-12)
    assert hit / total >= 0.9


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (100, [0.5, 0.5]), (200, None), (None, [1.0, 1.0]), (11, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    got = neighbours.search(df, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert neighbours.search(df.where("false"), F.lit(True)).count() == 0


def test_isolated_queries_among_tight_groups(spark):
    """Most vectors are in groups of near copies, so most distances of the sample are tiny; lone queries find theirs, too."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = [centres[i % 60] + 1e-4 * rng.standard_normal(16) if i % 100 else rng.standard_normal(16) for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    ids, v = np.arange(3000), np.array(x)
    hit = sum(len({i for i, _ in exact(ids, v, q)} & {r.vec_id for r in got if r.query_id == q}) for q in range(0, 3000, 100))
    assert len(got) == 300 and hit >= 270


def test_thresholds_hold_the_share():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 12))
    index = neighbours.fit(x, 500)
    one, zero = index.chances(x[:5], 0)
    least, best = index.thresholds(one, zero, 0.6)
    cells = np.array([[c >> j & 1 for j in range(24)] for c in rng.integers(0, 1 << 24, 4000)])
    whole = neighbours.spread_out(one[:, :8], zero[:, :8])
    assert np.allclose(np.exp(whole).sum(axis=1), 1)
    for i in range(5):
        p = np.exp(one[i])
        drawn = rng.random((20_000, 24)) < p
        chance = np.where(drawn, one[i], zero[i]).sum(axis=1)
        assert abs((chance >= least[i]).mean() - 0.6) < 0.02
        assert (np.where(cells, one[i], zero[i]).sum(axis=1) <= best[i].max() + 1e-9).all()


def test_a_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(1)
    data = [(i, (np.ones(8) + 1e-3 * rng.standard_normal(8)).tolist() if i % 3 else rng.standard_normal(8).tolist()) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    ids, x = np.arange(400), np.array([np.float32(v) for _, v in data], float)
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    hit = sum(len({i for i, _ in exact(ids, x, q)} & {r.vec_id for r in got if r.query_id == q}) for q in range(0, 400, 100))
    assert len(got) == 40 and hit >= 36


# --- SQL ---


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns, ignore_index=True).astype(str) for x in (got, want))
    assert (a == b).all(axis=None)


def test_mixing_against_sql_with_many_blocks(spark, duck):
    """Small blocks, so that sources end one after the other while others go on."""
    from pixelith.llm import oracles

    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), block_bytes=5000).collect()
    want = {r[0]: r for r in duck.sql("SELECT doc_id, slot, \"offset\", block FROM (" + oracles.mixing(5000, 256) + ")").fetchall()}
    assert len(got) == len(want) and max(r.slot for r in got) > 100
    assert all(want[r.doc_id] == (r.doc_id, r.slot, r.offset, r.block) for r in got)


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import sentencepiece
    import public_tokenizers

    import corpus_pipeline
    from pixelith.llm.common import stored
    from tests.llm.test_dedup import brute_components, brute_cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before = stored(stage(spark, before, SF), "test-pipeline")
        results.append(before)
    clean, distinct, cut, mixed, coded = results
    assert all(r.columns == names for r in results[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~queries.held_out())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in distinct.collect()} == {i for i, (_, top) in brute_components(pairs, 5, 80).items() if i == top}
    pairs = [(r.doc_id, r.text) for r in distinct.collect()]
    want = brute_cut(pairs, corpus_pipeline.PASSAGE)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == set(want)
    for i, (size, gone, _, _) in want.items():
        assert size - gone - 3 * 20 <= len(texts[i].encode()) <= size - gone
    assert {r.doc_id: r.text for r in mixed.collect()} == texts
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: sp.encode(t) for i, t in texts.items()}


def test_pipeline_on_edge_cases(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.where("false")):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count()


def test_the_pipeline_keeps_the_mixed_order(spark):
    import corpus_pipeline
    from pixelith.llm.common import stored

    rows = [(i, f"{i} " + "some words of a text " * 3000, "big" if i < 64 else "small") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES[-2:]:
        docs = stored(stage(spark, docs, SF), "test-order")
    assert docs.columns[:4] == ["slot", "offset", "doc_id", "source"]
    got = docs.drop("ids").orderBy("slot", "offset").collect()
    assert sorted(r.doc_id for r in got) == list(range(80))
    want = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), temperature=corpus_pipeline.TEMPERATURE)
    assert [(r.doc_id, r.slot, r.offset) for r in got] == [(r.doc_id, r.slot, r.offset) for r in want.orderBy("slot", "offset").collect()]
    size = {i: len(text) + 1 for i, text, _ in rows}
    block = 1 << 18
    last = max(r.slot for r in got if r.source == "small")
    # 64 and 16 rows of one size: shares 2/3 and 1/3 while both last; a row may cross the end of its block
    for slot in range(1, last):
        ahead = {s: sum(size[r.doc_id] for r in got if r.source == s and r.slot < slot) for s in ("big", "small")}
        assert abs(ahead["big"] - slot * block * 2 / 3) < block + max(size.values())
        assert abs(ahead["small"] - slot * block / 3) < block + max(size.values())


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
