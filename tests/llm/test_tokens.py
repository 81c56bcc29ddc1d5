"""Tokenizers against their libraries; files against what went in."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelith.llm import pieces, token_counts, token_files
from tests.llm.conftest import TEXTS

PIECE, BYTE, WORD = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))


def pool(n=1500):
    rnd = random.Random(3)
    parts = list("aabcdeehiilnoorstt  \n\t'ÀéßüΣİμ中文日😀\x00\x1c\x85  ▁") + ["the", "ing", "   ", "<s>", "<0x0A>", "<|endoftext|>", "é", "\r\n", "12", "!!", "don't", "WE'LL", " " * 70]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return texts + [t or "" for t in TEXTS] + [" " * k + "the" for k in range(0, 130, 7)] + ["ab" * 700, "▁" * 200]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pieces_match_the_library():
    sp, p = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces(PIECE)
    texts = pool()
    want = sp.encode(texts)
    got = p.encode(texts)
    assert [ids(raw) for raw, _ in got] == want
    assert [text for _, text in got] == [",".join(map(str, x)) for x in want]
    assert [x.decode() for x in p.decode([np.array(x) for x in want])] == [sp.decode(x) for x in want]


def test_spaces_and_nul():
    """A run of 16 spaces before a NUL is text, not a mark of the encoder's own."""
    sp, p = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces(PIECE)
    rnd = random.Random(8)
    parts = [" " * 16, "\0", " ", "  ", "a", "the", " the", " " * 70, " " * 33, "▁", "\n", "中文", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    assert [ids(raw) for raw, _ in p.encode(texts)] == sp.encode(texts)


@pytest.mark.parametrize("text", ["the" * 30_000, "x" * 20_000, "中文字" * 9000, "abcdefgh" * 50 + " " + "the" * 44])
def test_words_of_any_length(text):
    sp, p = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces(PIECE)
    assert ids(p.encode([text])[0][0]) == sp.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert ids(pieces.pieces(PIECE).encode([text])[0][0]) == sp.encode(text)
    assert ids(token_files.encoder(BYTE).encode(text)) == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert token_counts.counter(WORD).count(text) == len(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)


def test_byte_ids_and_counts_match_the_library():
    texts = pool()
    e, c = token_files.encoder(BYTE), token_counts.counter(WORD)
    assert [ids(e.encode(t)) for t in texts] == [x.ids for x in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [c.count(t) for t in texts] == [len(x.ids) for x in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 20, 31, 32])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 999, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(x, bits)
    assert len(packed) == -(-999 * bits // 8)
    assert (token_files.unpack(packed, bits, 0, 999) == x).all()
    assert (token_files.unpack(packed, bits, 123, 456) == x[123:579]).all()
    assert len(token_files.unpack(packed, bits, 5, 0)) == 0
    assert token_files.width(50257) == 16 and token_files.width(1) == 1


def test_round_trip_query(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = pieces.round_trip(docs, PIECE, extra=("doc_id", "_text", "score")).collect()
    assert len(got) == docs.count()
    for r in got:
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = sp.encode(text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert pieces.round_trip(empty, PIECE).count() == 0


def test_encode_decode_operators(docs):
    back = pieces.decode(pieces.encode(docs, PIECE), PIECE).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in back:
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)


def test_a_column_like_the_result_is_an_error(docs):
    with pytest.raises(ValueError):
        pieces.encode(docs, PIECE, out="Score")
    with pytest.raises(ValueError):
        pieces.decode(docs, PIECE, ids="n_chars", out="score")


def test_token_counts_query(docs, empty):
    t = Tokenizer.from_file(WORD)
    got = token_counts.token_counts(docs, WORD, limit=100).collect()
    assert len(got) == docs.count()
    for r in got:
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.token_counts(empty, WORD).count() == 0


@pytest.mark.parametrize("range_rows", [3, 4000])
def test_token_files(spark, docs, empty, tmp_path, range_rows):
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(docs, BYTE, path, range_rows=range_rows)
    rows = token_files.documents_of(token_files.read_ids(spark, path)).orderBy("start").collect()
    t = Tokenizer.from_file(BYTE)
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at, flat = 0, []
    for r, d in zip(rows, order, strict=True):
        want = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
        flat += want
    assert token_files.slice_ids(spark, path, 7, 300).tolist() == flat[7:307]
    assert token_files.slice_ids(spark, path, at + 5, 10).tolist() == []
    assert token_files.token_files(empty, BYTE).count() == 0
