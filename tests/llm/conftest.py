import pytest

TEXTS = [
    None,
    "",
    " ",
    "a",
    "The quick brown fox jumps over the lazy dog. " * 3,
    "The quick brown fox jumps over the lazy dog. " * 3,
    "THE quick  brown fox\njumps over the lazy dog. Ünïcödé ß 中文字 😀 <|endoftext|> ▁x\t\x00y 　z",
    "x" * 500,
    " " * 400,
    "word " * 2000 + "end",
    "The quick brown fox jumps over the lazy cat. And more of it.",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, equal rows, and columns whose names operators use inside."""
    data = [(i, t, None if i == 3 else "en", "hot" if i % 3 else None, 1.5, "extra", i, "x", "y", 1, 2, 3) for i, t in enumerate(TEXTS)]
    data += [(4, TEXTS[4], "en", "hot", 1.5, "extra", 4, "x", "y", 1, 2, 3), (None, "no id here", "en", "hot", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score double, _text string, n_chars long, n_bytes string, _kept string, slot int, shard int, cell int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
