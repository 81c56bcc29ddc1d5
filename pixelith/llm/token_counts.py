"""Token counts: byte-pair merging with a heap and a linked list, counting only."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith.llm.common import arrow_limits, spare

#: White space as Unicode's property White_Space has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters beyond the Latin, Greek and Cyrillic blocks: some became letters in one version of Unicode or another.
LATER = re.compile("[^\x00-\u052f]").search
#: Words that a worker's memory of counts holds before it starts anew.
KNOWN_WORDS = 600_000


def byte_symbols() -> list[str]:
    """The printable character for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


class WordCounts(dict):
    """Tokens of a word. A word that is not known yet goes through the merges."""

    def __init__(self, first: list[int], last: list[int], pairs: dict[int, tuple[int, int]]):
        super().__init__()
        self.first, self.last, self.pairs = first, last, pairs

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        raw = word.encode()
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        count = self[word] = len(symbols) - merges(symbols, self.pairs)
        return count


def merges(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """How many merges end at no mergeable pair: always the pair of lowest rank, the leftmost of equals.

    pairs: for left << 32 | right, the rank and the merged symbol. A merge keeps the left cell of the linked
    list, and unlinks the right one; entries of the heap that no longer fit their cell are passed over.
    """
    n = len(symbols)
    get = pairs.get
    heap = []
    for i in range(n - 1):
        p = get(symbols[i] << 32 | symbols[i + 1])
        if p is not None:
            heap.append((p[0], i, p[1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    while heap:
        rank, i, merged = pop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        now = get(symbols[i] << 32 | symbols[j])
        if now is None or now[0] != rank:
            continue
        done += 1
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            p = get(merged << 32 | symbols[k])
            if p is not None:
                push(heap, (p[0], i, p[1]))
        h = before[i]
        if h >= 0:
            p = get(symbols[h] << 32 | merged)
            if p is not None:
                push(heap, (p[0], h, p[1]))
    return done


class Counter:
    """Counts the tokens of texts as a word-end BPE file (lower case, white space dropped) has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_symbols()
        end = spec["model"]["end_of_word_suffix"]
        pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.words = WordCounts([vocab[c] for c in names], [vocab[c + end] for c in names], pairs)
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)).findall
        self.path, self.library, self.bytes = path, None, {c: b for b, c in enumerate(names)}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        self.marks = specials

    def by_library(self, text: str) -> int:
        """With the library's own cutting into words, for texts with characters whose classes differ between versions."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.words[bytes(map(self.bytes.__getitem__, w)).decode()] for w, _ in parts)

    def plain(self, text: str) -> int:
        if not text.isascii():
            if LATER(text):
                return self.by_library(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # case is mapped character by character, without final forms
        return sum(map(self.words.__getitem__, self.find(text.lower())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", limit: int = 2048, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `extra`, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, an empty table empty; other columns are not read,
    whatever their names. tokenizer_path is opened on the executors, where the tokenizer files are installed.
    One pass, no shuffle; a worker holds one Arrow batch and at most KNOWN_WORDS words.
    """
    arrow_limits(docs.sparkSession)
    column = spare("_text", extra)
    kept = docs.select(*extra, F.col(text).alias(column))
    schema = kept.drop(column).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            n = [c.count(x) for x in texts]
            columns = [batch.column(x) for x in extra]
            columns += [pa.array([len(x.encode()) if x else 0 for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)
