"""SentencePiece BPE: encoding by vectorised merge rounds, decoding by gathers.

Texts fall into chunks at spaces and line ends, as no piece of the vocabulary crosses one, and equal chunks are
encoded once. The chunks that a worker does not know yet go through the rounds together: one flat array of symbols,
the rank of each adjacent pair, the smallest rank of each word by a segmented minimum, all its leftmost occurrences
merged at once, then the array is compacted; words without a mergeable pair leave; until none is left.

Two rules keep the result equal to merging one pair at a time. Occurrences of a pair in one word merge in the same
round only if no longer piece that contains the merged one ranks before it; else the leftmost alone does. And words
end wherever two neighbouring characters stand side by side in no piece. Rounds are as many as a word has merges at
most, so a word of more than LONG_WORD symbols, such as a megabyte without a space, takes its merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelith.llm.common import arrow_limits, spare

KNOWN_CHUNKS = 400_000
NONE = np.int64(1) << 40
UNDER = "▁"
#: Runs of spaces longer than this give up whole pieces of 16 first; in a list of chunks, SPACES16 stands for such a piece.
LONG_RUN, SPACES16 = 64, 16
#: Symbols of a word beyond which the rounds, one for each rank that merges, would cost more than a heap.
LONG_WORD = 128


class Pieces:
    """A SentencePiece BPE model with byte fallback, identity normalization and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        ids = {names[i]: i for i in range(n) if not special[i]}
        rank = np.unique(-score, return_inverse=True)[1]
        left, right, whole = [], [], []
        self.lone = np.zeros(n, bool)  # only the leftmost occurrence merges in a round
        for name, i in ids.items():
            for k in range(1, len(name)):
                a, b = ids.get(name[:k]), ids.get(name[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
                for part in (a, b):
                    if part is not None and rank[i] <= rank[part]:
                        self.lone[part] = True
        keys = np.array(left, np.int64) * n + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.whole = keys[order], np.array(whole, np.int64)[order]
        self.pair_rank = rank[self.whole].astype(np.int64)
        self.char = np.full(0x110000, -1, np.int64)
        for name, i in ids.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        touching = {(ord(a), ord(b)) for name in ids for a, b in zip(name, name[1:], strict=False)}
        self.touching = np.unique(np.array([a << 21 | b for a, b in touching], np.int64))
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.spaces16 = ids[UNDER * 16]
        raw = [b"" if special[i] else names[i].replace(UNDER, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        raw[sp.unk_id()] = " ⁇ ".encode()
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.starts_with_space = np.array([not special[i] and names[i].startswith(UNDER) for i in range(n)])
        self.known: dict[str | int, tuple[bytes, str]] = {}
        self.merges: dict[int, tuple[int, int]] | None = None

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the pair (a, b) in the pair tables, -1 where there is none."""
        key = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def by_heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The symbols of one long word after all merges, and the place where each begins."""
        if self.merges is None:
            self.merges = dict(zip(self.keys.tolist(), zip(self.pair_rank.tolist(), self.whole.tolist(), strict=True), strict=True))
        merges, size, n = self.merges, self.size, len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def offer(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            found = merges.get(a * size + b) if a < size and b < size else None
            if found:
                heapq.heappush(heap, (found[0], i, found[1], a, b))

        heap: list[tuple[int, int, int, int, int]] = []
        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has merged since
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        at = [i for i, s in enumerate(symbols) if s >= 0]
        return [symbols[i] for i in at], at

    def rounds(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order, and where each chunk's begin and the last one's end. An unknown character is
        the symbol size + code point, until its bytes take its place."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        if not len(points):
            return points, np.zeros(len(chunks) + 1, np.int64)
        symbol = self.char[points]
        symbol = np.where(symbol < 0, self.size + points, symbol)
        bigram = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.touching, bigram), len(self.touching) - 1)
        cut = np.ones(len(points), bool)
        cut[1:] = (self.touching[at] != bigram) | (owner[1:] != owner[:-1])
        word = np.cumsum(cut) - 1
        place = np.arange(len(points))  # where the symbol begins: restores the order at the end
        pair = np.full(len(points), -1)
        inside = np.flatnonzero(~cut[1:])
        pair[inside] = self.pair(symbol[inside], symbol[inside + 1])
        out_symbol, out_place = [], []
        sizes = np.bincount(word)
        if sizes.max() > LONG_WORD:
            ends = np.cumsum(sizes)
            for w in np.flatnonzero(sizes > LONG_WORD).tolist():
                got, at = self.by_heap(symbol[ends[w] - sizes[w] : ends[w]].tolist())
                out_symbol.append(np.array(got, np.int64))
                out_place.append(np.array(at, np.int64) + (ends[w] - sizes[w]))
            keep = (sizes <= LONG_WORD)[word]
            symbol, word, place, pair = symbol[keep], word[keep], place[keep], pair[keep]
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            rank = np.where(pair >= 0, self.pair_rank[pair], NONE)
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            done = least == NONE
            if done.any():
                out_symbol.append(symbol[done])
                out_place.append(place[done])
                keep = ~done
                symbol, word, place, pair, rank, least = symbol[keep], word[keep], place[keep], pair[keep], rank[keep], least[keep]
                if not len(symbol):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            joined = np.concatenate([[False], (at[1:] == at[:-1] + 1) & ~first[1:]])  # overlaps the hit before it
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            even = (np.arange(len(at)) - run) % 2 == 0
            merged = self.whole[pair[at]]
            # of equal ranks with different pieces, or pieces that may merge on at once, the leftmost alone
            lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            alone = self.lone[merged] | self.lone[merged[lead]]
            at = at[first | (even & ~alone)]
            symbol[at] = self.whole[pair[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, place, pair = symbol[keep], word[keep], place[keep], pair[keep]
            at = moved[at]
            near = np.concatenate([at, at[at > 0] - 1])
            inner = (near + 1 < len(symbol)) & (word[near] == word[np.minimum(near + 1, len(word) - 1)])
            pair[near] = -1
            near = near[inner]
            pair[near] = self.pair(symbol[near], symbol[near + 1])
        symbol, place = np.concatenate(out_symbol), np.concatenate(out_place)
        order = np.argsort(place, kind="stable")
        symbol, who = symbol[order], owner[place[order]]
        if (symbol >= self.size).any():
            parts, whose = [], []
            for s, w in zip(symbol.tolist(), who.tolist(), strict=True):
                got = self.byte[list(chr(s - self.size).encode())].tolist() if s >= self.size else [s]
                parts += got
                whose += [w] * len(got)
            symbol, who = np.array(parts, np.int64), np.array(whose)
        return symbol, np.searchsorted(who, np.arange(len(chunks) + 1))

    def chunks(self, text: str) -> list[str | int]:
        out = CHUNK((" " + text).replace(UNDER, " "))
        if " " * LONG_RUN in text or UNDER * LONG_RUN in text:
            short: list[str | int] = []
            for c in out:
                spaces = len(c) - len(c.lstrip(" "))
                whole = max(0, (spaces - LONG_RUN // 2) // 16) if spaces > LONG_RUN else 0
                short += [SPACES16] * whole + [c[16 * whole :]]
            return short
        return out

    def learn(self, chunks: set[str | int]) -> None:
        chunks.discard(SPACES16)
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            self.known.clear()
            new = list(chunks)
        self.known[SPACES16] = (np.array([self.spaces16], "<u4").tobytes(), str(self.spaces16))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids, ends = self.rounds([c.replace(" ", UNDER) for c in some])
            raw, text, at = ids.astype("<u4").tobytes(), list(map(str, ids.tolist())), ends.tolist()
            for c, a, b in zip(some, at, at[1:], strict=False):
                self.known[c] = (raw[4 * a : 4 * b], ",".join(text[a:b]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text: its ids as little-endian u32 bytes, and in decimal joined by commas."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut) if cut else set())
        known = self.known
        out = []
        for c in cut:
            got = [known[x] for x in c]
            out.append((b"".join([x[0] for x in got]), ",".join([x[1] for x in got])))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 bytes of each sequence of ids; one leading space, the dummy prefix, goes."""
        if not ids:
            return []
        flat = np.concatenate(ids).astype(np.int64)
        sizes = self.raw_len[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.raw_at[flat] - ends[:-1], sizes) + np.arange(ends[-1])
        raw = self.raw[at].tobytes()
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        cuts = ends[bounds].tolist()
        out = []
        for x, a, b in zip(ids, cuts[:-1], cuts[1:], strict=True):
            a += bool(len(x) and self.starts_with_space[x[0]])
            part = raw[a:b]
            out.append(part if part.isascii() else part.decode("utf-8", "replace").encode())
        return out


CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*").findall


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def slices(texts: list[str | None], limit: int = 2 << 20) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about limit characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def unclaimed(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name}")


def encode(docs: DataFrame, model_path: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text as array<int> (a null text: an empty array). Other columns stay as they are, repeated
    rows stay, an empty table stays empty. A column that is called like `out` already is an error."""
    unclaimed(docs, out)
    arrow_limits(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        for batch in batches:
            ids = [np.frombuffer(raw, "<i4") for some in slices(batch.column(text).to_pylist()) for raw, _ in p.encode(some)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each id array (null: empty). Ids out of range fail. Repeated rows stay, an empty table stays
    empty. A column that is called like `out` already is an error."""
    unclaimed(coded, out)
    arrow_limits(coded.sparkSession)
    schema = T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        for batch in batches:
            texts = p.decode([np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], pa.array([t.decode() for t in texts], pa.string())], names=schema.names)

    return coded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, *, text: str = "text", extra: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Per row: the columns `extra`, n_tokens, ids_sha256 and decoded_sha256 of encode() and decode() in one pass;
    with_ids: the ids, too.

    A null text is an empty one: 0 tokens, the digest of nothing. Repeated rows stay; an empty table stays empty. Only the text and the columns
    `extra` are read, so others may have any name. No shuffle; a worker holds a slice of a batch, 2 M characters or
    one longer text, and KNOWN_CHUNKS chunks.
    """
    arrow_limits(docs.sparkSession)
    column = spare("_text", extra)
    kept = docs.select(*extra, F.col(text).alias(column))
    schema = kept.drop(column).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        for batch in batches:
            n, coded, back, all_ids = [], [], [], []
            for some in slices(batch.column(column).to_pylist()):
                got = p.encode(some)
                ids = [np.frombuffer(raw, "<u4") for raw, _ in got]
                n += [len(x) for x in ids]
                all_ids += ids if with_ids else []
                coded += [hashlib.sha256(text.encode()).hexdigest() for _, text in got]
                back += [hashlib.sha256(x).hexdigest() for x in p.decode(ids)]
            columns = [*[batch.column(x) for x in extra], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)
