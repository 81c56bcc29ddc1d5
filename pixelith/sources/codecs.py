"""Strip and tile codecs as numpy kernels: raw, deflate, lossless JPEG, predictors, half floats. One task, many tiles."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

RAW, JPEG, DEFLATE, JXL = 1, 7, 8, 52546
#: Compression codes that are known, and not supported (fixed values).
UNSUPPORTED = {5: "LZW", 6: "old JPEG", 32773: "PackBits", 32946: "old deflate", 34892: "lossy JPEG", JXL: "JPEG XL"}
#: (bits, sample format) to sample type (fixed values).
TYPES = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (16, 3): "f2", (32, 1): "u4", (32, 3): "f4"}


class CodecError(ValueError):
    pass


def sample_type(bits: int, sample_format: int) -> str:
    try:
        return TYPES[bits, sample_format]
    except KeyError:
        raise CodecError(f"{bits} bits of format {sample_format}") from None


def decode_raw(data: bytes, count: int, kind: str, order: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if len(data) < count * size:
        raise CodecError("too few bytes")
    return np.frombuffer(data, np.dtype(kind).newbyteorder(order), count).astype(kind)


def encode_raw(samples: np.ndarray, order: str = "<") -> bytes:
    return samples.astype(samples.dtype.newbyteorder(order)).tobytes()


def decode_deflate(data: bytes, count: int, kind: str, order: str) -> np.ndarray:
    try:
        return decode_raw(zlib.decompress(data), count, kind, order)
    except zlib.error as e:
        raise CodecError(str(e)) from None


def encode_deflate(samples: np.ndarray, order: str = "<", level: int = 6) -> bytes:
    return zlib.compress(encode_raw(samples, order), level)


#: Bytes of a scan whose bit positions are looked up at once, and samples that are written at once.
SCAN, SAMPLES = 1 << 20, 1 << 18


def scan_bytes(data: bytes) -> np.ndarray:
    """The bytes of a JPEG scan up to the first marker, without stuffed zeros."""
    end, at = len(data), data.find(b"\xff")
    while at >= 0 and at + 1 < end:
        if data[at + 1]:
            end = at
            break
        at = data.find(b"\xff", at + 2)
    return np.frombuffer(data[:end].replace(b"\xff\x00", b"\xff"), np.uint8)


def code_table(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of a canonical code."""
    table, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


@dataclass(frozen=True)
class Lookup:
    """For each 16 bits: symbol and length of the code that they begin with, and the bits that the code and what belongs to
    its category take; 0: no code."""

    symbol: np.ndarray
    size: np.ndarray
    step: np.ndarray


def lookup(table: dict[tuple[int, int], int]) -> Lookup:
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (length, code), s in table.items():
        lo = code << (16 - length)
        symbol[lo : lo + (1 << (16 - length))] = s
        size[lo : lo + (1 << (16 - length))] = length
    if (symbol > 16).any():
        raise CodecError("category above 16")
    return Lookup(symbol, size, np.where(size > 0, size + symbol % 16, 0).astype(np.uint8))


@lru_cache(64)
def table_of(counts: bytes, symbols: bytes) -> Lookup:
    """lookup() of a code, kept: the tiles of an image mostly share theirs."""
    return lookup(code_table(counts, symbols))


def code_places(scan: np.ndarray, tables: list[Lookup], count: int) -> np.ndarray:
    """The bit at which each of `count` codes begins; tables take turns. After the scan come zeros.

    The bits that a code would take are looked up for every position at once; what is left to do one after the other is
    to hop from code to code.
    """
    places: list[int] = []
    add, at, turn = places.append, 0, 0
    distinct = {id(t): t for t in tables}
    while len(places) < count:
        first = at >> 3
        part = scan[first : first + SCAN + 2]
        part = np.concatenate([part, np.zeros(max(0, min(SCAN, len(scan) - first + 64) + 2 - len(part)), np.uint8)]) if first < len(scan) else np.zeros(SCAN + 2, np.uint8)
        words = part[:-2].astype(np.uint32) << 16 | part[1:-1].astype(np.uint32) << 8 | part[2:]
        heads = np.empty((len(words), 8), np.uint16)
        for k in range(8):
            heads[:, k] = words >> (8 - k)
        steps = {key: t.step[heads.reshape(-1)].tobytes() for key, t in distinct.items()}
        lanes = [steps[id(t)] for t in tables]
        base, stop, left = first * 8, first * 8 + heads.size, count - len(places)
        p = at - base
        limit = stop - base
        if len(lanes) == 1:
            lane = lanes[0]
            while p < limit and left:
                add(p + base)
                n = lane[p]
                if not n:
                    raise CodecError("no such code")
                p += n
                left -= 1
        else:
            while p < limit and left:
                add(p + base)
                n = lanes[turn][p]
                if not n:
                    raise CodecError("no such code")
                p += n
                left -= 1
                turn = (turn + 1) % len(lanes)
        at = p + base
    return np.array(places, np.int64)


def differences(scan: np.ndarray, tables: list[Lookup], count: int) -> np.ndarray:
    """The differences that the codes of a scan stand for."""
    at = code_places(scan, tables, count)
    padded = np.concatenate([scan, np.zeros(max(0, int(at[-1] >> 3) + 8 - len(scan)) if count else 0, np.uint8)])
    out = np.empty(count, np.int64)
    for lane, table in enumerate(tables):
        for a in range(lane, count, SAMPLES * len(tables)):
            some = slice(a, min(count, a + SAMPLES * len(tables)), len(tables))
            byte, shift = at[some] >> 3, at[some] & 7
            word = sum(padded[byte + k].astype(np.int64) << (32 - 8 * k) for k in range(5))
            head = (word >> (24 - shift)) & 0xFFFF
            category, size = table.symbol[head], table.size[head]
            more = category % 16
            value = (word >> (40 - shift - size - more)) & ((1 << more) - 1)
            low = (more > 0) & (value < 1 << np.maximum(more - 1, 0))
            out[some] = np.where(category == 16, -32768, np.where(low, value - (1 << more) + 1, value))
    return out


def undo_prediction(steps: np.ndarray, mode: int, precision: int) -> np.ndarray:
    """The samples of height x width x parts differences.

    The first line is predicted from the left, the first sample of the others from above; all else by the mode, modulo
    2 ** precision. Where a mode is a sum, running sums undo it; a mode that halves what comes from the left goes by
    diagonals, whose samples don't depend on each other.
    """
    height, width, _ = steps.shape
    wrap = (1 << precision) - 1
    out = steps.copy()
    out[0, 0] += 1 << (precision - 1)
    out[0] = np.cumsum(out[0], axis=0)
    out[:, 0] = np.cumsum(out[:, 0], axis=0)
    if mode == 1:
        out[1:] = np.cumsum(out[1:], axis=1)
    elif mode == 2:
        out = np.cumsum(out, axis=0) if height > 1 else out
        out[:, 0] = np.cumsum(np.concatenate([steps[:1, 0] + (1 << (precision - 1)), steps[1:, 0]]), axis=0)
    elif mode == 4:
        rises = np.cumsum(steps[1:], axis=1)
        out[1:] = out[0] + np.cumsum(rises, axis=0)
    elif mode in (3, 5):
        out &= wrap
        for y in range(1, height):
            above = out[y - 1]
            if mode == 3:
                out[y, 1:] += above[:-1]
            else:
                out[y, 1:] += (above[1:] - above[:-1]) >> 1
                out[y] = np.cumsum(out[y], axis=0)
            out[y] &= wrap
    else:
        out &= wrap
        for d in range(2, height + width - 1):
            y = np.arange(max(1, d - width + 1), min(height, d))
            x = d - y
            left, above, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
            out[y, x] = (out[y, x] + (above + ((left - corner) >> 1) if mode == 6 else (left + above) >> 1)) & wrap
    return out & wrap


def decode_lossless_jpeg(data: bytes, count: int | None = None, kind: str = "u2", order: str = "<") -> np.ndarray:
    """Samples of a lossless JPEG (process 14), line by line, components side by side.

    Restart markers, point transforms and codes for AC are errors. `count` samples are expected, whatever the shape of
    the scan: a tile of another width than the scan's has its samples flow on.
    """
    at, tables, frame = 2, {}, None
    if data[:2] != b"\xff\xd8":
        raise CodecError("no start of image")
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise CodecError("marker expected")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                if body[0] >> 4:
                    raise CodecError("AC codes in a lossless scan")
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise CodecError("cut code table")
                tables[body[0] & 15] = table_of(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC3:
            if len(body) < 6:
                raise CodecError("cut frame")
            frame = (body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5])
        elif marker == 0xDD and any(body):
            raise CodecError("restart markers")
        elif marker == 0xDA:
            break
        elif marker in (0xC0, 0xC1, 0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise CodecError("not a lossless JPEG")
    if frame is None:
        raise CodecError("no frame")
    precision, height, width, parts = frame
    if len(body) < 4 + 2 * parts or body[0] != parts:
        raise CodecError("unsupported scan")
    names = [body[2 + 2 * i] >> 4 for i in range(parts)]
    mode, transform = body[1 + 2 * parts], body[3 + 2 * parts] & 15
    if transform or not 1 <= mode <= 7 or not 2 <= precision <= 16 or not height or not width or not parts:
        raise CodecError("unsupported scan")
    if any(n not in tables for n in names):
        raise CodecError("no code table")
    chosen = [tables[names[0]]] if len(set(names)) == 1 else [tables[n] for n in names]
    steps = differences(scan_bytes(data[at:]), chosen, height * width * parts)
    flat = undo_prediction(steps.reshape(height, width, parts), mode, precision).reshape(-1)
    if count is not None:
        if len(flat) < count:
            raise CodecError("too few samples")
        flat = flat[:count]
    return flat.astype(kind)


def encode_lossless_jpeg(samples: np.ndarray, precision: int = 16, mode: int = 1) -> bytes:
    """A lossless JPEG of height x width x components samples, with one fixed code of 5 bits for 17 categories."""
    height, width, parts = samples.shape
    s = samples.astype(np.int64)
    guess = np.zeros_like(s)
    guess[0, 0] = 1 << (precision - 1)
    guess[0, 1:] = s[0, :-1]
    guess[1:, 0] = s[:-1, 0]
    left, above, corner = s[1:, :-1], s[:-1, 1:], s[:-1, :-1]
    guess[1:, 1:] = {1: left, 2: above, 3: corner, 4: left + above - corner, 5: left + ((above - corner) >> 1), 6: above + ((left - corner) >> 1), 7: (left + above) >> 1}[mode]
    step = (s - guess) & 0xFFFF
    step = np.where(step > 32768, step - 65536, step).reshape(-1)
    bits = [np.zeros(0, np.uint8)]
    for a in range(0, len(step), SAMPLES):
        v = step[a : a + SAMPLES]
        category = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
        category[v == 32768] = 16
        more = category % 16
        code = category << more | np.where(more > 0, np.where(v > 0, v, v + (1 << more) - 1), 0)
        sizes = 5 + more
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bits.append((np.repeat(code, sizes) >> (np.repeat(sizes, sizes) - 1 - place) & 1).astype(np.uint8))
    flat = np.concatenate(bits)
    flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
    scan = np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")
    counts = bytes(17 if i == 4 else 0 for i in range(16))

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    frame = bytes([precision]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([parts]) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(parts))
    head = bytes([parts]) + b"".join(bytes([c + 1, 0]) for c in range(parts)) + bytes([mode, 0, 0])
    return b"\xff\xd8" + segment(0xC4, b"\x00" + counts + bytes(range(17))) + segment(0xC3, frame) + segment(0xDA, head) + scan + b"\xff\xd9"


def undo_horizontal(lines: np.ndarray, step: int) -> np.ndarray:
    """Running sums `step` samples apart along each line, modulo the type's range."""
    out = lines.copy()
    for lane in range(step):
        np.cumsum(lines[:, lane::step], axis=1, dtype=lines.dtype, out=out[:, lane::step])
    return out


def do_horizontal(lines: np.ndarray, step: int) -> np.ndarray:
    out = lines.copy()
    out[:, step:] -= lines[:, :-step]
    return out


def undo_float(raw: np.ndarray, samples: int, size: int, step: int) -> np.ndarray:
    """Lines of floats from byte lines: running byte sums, then the byte planes, most significant first, are put together."""
    planes = undo_horizontal(raw.astype(np.uint8), step).reshape(len(raw), size, samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(len(raw), samples).astype(f"f{size}")


def do_float(lines: np.ndarray, step: int) -> np.ndarray:
    size = lines.dtype.itemsize
    raw = lines.astype(f">f{size}").view(np.uint8).reshape(len(lines), lines.shape[1], size).transpose(0, 2, 1).reshape(len(lines), -1)
    return do_horizontal(np.ascontiguousarray(raw), step)


DECODERS: dict[int, Callable[[bytes, int, str, str], np.ndarray]] = {RAW: decode_raw, DEFLATE: decode_deflate, JPEG: decode_lossless_jpeg}


#: What register() has added; tiff.segments() takes these along to the executors.
REGISTERED: dict[int, Callable[[bytes, int, str, str], np.ndarray]] = {}


def register(code: int, decoder: Callable[[bytes, int, str, str], np.ndarray]) -> None:
    """A decoder for a compression code: (data, samples, type, byte order) -> samples. Plans made afterwards take it along."""
    REGISTERED[code] = DECODERS[code] = decoder


def decode(code: int, data: bytes, lines: int, width: int, planes: int, kind: str, order: str, predictor: int = 1) -> np.ndarray:
    """lines x width x planes samples of a strip or tile."""
    if code not in DECODERS:
        raise CodecError(f"compression {code} ({UNSUPPORTED.get(code, 'unknown')}) is not supported")
    count = lines * width * planes
    if predictor in (3, 34894, 34895):
        step = planes * {3: 1, 34894: 2, 34895: 4}[predictor]
        size = np.dtype(kind).itemsize
        raw = DECODERS[code](data, count * size, "u1", order).reshape(lines, -1)
        return undo_float(raw, width * planes, size, step).reshape(lines, width, planes)
    got = DECODERS[code](data, count, kind, order).reshape(lines, width * planes)
    if predictor in (2, 34892, 34893):
        got = undo_horizontal(got, planes * {2: 1, 34892: 2, 34893: 4}[predictor])
    return got.reshape(lines, width, planes)


def jxl_kind(data: bytes) -> str | None:
    """Whether bytes begin as a JPEG XL codestream or container; decoding one needs a registered decoder."""
    if data[:2] == b"\xff\x0a":
        return "codestream"
    return "container" if data[:12] == b"\x00\x00\x00\x0cJXL \r\n\x87\n" else None
