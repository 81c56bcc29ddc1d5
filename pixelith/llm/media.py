"""Media columns: WAV by the wave module, short-time Fourier transforms, fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelith.llm.common import arrow_limits, spare

#: Payloads are filled up to a multiple of this.
UNIT = 64
RATE = 8000
#: Samples of a frame, and from one frame to the next.
FRAME, HOP = 128, 64
#: Bins of the bands, each of which has a frame's strongest bin as a candidate (the mean and the last bin are in none).
BANDS = ((1, 9), (9, 25), (25, 64))
#: A peak is paired with this many peaks after it in order of frame and bin, 1 to REACH frames later.
FAN, REACH = 5, 63
#: Frames that are transformed at once.
FRAMES = 1 << 15
WINDOW = np.hanning(FRAME)


def payload(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT or UNIT * (not raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, rate, len(samples), "NONE", ""))
        w.writeframesraw(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAV, as stored, and the rate."""
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes()), w.getframerate()


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the peaks, in that order: a band's strongest bin that tops its neighbours in frequency and in time.

    samples: unsigned 8-bit; less than a frame is filled up with silence. Frames are transformed in blocks that
    overlap by one frame on each side, so a recording of any length needs memory for one block only, and the
    blocks leave no trace in the result.
    """
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.full(FRAME - len(samples), 128, np.uint8)])
    count = (len(samples) - FRAME) // HOP + 1
    when, which = [], []
    for start in range(0, count, FRAMES):
        lo, hi = max(0, start - 1), min(count, start + FRAMES + 1)
        part = samples[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float64) - 128.0
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * WINDOW, axis=1))
        row = np.arange(len(power))
        for first, last in BANDS:
            best = power[:, first:last].argmax(axis=1) + first
            top = power[row, best]
            earlier = np.concatenate([[0.0], power[row[:-1], best[1:]]])
            later = np.concatenate([power[row[1:], best[:-1]], [0.0]])
            keep = (top > 1e-9) & (top >= earlier) & (top > later) & (top >= power[row, best - 1]) & (top >= power[row, best + 1])
            keep &= (row + lo >= start) & (row + lo < start + FRAMES)
            when.append(row[keep] + lo)
            which.append(best[keep])
    time, place = np.concatenate(when), np.concatenate(which)
    order = np.lexsort((place, time))
    return time[order], place[order]


def prints(when: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (first bin, second bin, frames between) of pairs of peaks, and the frame of the first: time-coded."""
    codes, times = [], []
    for step in range(1, FAN + 1):
        gap = when[step:] - when[:-step]
        near = (gap >= 1) & (gap <= REACH)
        codes.append((which[:-step] << 12 | which[step:] << 6 | gap)[near])
        times.append(when[:-step][near])
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order].astype(np.int32), time[order].astype(np.int32)


def media_columns(docs: DataFrame, *, text: str = "text", extra: tuple[str, ...] = ("doc_id",), media: bool = False, arrays: bool = False) -> DataFrame:
    """Per row: the columns `extra`; the text as 8-bit samples in a WAV, read back, and what they sound like.

    n_bytes (UTF-8, a null text: 0), payload_bytes and payload_sha256 (the samples read back), tail_crc32 (their
    last 64), media_bytes and media_sha256 (the WAV), feature (numbers of peaks and pairs, digest of the prints).
    With media also the WAV itself, with arrays also print_codes and print_times: the time-coded fingerprint.
    One pass without a shuffle; rows are independent, so equal texts have equal values, repeated rows stay, and an empty
    table gives an empty one. A text longer than a batch is a batch by itself, in about 10 times its bytes.
    Only text and `extra` are read. A batch is bounded by Arrow's limits, a transform by FRAMES.
    """
    arrow_limits(docs.sparkSession)
    column = spare("_raw", extra)
    kept = docs.select(*extra, F.col(text).cast("binary").alias(column))
    schema = kept.drop(column).schema.add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")
    if media:
        schema = schema.add("media", "binary")
    if arrays:
        schema = schema.add("print_codes", T.ArrayType(T.IntegerType())).add("print_times", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for raw in batch.column(column):
                raw = raw.as_py() or b""
                stored = to_wav(payload(raw))
                back, _ = from_wav(stored)
                when, which = peaks(np.frombuffer(back, np.uint8))
                code, time = prints(when, which)
                feature = f"{len(when)} peaks, {len(code)} pairs, {hashlib.sha1(code.tobytes() + time.tobytes()).hexdigest()}"
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                rows.append(row + ((stored,) if media else ()) + ((code, time) if arrays else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media + [pa.list_(pa.int32())] * 2 * arrays
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in extra], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return kept.mapInArrow(run, schema)
