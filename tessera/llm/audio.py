"""Audio columns: lossless 8-bit media, resampling, log-mel features and speech segments.

Texts stand for recordings: their UTF-8 bytes are the samples.  ``store_media`` writes them as WAV;
``audio_features`` and ``audio_tensors`` read stored bytes back, resample by a polyphase filter,
take overlapped log-mel frames, and cut segments of high energy with two thresholds.
``tensor_features`` describes each clip by the tensors that were made of it.  Each clip is
worked on alone and in pieces of fixed length, so equal media give equal values wherever they lie
and a clip of any length takes a few times its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import with_columns

UNIT = 192
RATE = 8000
UP, DOWN = 3, 4
TAPS = 12  # of each phase
FRAME, HOP, FFT, MELS = 192, 96, 256, 32
TENSOR_FRAMES = 64
#: Frames worked on at once.
PIECE = 8192
#: Tensors in one batch of rows, 4 MB.
WINDOWS = 512
#: Of log-mel sums, which travel as whole numbers so that their order cannot matter.
MICRO = 1_000_000
#: Decibels against the clip's median: a segment starts above the first and lasts down to the second.
ON_DB, OFF_DB = 1.0, -1.0


def payload(text: bytes) -> bytes:
    """The bytes of a text, filled up with spaces to a positive multiple of ``UNIT``."""
    return b"".join((text, b" " * (-len(text) % UNIT if len(text) else UNIT)))


def _header(n: int) -> bytes:
    """What a WAV file has before its ``n`` bytes of mono 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def to_wav(samples: bytes) -> bytes:
    """A WAV file of an even number of samples."""
    return b"".join((_header(len(samples)), samples))


def from_wav(media) -> bytes:
    """The samples of a WAV file, read from bytes or an Arrow buffer; none for None."""
    if media is None:
        return b""
    with wave.open(pa.BufferReader(media), "rb") as w:
        return w.readframes(w.getnframes())


def _buffers(column: pa.Array) -> Iterator[pa.Buffer | None]:
    """The values of a binary or string column, not copied."""
    return (x.as_buffer() for x in column)


def phases() -> np.ndarray:
    """UP rows of taps: a windowed sinc, cut off at the lower of both rates, dealt by phase.

    Row r weighs the TAPS inputs around an output that lies r / UP past an input.
    """
    n = np.arange(-UP * TAPS // 2, UP * TAPS // 2)
    width = max(UP, DOWN)
    h = np.sinc(n / width) * np.hamming(len(n)) * UP / width
    past = np.arange(UP)[:, None] - UP * np.arange(1 - TAPS // 2, 1 + TAPS // 2)[None, :]
    return h[past - n[0]]


def resample(samples: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Outputs ``start`` to ``stop`` of 8-bit samples at UP / DOWN times their rate; start is a multiple of UP.

    Each output is one phase's dot product; around the clip there is silence.
    """
    bank = phases()
    size = -(-len(samples) * UP // DOWN)
    stop = size if stop is None else min(stop, size)
    each = max(0, -(-(stop - start) // UP))
    first = start // UP * DOWN - (TAPS // 2 - 1)  # of the inputs that the outputs need
    last = first + each * DOWN + TAPS + DOWN
    held = np.frombuffer(samples, np.uint8)[max(0, first) : max(0, last)].astype(np.float64)
    wide = np.zeros(last - first)
    wide[max(0, -first) : max(0, -first) + len(held)] = (held - 128) / 128
    y = np.empty((each, UP))
    for p in range(UP):  # outputs p, p + UP, ... start DOWN inputs apart
        y[:, p] = np.lib.stride_tricks.sliding_window_view(wide[p * DOWN // UP :], TAPS)[::DOWN][:each] @ bank[p * DOWN % UP]
    return y.reshape(-1)[: max(0, stop - start)]


def mel_bank() -> np.ndarray:
    """Triangular filters, FFT bins x MELS."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FFT // 2 + 1)[:, None]
    up, down = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def frame_count(samples: bytes) -> int:
    """Frames of a clip: every sample is in one, the last frame is filled up with zeros."""
    return 1 + max(0, -(-(-(-len(samples) * UP // DOWN) - FRAME) // HOP))


def frames(samples: bytes) -> Iterator[np.ndarray]:
    """All frames of a clip in order, PIECE at a time."""
    n = frame_count(samples)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        y = resample(samples, a * HOP, (b - 1) * HOP + FRAME)
        y = np.concatenate((y, np.zeros((b - 1 - a) * HOP + FRAME - len(y))))
        yield np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][: b - a]


def _level(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames without their mean, and their energy in decibels."""
    part = part - part.mean(axis=1, keepdims=True)
    return part, 10 * np.log10((part * part).mean(axis=1) + 1e-9)


def loudness(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The energy of each frame in decibels."""
    return np.concatenate([_level(part)[1] for part in parts])


def mel_pieces(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Frames x MELS of log-mel power, piece by piece."""
    window, bank = np.hanning(FRAME), mel_bank()
    for part in parts:
        power = np.abs(np.fft.rfft(_level(part)[0] * window, FFT, axis=1)) ** 2
        yield np.log(power @ bank + 1e-6).astype(np.float32)


def heard(samples: bytes) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """``loudness`` and ``mel_pieces`` of a clip; one of several pieces is resampled for each of them."""
    if frame_count(samples) <= PIECE:
        held = list(frames(samples))
        return loudness(held), mel_pieces(held)
    return loudness(frames(samples)), mel_pieces(frames(samples))


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames x MELS of log-mel power, and the energy of each frame, of a whole clip."""
    energy, pieces = heard(samples)
    return np.concatenate(list(pieces)), energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames, end exclusive: on at ON_DB over the median, off below OFF_DB, else as before."""
    level = energy - np.median(energy)
    state = np.where(level >= ON_DB, 1, np.where(level < OFF_DB, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate(([False], (last >= 0) & (state[last] > 0), [False]))
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def tensors(mels: np.ndarray) -> np.ndarray:
    """Windows x TENSOR_FRAMES x MELS, the last filled up with its floor."""
    n = -(-len(mels) // TENSOR_FRAMES)
    out = np.full((n * TENSOR_FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    out[: len(mels)] = mels
    return out.reshape(n, TENSOR_FRAMES, MELS)


def store_media(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """``ids``, ``n_bytes`` of the text and ``media``, the WAV that holds them losslessly.

    A null text counts as empty.  Rows stay one for one; other columns are not read, and ``ids``
    must not be named like a result.
    """

    def wav(text: pa.Buffer | None) -> bytes:
        n = text.size if text else 0
        fill = -n % UNIT if n else UNIT
        return b"".join((_header(n + fill), text or b"", b" " * fill))

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        column = part.column("text_of")
        return [pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), pa.array(map(wav, _buffers(column)), pa.binary())]

    return with_columns(docs.select(*ids, F.col(text).alias("text_of")), "text_of", compute, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


STORED = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType()}


def _stored(stored: pa.Buffer | None, samples: bytes) -> tuple:
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), stored.size if stored else 0, hashlib.sha256(stored or b"").hexdigest()


def audio_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds to each row what its stored media hold, and drops the media.

    ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (last 16 bytes) of the samples read
    back, ``media_bytes``, ``media_sha256``, and ``feature``: frames, segments, their milliseconds
    and the mean log-mel of eight bands.  Null media count as no bytes and no samples: one silent frame.
    """

    def one(stored: pa.Buffer | None) -> tuple:
        samples = from_wav(stored)
        energy, pieces = heard(samples)
        n, found = len(energy), segments(energy)
        bands = sum(mels.astype(np.float64).sum(axis=0) for mels in pieces).reshape(8, -1).mean(axis=1) / n
        spoken = sum(milliseconds(b) - milliseconds(a) for a, b in found)
        feature = f"frames={n};tensors={-(-n // TENSOR_FRAMES)};segments={len(found)};ms={spoken};mel=" + ",".join(f"{x:.3f}" for x in bands)
        return *_stored(stored, samples), feature

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [one(x) for x in _buffers(part.column(column))]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    kinds = {**STORED, "feature": T.StringType()}
    return with_columns(media, column, compute, [T.StructField(k, t) for k, t in kinds.items()])


def audio_tensors(media: DataFrame, ids: list[str], column: str = "media") -> DataFrame:
    """One row for each window of ``TENSOR_FRAMES`` frames of each clip.

    Returns ``ids``, ``window``, ``start_ms``, ``end_ms``, ``segments`` (the time spans of high
    energy that start in the window), ``tensor``, TENSOR_FRAMES x MELS floats row by row, as
    ``as_tensors`` reads them, ``frames``, those of the clip in the window, and ``bands``, their
    log-mel sums in eight bands times MICRO.  Null media count as no samples: one silent frame.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())]))
    own = [("window", T.IntegerType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("segments", spans), ("tensor", T.ArrayType(T.FloatType())), ("frames", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([media.schema[c] for c in ids] + [T.StructField(k, t) for k, t in own])

    def listed(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x[0].size), pa.array(x.reshape(-1)))

    def parts(r: int, stored: pa.Buffer | None):
        """A clip's windows, a piece at a time: row, starts and ends in frames, segments, tensors, bands."""
        samples = from_wav(stored)
        energy, pieces = heard(samples)
        n, found, at = len(energy), segments(energy), 0
        for p, mels in enumerate(pieces):
            windows = tensors(mels)
            starts = p * PIECE + np.arange(len(windows)) * TENSOR_FRAMES
            held: list[list[dict]] = [[] for _ in windows]
            while at < len(found) and found[at][0] < p * PIECE + len(mels):
                a, b = found[at]
                held[(a - p * PIECE) // TENSOR_FRAMES].append({"start_ms": milliseconds(a), "end_ms": milliseconds(b)})
                at += 1
            summed = np.add.reduceat(mels.astype(np.float64).reshape(len(mels), 8, -1).sum(axis=2), starts - p * PIECE)
            yield np.full(len(windows), r), starts, np.minimum(starts + TENSOR_FRAMES, n), held, windows, np.rint(summed * MICRO).astype(np.int64)

    def written(batch: pa.RecordBatch, clips: list[tuple]):
        of, starts, ends, windows, bands = (np.concatenate([c[i] for c in clips]) for i in (0, 1, 2, 4, 5))
        held = [x for c in clips for x in c[3]]
        for a in range(0, len(of), WINDOWS):
            cut = slice(a, a + WINDOWS)
            kept = [batch.column(c).take(pa.array(of[cut])) for c in ids]
            times = [pa.array((starts[cut] // TENSOR_FRAMES).astype(np.int32)), pa.array(milliseconds(starts[cut])), pa.array(milliseconds(ends[cut])), pa.array(held[cut], pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*kept, *times, listed(windows[cut]), pa.array(ends[cut] - starts[cut]), listed(bands[cut])], [f.name for f in schema.fields])

    def run(batches):
        for batch in batches:
            clips, size = [], 0
            for r, stored in enumerate(_buffers(batch.column(column))):
                for piece in parts(r, stored):
                    clips.append(piece)
                    size += len(piece[0])
                    if size >= WINDOWS:
                        yield from written(batch, clips)
                        clips, size = [], 0
            if clips:
                yield from written(batch, clips)

    return media.select(*ids, column).mapInArrow(run, schema)


def tensor_features(media: DataFrame, column: str = "media") -> DataFrame:
    """What ``audio_features`` adds, with ``feature`` taken from the rows of ``audio_tensors``.

    ``feature`` also has the time span of the clip's tensors and the xor of their rows' hashes, which
    no order changes.  Only these leave the task that makes the tensors.  Rows stay one for one; null
    media count as no bytes.  Carried columns must not be named like a result.
    """

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [_stored(x, from_wav(x)) for x in _buffers(part.column(column))]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]

    facts = with_columns(media, column, compute, [T.StructField(k, t) for k, t in STORED.items()], keep_text=True)
    ids = [c for c in facts.columns if c != column]
    rows = audio_tensors(facts.withColumn("clip", F.monotonically_increasing_id()), ["clip", *ids], column)
    spoken = F.aggregate("segments", F.lit(0).cast("long"), lambda x, s: x + s["end_ms"] - s["start_ms"])
    hashed = F.xxhash64("window", "start_ms", "end_ms", "segments", "tensor")
    bands = [F.sum(F.col("bands")[i]).alias(f"band_{i}") for i in range(8)]
    clips = rows.groupBy("clip", *ids).agg(F.sum("frames").alias("frames"), F.count("*").alias("tensors"), F.min("start_ms").alias("first"), F.max("end_ms").alias("last"), F.sum(F.size("segments")).alias("found"), F.sum(spoken).alias("spoken"), F.bit_xor(hashed).alias("xor"), *bands)
    mel = F.concat_ws(",", *[F.format_string("%.3f", F.col(f"band_{i}") / MICRO / (F.col("frames") * (MELS // 8))) for i in range(8)])
    feature = F.concat(F.format_string("frames=%d;tensors=%d;span=%d-%d;segments=%d;ms=%d;digest=", "frames", "tensors", "first", "last", "found", "spoken"), F.lpad(F.lower(F.hex("xor")), 16, "0"), F.lit(";mel="), mel)
    return clips.select(*ids, feature.alias("feature"))


def as_tensors(table: pa.Table, column: str = "tensor") -> pa.Table:
    """A table read from such rows, with the column as Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    flat = table.column(column).combine_chunks().cast(pa.list_(pa.float32(), TENSOR_FRAMES * MELS))
    return table.set_column(table.schema.get_field_index(column), column, pa.ExtensionArray.from_storage(kind, flat))
