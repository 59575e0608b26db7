"""Chroma audio fingerprints over a media column.

A recording (a WAV file of PCM in a binary column, of any rate, mixed down to one channel) is cut into overlapping frames. Each frame's
spectrum is folded into 12 pitch classes. Over the image of pitch classes in time an integral image gives any rectangle's sum in
four look-ups, and 16 filters, differences of rectangles in four shapes, are cut into two bits each (Gray code): one packed
32-bit integer per frame position.

Recordings are aligned by their integers: equal integers vote for a time offset, an offset histogram keeps offsets with enough
votes, and the bit errors over the whole overlap at such an offset decide.

``search`` takes stated queries against all recordings. Equal fingerprints are one node by hash. An integer that repeats without a
break counts once, where its run starts: a long silence has one entry. The query side of a key is gathered per key and block of
queries, so a key that very many recordings hold is a stream of rows against bounded blocks.

``sonify`` makes recordings from numeric vectors, for tables that have no audio: one note per component. ``with_fingerprint`` can play them itself (``melody``).

Cases: null or broken media and recordings too short for one integer have an empty fingerprint and align with nothing. Repeated
rows are recordings of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, given, named, stored

RATE = 8000
FRAME = 2048
HOP = 1024
CLASSES = 12
WIDTH = 16  # frames that the filters span
MOST_ERROR = 0.2
LEAST_OVERLAP = 24
LEAST_VOTES = 2
BLOCKS = 997  # into which the queries are split
NOTE = 1024  # samples of a note of ``sonify``
STEPS = 24
CHUNK = 64  # recordings that are made at once

# (kind, first class, classes, frames): kinds are halves along pitch, halves along time, checkers, and thirds along time
_FILTERS = [
    (0, 0, 4, 15), (0, 4, 6, 15), (2, 1, 4, 14), (2, 3, 8, 12), (3, 4, 3, 15), (3, 0, 6, 12), (1, 9, 3, 16), (1, 2, 3, 8),
    (1, 5, 4, 10), (0, 8, 4, 8), (1, 0, 6, 12), (2, 6, 6, 8), (3, 7, 5, 9), (0, 2, 8, 6), (1, 6, 6, 16), (2, 0, 10, 16),
]
_CUTS = (-0.44, 0.0, 0.44)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def pcm(data: bytes | None) -> tuple[np.ndarray, int]:
    """(samples on the scale of 16 bits, rate); no samples for what can't be read. Samples of 8, 16, 24 and 32 bits are read."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            width, channels = w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes())
            raw = raw[: len(raw) // (width * channels) * width * channels]
            if width == 1:
                x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) * 256
            elif width == 3:
                b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
                x = (b[:, 1].astype(np.int16) | (b[:, 2].astype(np.int8).astype(np.int16) << 8)).astype(np.float32) + b[:, 0] / np.float32(256)
            else:
                x = np.frombuffer(raw, dtype=f"<i{width}").astype(np.float32) / np.float32(1 << (8 * width - 16))
            return x.reshape(-1, channels).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), RATE


_maps: dict[int, np.ndarray] = {}


def _frame(rate: int) -> int:
    """Samples of a frame, which lasts as long at any rate: so its spectrum has the same bins in hertz."""
    return max(2, round(FRAME * rate / RATE))


def _fold(rate: int) -> np.ndarray:
    """(bins x classes): to which pitch class a spectral bin belongs, between 55 Hz and 3520 Hz."""
    if rate not in _maps:
        hertz = np.fft.rfftfreq(_frame(rate), 1 / rate)
        use = (hertz >= 55) & (hertz <= 3520)
        m = np.zeros((len(hertz), CLASSES), dtype=np.float32)
        m[use, np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
        _maps[rate] = m
    return _maps[rate]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames x 12), each frame of unit length (or zero for silence). Frames last FRAME / RATE seconds and start every HOP / RATE, at any rate."""
    size = _frame(rate)
    if rate <= 0 or len(samples) < size:
        return np.zeros((0, CLASSES), dtype=np.float32)
    samples = np.asarray(samples, dtype=np.float32)
    starts = np.round(np.arange(int((len(samples) - size) * RATE / (HOP * rate)) + 1) * (HOP * rate / RATE)).astype(np.int64)
    starts = starts[starts + size <= len(samples)]
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)
    window, out = np.hanning(size).astype(np.float32), []
    for s in range(0, len(starts), 256):  # long recordings, some frames at a time
        power = np.abs(np.fft.rfft(frames[starts[s : s + 256]] * window, axis=1)).astype(np.float32) ** 2
        out.append(power @ _fold(rate) * np.float32((FRAME / size) ** 2))
    image = np.concatenate(out)
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > 1.0, image / np.maximum(norm, 1.0), 0.0)


def packed(image: np.ndarray) -> np.ndarray:
    """The 32-bit integers of a chroma image."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    whole = np.zeros((len(image) + 1, CLASSES + 1))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return whole[t1 : t1 + n, c1] - whole[t0 : t0 + n, c1] - whole[t1 : t1 + n, c0] + whole[t0 : t0 + n, c0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, c, height, width in _FILTERS:
        t, h = width // 2, height // 2
        if kind == 0:
            a, b = box(0, width, c, c + h), box(0, width, c + h, c + height)
        elif kind == 1:
            a, b = box(0, t, c, c + height), box(t, width, c, c + height)
        elif kind == 2:
            a = box(0, t, c, c + h) + box(t, width, c + h, c + height)
            b = box(t, width, c, c + h) + box(0, t, c + h, c + height)
        else:
            k = width // 3
            a, b = box(k, 2 * k, c, c + height), (box(0, k, c, c + height) + box(2 * k, width, c, c + height)) / 2
        level = np.searchsorted(_CUTS, np.log((1 + a) / (1 + b)))
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    return packed(chroma(*pcm(data)))


_notes: list[np.ndarray] = []


def melody(vector: list[float] | None) -> bytes:
    """A recording of one note per component: the component's place between the vector's least and largest picks the pitch."""
    if not _notes:
        t = np.arange(NOTE) / RATE
        f = 220 * 2 ** (np.arange(STEPS) / 12)
        wave_ = np.sin(2 * np.pi * f[:, None] * t) + 0.4 * np.sin(4 * np.pi * f[:, None] * t)
        _notes.append((wave_ * np.hanning(NOTE) * 9000).astype(np.int16))
    v = np.nan_to_num(np.array([] if vector is None else [np.nan if x is None else x for x in vector], dtype=float))
    if not len(v):
        return wav(np.zeros(0))
    span = v.max() - v.min()
    pitch = np.zeros(len(v), dtype=int) if span == 0 else np.minimum(((v - v.min()) / span * STEPS).astype(int), STEPS - 1)
    return wav(_notes[0][pitch].ravel())


def sonify(vectors: DataFrame, vector: str = "embedding", media: str = "media") -> DataFrame:
    """``vectors`` with a binary column of recordings."""

    vectors = vectors.drop(media)

    def play(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):  # recordings are far larger than vectors
                some = batch.slice(start, CHUNK)
                made = pa.array([melody(v) for v in some.column(vector).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, made], names=[*some.schema.names, media])

    return vectors.mapInArrow(play, T.StructType([*vectors.schema.fields, T.StructField(media, T.BinaryType())]))


def with_fingerprint(recordings: DataFrame, media: str = "media", play=None) -> DataFrame:
    """``recordings`` without the media and with ``print`` (array of integers, packed as binary). ``play`` makes a recording from each value of ``media``
    in the worker that takes its fingerprint, so that no recording passes through the JVM."""

    @F.pandas_udf("binary")
    def make(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x if play is None else play(x)).tobytes() for x in column], dtype=object)

    return recordings.select(*given(recordings, media, "print"), make(named(media)).alias("print"))


def align(a: np.ndarray, b: np.ndarray, votes_at: int = LEAST_VOTES) -> tuple[int, float] | None:
    """(offset, bit error) of the best alignment of a[i] with b[i + offset], or None; by offset histogram, then bit errors."""
    ia, ib = _entries(a), _entries(b)
    offsets = np.concatenate([ib[1][ib[0] == v] - p for v, p in zip(*ia)] or [np.zeros(0, dtype=np.int64)])
    best = None
    for offset, votes in zip(*np.unique(offsets, return_counts=True)):
        if votes >= votes_at and (found := error_at(a, b, int(offset))) is not None and (best is None or (found, offset) < best[::-1]):
            best = (int(offset), found)
    return best if best and best[1] <= MOST_ERROR else None


def _entries(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(integers, positions) where runs of an equal integer start."""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    return a[start], start


def error_at(a: np.ndarray, b: np.ndarray, offset: int) -> float | None:
    """The share of differing bits where a[i] meets b[i + offset]; None if the overlap is too short."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi - lo < min(LEAST_OVERLAP, len(a), len(b)) or hi <= lo:
        return None
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo))


def search(printed: DataFrame, is_query, id_col: str) -> DataFrame:
    """One row per recording: id, class_id (least id of equal fingerprints), frames, n_links (query rows that it aligns with), and the
    best of them with offset and bit error. ``printed`` has the id and ``print``; ``is_query`` is a Column over the id."""
    rows = stored(printed.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("print").alias("fh"), "print", F.coalesce(is_query, F.lit(False)).alias("q")))
    nodes = rows.groupBy("fh").agg(F.min("id").alias("class_id"), F.first("print").alias("print"), F.sum(F.col("q").cast("long")).alias("nq"), F.min(F.when(F.col("q"), F.col("id"))).alias("qid"))
    nodes = stored(nodes)

    def spread(batches):
        for pdf in batches:
            made = [_entries(np.frombuffer(p, dtype=np.uint32)) for p in pdf["print"]]
            n = [len(v) for v, _ in made]
            if sum(n):
                yield pd.DataFrame({"key": np.concatenate([v for v, _ in made]).astype("int64"), "pos": np.concatenate([p for _, p in made]).astype("int32"), "fh": np.repeat(pdf["fh"].to_numpy(), n)})

    entries = nodes.select("fh", "print").mapInPandas(spread, "key long, pos int, fh long")
    asked = nodes.where("nq > 0").select("fh", "print").mapInPandas(spread, "key long, pos int, fh long")
    blocks = asked.withColumn("block", F.pmod("fh", F.lit(BLOCKS))).groupBy("key", "block").agg(F.collect_list(F.struct("fh", "pos")).alias("qs"))
    met = entries.join(blocks, "key").select("fh", "pos", F.explode("qs").alias("x"))
    votes = met.groupBy(F.col("x.fh").alias("qfh"), "fh", (F.col("pos") - F.col("x.pos")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= LEAST_VOTES)
    sides = votes.join(nodes.select("fh", "print"), "fh").join(nodes.select(F.col("fh").alias("qfh"), F.col("print").alias("qprint"), "nq", "qid"), "qfh")

    @F.pandas_udf("double")
    def errors(q: pd.Series, p: pd.Series, offset: pd.Series) -> pd.Series:
        found = [error_at(np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32), int(o)) for a, b, o in zip(q, p, offset)]
        return pd.Series(found, dtype="float64")

    best = F.struct("error", "offset")
    hits = sides.select("fh", "qfh", "nq", "qid", "offset", errors.asNondeterministic()("qprint", "print", "offset").alias("error")).where(F.col("error") <= MOST_ERROR)
    pairs = hits.groupBy("fh", "qfh").agg(F.min(best).alias("best"), F.first("nq").alias("nq"), F.first("qid").alias("qid"))
    linked = pairs.groupBy("fh").agg(F.sum("nq").alias("n_links"), F.min(F.struct("best.error", "qid", "best.offset")).alias("b"))
    labels = cut(nodes.select("fh", "class_id", (F.octet_length("print") / 4).cast("int").alias("frames")).join(linked, "fh", "left"))
    return rows.select("id", "fh").join(labels, "fh").select(
        F.col("id").alias(id_col), "class_id", "frames", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("b.qid").alias("best_query"), F.col("b.offset").alias("offset"), F.col("b.error").alias("bit_error"))
