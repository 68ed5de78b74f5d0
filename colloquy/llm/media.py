"""Media columns: texts as 8-bit WAV sounds, and fingerprints of their spectral peaks.

`with_wav` stores a payload as a mono WAV file in a binary column; `fingerprint`
reads such files with the wave module and pairs spectral peaks of a short-time
Fourier transform into time-coded arrays, in the way of a landmark fingerprint:
the strongest peak of a frame is paired with all peaks of the next `REACH`
frames, and a pair is coded from its two frequencies and their distance in time.

Two sounds are compared by their codes in common at one difference of times
(`common_landmarks`), which a cut or a shift by whole hops leaves as they are.

Defined results: a null text is an empty text; an empty text is stored as one
block of spaces; equal payloads, so repeated rows too, give equal files and
fingerprints; a null file, or bytes that are no 8-bit mono WAV, give null columns
and no pairs; of bins of equal strength the lowest is the peak.  Ids are handed on as
they are, null or repeated.  Texts of any length that Spark can hold (2 GB, where
the size fields of a WAV file take 4 GB) are stored whole, and their frames are
transformed in blocks.  An empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_column, table, text_slices

BLOCK = 192
RATE = 8000
WINDOW = 96
HOP = 48
BANDS = ((1, 8), (8, 20), (20, 49))
REACH = 3


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes | None) -> bytes | None:
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            return w.readframes(w.getnframes()) if (w.getnchannels(), w.getsampwidth()) == (1, 1) else None
    except (wave.Error, EOFError, TypeError):
        return None


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of BLOCK, and their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" "), len(raw)


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of all peak pairs, in order of time.

    A frame has one peak for each band of BANDS: its strongest bin.  The code
    holds both bins and the distance in frames.
    """
    peaks, strongest = [], []
    window = np.hanning(WINDOW).astype(np.float32)
    for start in range(0, max(1, (len(samples) - WINDOW) // HOP + 1), 4096):
        part = samples[start * HOP : (start + 4096 - 1) * HOP + WINDOW].astype(np.float32) - np.float32(128)
        frames = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP]
        spectrum = np.fft.rfft(frames * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        found = np.stack([low + power[:, low:high].argmax(axis=1) for low, high in BANDS], axis=1)
        best = np.take_along_axis(power, found, axis=1).argmax(axis=1)
        peaks.append(found)
        strongest.append(found[np.arange(len(found)), best])
    peaks, strongest = np.concatenate(peaks), np.concatenate(strongest)
    times, codes = [], []
    for distance in range(1, min(REACH, len(peaks) - 1) + 1):
        pairs = (strongest[:-distance, None] * 64 + peaks[distance:]) * 4 + distance
        codes.append(pairs)
        times.append(np.broadcast_to(np.arange(len(pairs))[:, None], pairs.shape))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    times, codes = np.concatenate([t.ravel() for t in times]), np.concatenate([c.ravel() for c in codes])
    order = np.argsort(times, kind="stable")
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def with_wav(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text stored as a WAV file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            made = [padded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for _, n in made], pa.int64()), pa.array([wav_bytes(p) for p, _ in made], pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(store, f"id {kind}, n_bytes bigint, media binary")
    return out.withColumnRenamed("id", id_column)


def fingerprint(df: DataFrame, media: str = "media", id_column: str = "doc_id") -> DataFrame:
    """Digests of the stored and the read bytes, and the peak pairs as arrays `peak_times` and `peak_codes`.

    A column n_bytes (the unpadded length) is handed on if the input has one, else null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "media"):
            rows, times, codes = [], [], []
            for stored in batch.column("media").to_pylist():
                payload = wav_payload(stored)
                t, c = peak_pairs(np.frombuffer(payload, np.uint8)) if payload and len(payload) >= WINDOW else (np.zeros(0, np.int32), np.zeros(0, np.int32))
                times.append(t)
                codes.append(c)
                own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                rows.append((*own, *((None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest()))))
            counts = np.array([len(t) for t in times])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *columns, list_column(np.concatenate(times), counts, pa.int32()), list_column(np.concatenate(codes), counts, pa.int32())], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peak_times", "peak_codes"]
    schema = f"id {df.schema[id_column].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, peak_times array<int>, peak_codes array<int>"
    n_bytes = F.col("n_bytes").cast("bigint") if "n_bytes" in df.columns else F.lit(None).cast("bigint").alias("n_bytes")
    return df.select(F.col(id_column).alias("id"), n_bytes, F.col(media).alias("media")).mapInArrow(read, schema).withColumnRenamed("id", id_column)


def common_landmarks(a_times: Column, a_codes: Column, b_times: Column, b_codes: Column) -> Column:
    """Of the difference of times that most equal codes of two fingerprints have: a struct (pairs, shift), null if no code is equal."""
    of = lambda times, codes: F.arrays_zip(times.alias("t"), codes.alias("c"))
    shifts = F.flatten(F.transform(of(a_times, a_codes), lambda x: F.transform(F.filter(of(b_times, b_codes), lambda y: y["c"] == x["c"]), lambda y: y["t"] - x["t"])))
    counts = F.transform(F.array_distinct(shifts), lambda s: F.struct(F.size(F.filter(shifts, lambda x: x == s)).alias("pairs"), s.alias("shift")))
    return F.array_max(counts)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = fingerprint(with_wav(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.to_json(F.struct("peak_times", "peak_codes")), 256)
    feature = F.concat_ws(":", F.size("peak_codes").cast("string"), digest).alias("feature")
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "peak_times", "peak_codes")
