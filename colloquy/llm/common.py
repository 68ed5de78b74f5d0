"""Shared helpers of the corpus operators: Arrow text access, hashing, checkpoints.

Text columns reach Python as Arrow batches.  `text_slices` cuts a batch into
slices of bounded bytes, and `utf8` exposes such a slice as one numpy byte
buffer with offsets, so every operator works on whole texts in bounded memory.
A null text counts as an empty text unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed

__all__ = ["checkpointed"]

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, divisor: int):
    """crc32 of the id as text, modulo: the split of held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def document_keys(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) whose doc_id is a key that is not null and never stands for two different texts.

    Where no id is null or repeats, which one count by id tells, keys are the ids themselves.
    Else documents are numbered in the order of their ids, nulls last; different texts of
    one id are documents of their own, in the order of a hash; equal texts of one id share a key.
    """
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows
    texts = rows.select("doc_id", F.xxhash64("text").alias("hash")).distinct()
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    keys = checkpointed(texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()))
    own = keys.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return rows.join(own, same).withColumn("doc_id", F.col("_key")).drop("_id", "_hash", "_key")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one buffer, and the n + 1 offsets into it; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each (a longer text comes alone).

    The column holds the texts, or their sizes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column(column)
        offsets = np.concatenate([[0], np.cumsum(found.to_numpy(zero_copy_only=False))]) if pa.types.is_integer(found.type) else utf8(found)[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, packed, rest): texts compressed, since they are dealt out by id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, "text"):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([squeeze.compress(x) for x in raw], pa.binary()), batch.column("rest")], ["doc_id", "n_bytes", "packed", "rest"])

    return docs.mapInArrow(pack, f"doc_id bigint, n_bytes bigint, packed binary, rest {docs.schema['rest'].dataType.simpleString()}")


def unpacked(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices as of `text_slices`, with their texts."""
    open_ = zstandard.ZstdDecompressor()
    for batch in text_slices(batches, "n_bytes", most):
        yield batch, [open_.decompress(x) if n else b"" for x, n in zip(batch.column("packed").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n random odd 64-bit multipliers, the same for a seed everywhere."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def list_column(values: np.ndarray, counts: np.ndarray, type_: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, type_))


# Classes of bytes: white space as `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2 ** 64."""
    base = _R_INVERSE if inverse else _R
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: 64-bit hash with A-Z lower-cased, start, end, and row of each.

    `between` marks the bytes that separate words; by default a word is `[^\\x20\\x09-\\x0D]+`.
    """
    if not len(data):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    inside = ~between[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    lasts = inside.copy()
    lasts[:-1] &= ~inside[1:]
    lasts[firsts[1:] - 1] = inside[firsts[1:] - 1]
    ends = np.flatnonzero(lasts) + 1
    codes = odd_constants(256, 11)
    codes[65:91] = codes[97:123]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * power(len(data)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * power(len(data), True)[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of each row, sorted within it, and the number of each row.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    factors = odd_constants(size, 12)
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(hashes) - size + 1)
    made = np.zeros(n, np.uint64)
    for j in range(size):
        made += hashes[j : j + n] * factors[j]
    whole = rows[:n] == rows[size - 1 : size - 1 + n]
    made, own = mix64(made[whole]), rows[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = [mix64(np.array([np.sum(hashes[first[i] : first[i + 1]] * factors[: counts[i]]) + np.uint64(counts[i])], np.uint64))[0] for i in short.tolist()]
        made, own = np.concatenate([made, np.array(extra, np.uint64)]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        made, own = made[order], own[order]
    bounds = np.searchsorted(own, np.arange(n_rows + 1))
    parts = [np.unique(made[bounds[i] : bounds[i + 1]]) for i in range(n_rows)]
    return np.concatenate(parts) if parts else made, np.array([len(p) for p in parts], np.int64)
