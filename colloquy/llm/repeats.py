"""Exact substring dedup in the manner of a suffix array, by bucket-pointer refinement.

A byte is removed if a string of `LENGTH` bytes covers it that also starts
earlier: in a document before it, or earlier in the same one.

An identifier of depth D names the string of D bytes at a place.  The first
ones are the q-grams of 8 bytes; an identifier of depth D pairs the one of the
depth d before it at the same place with the one of depth d at a later offset,
D - d bytes on, and so on up to `LENGTH` (`DEPTHS`): each refinement reuses the
identifiers that the last one made.  Identifiers are labels instead of ranks, as
a label is the same in every task, while a rank would have to be sent back to
every place; equality, not the order of different strings, is what is asked.

Suffixes are put into buckets by the identifier of a small depth, and a bucket is
refined, by sorting its rows on the identifiers of a greater depth, only as far
as it can still hold equal strings of `LENGTH` bytes:

1. Every window of `LENGTH` bytes is represented by its least q-gram of `GRAM` bytes (by
   identifier, the leftmost of equals), so equal windows have the same q-gram at
   the same place.  Neighbouring windows with the same representative form one
   block, whose initial bucket is that q-gram.
2. The rows of a bucket are sorted on the identifiers of depth `LENGTH` at the
   first and the last window of their blocks.  A block equal to an earlier one is
   settled: all its windows go.  A block alone in its bucket is settled: all its windows stay.
3. The other blocks are cut into parts of LENGTH + 1 - D windows, for each depth D of `REFINED`; all
   windows of a part share a string of D bytes, whose identifier is the part's refined bucket.  These
   buckets are sorted and settled in the same way.  At depth `LENGTH` a part is one window.

An identifier has 64 bits and is compared only inside one bucket.  Each task first
settles what repeats within its own slice, so that a key of many copies reaches
a bucket once for each slice; further rows of a bucket that is known to stay
open are spread over tasks by their identifiers.

Defined results: a null, empty or short text has nothing removed, and an empty
table gives an empty one.  Documents are ordered by id, a null id last; rows
that repeat an id with its text are one document and get equal results, different
texts of one id are documents of their own, in the order of a hash.  A text of
any length is judged whole: texts longer than a slice are read in pieces that overlap.
Columns of any name are handed on inside `rest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import document_keys, mix64, packed, table, text_slices, unpacked, utf8

LENGTH = 100
GRAM = 24
#: Depths of the identifiers; each is at most twice the one before it.
DEPTHS = (8, 16, GRAM, 48, 84, 96, LENGTH)
#: Depths at which open buckets are sorted again.
REFINED = (84, 96, LENGTH)
SLICE = 2 << 20
# Bits of `place`, which packs the first window (from bit 16), the number of windows less one, and the place of the q-gram.
OPEN, REMOVED = 1 << 15, 1 << 7
ROW = "route bigint, name bigint, doc_id bigint, place bigint"


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit label of each pair of labels."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: np.ndarray, wanted: tuple[int, ...]) -> list[np.ndarray]:
    """Identifiers of the wanted depths, ascending, at each place where a string of that depth starts."""
    found = []
    ids = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, DEPTHS[0])).view(np.uint64).ravel() if len(data) >= DEPTHS[0] else np.zeros(0, np.uint64)
    for before, depth in zip(DEPTHS, DEPTHS[1:], strict=False):
        later = depth - before
        ids = paired(ids[: max(0, len(ids) - later)], ids[later:])
        if depth in wanted:
            found.append(ids)
        if depth == max(wanted):
            break
    return found


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of windows with one representative: row, first window, last window (in the row), place of the q-gram, bucket, name."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(data) - LENGTH + 1
    if n < 1:
        return none
    grams, whole = identifiers(data, (GRAM, LENGTH))
    at = np.arange(len(grams))
    key = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    width = LENGTH - GRAM + 1
    step, least = 1, key
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    gram_at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + LENGTH <= offsets[row + 1]
    first = np.flatnonzero(inside & np.concatenate([[True], (gram_at[1:] != gram_at[:-1]) | ~inside[:-1]]))
    if not len(first):
        return none
    last = np.flatnonzero(inside & np.concatenate([(gram_at[1:] != gram_at[:-1]) | ~inside[1:], [True]]))
    gram, row = gram_at[first], row[first]
    name = named(whole, first, last, gram)
    base = offsets[row]
    return row, first - base, last - base, gram - base, grams[gram], name


def named(whole: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Identifiers of blocks: of their first and last windows, which overlap, and of their shape."""
    return mix64(paired(whole[first], whole[last]) + ((last - first) * 256 + gram - first).astype(np.uint64))


def settle(doc: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray, bucket: np.ndarray, name: np.ndarray, spans: tuple | None = None) -> pa.RecordBatch:
    """Rows of ROW: what repeats within this slice is marked as removed, the rest is routed to its bucket.

    Of a removed span, route is a hash of the id, name its end, and place its start.
    """
    order = np.lexsort((first, doc, name, bucket))
    doc, first, last, gram, bucket, name = (x[order] for x in (doc, first, last, gram, bucket, name))
    new_bucket = np.ones(len(doc), bool)
    new_bucket[1:] = bucket[1:] != bucket[:-1]
    new_name = new_bucket.copy()
    new_name[1:] |= name[1:] != name[:-1]
    lead = np.maximum.accumulate(np.where(new_name, np.arange(len(doc)), 0))
    copy = (doc != doc[lead]) | (first != first[lead])
    place = (first << 16) | ((last - first) << 8) | (gram - first)
    keep = new_name
    names_before = np.cumsum(new_name)
    number = names_before - names_before[np.maximum.accumulate(np.where(new_bucket, np.arange(len(doc)), 0))]
    spread = number[keep] >= 2
    route = np.where(spread, mix64(bucket[keep] ^ mix64(name[keep])), bucket[keep])
    columns = [[route.view(np.int64)], [name[keep].view(np.int64)], [doc[keep]], [place[keep] | np.where(spread, OPEN, 0)]]
    gone = merged(np.concatenate([doc[copy], spans[0]]) if spans else doc[copy], np.concatenate([first[copy], spans[1]]) if spans else first[copy], np.concatenate([last[copy] + LENGTH, spans[2]]) if spans else last[copy] + LENGTH)
    for column, more in zip(columns, (mix64(gone[0].view(np.uint64)).view(np.int64), gone[2], gone[0], (gone[1] << 16) | REMOVED), strict=True):
        column.append(more)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["route", "name", "doc_id", "place"])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each document, in order."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # Ends so far within the document: a running maximum that a new document starts afresh.
    number = np.cumsum(new_doc)
    size = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * size) - number * size
    begins = new_doc.copy()
    begins[1:] |= start[1:] > reach[:-1]
    lasts = np.append(np.flatnonzero(begins)[1:] - 1, len(doc) - 1)
    return doc[begins], start[begins], reach[lasts]


def _initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", SLICE):
        data, offsets = utf8(batch.column("text"))
        docs = batch.column("doc_id").to_numpy()
        # A text longer than a slice is cut into pieces that share LENGTH - 1 bytes.
        pieces = [(0, data, offsets)] if len(data) <= SLICE or len(docs) > 1 else [(s, data[s : s + SLICE + LENGTH - 1], np.array([0, min(len(data) - s, SLICE + LENGTH - 1)])) for s in range(0, len(data) - LENGTH + 1, SLICE)]
        for base, part, ends in pieces:
            row, first, last, gram, bucket, name = blocks(part, ends)
            yield settle(docs[row], first + base, last + base, gram + base, bucket, name)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, start of each document, ids, document of each row, end, place): slices; a longer text comes in overlapping pieces with the rows that start in each."""
    for batch, texts in unpacked(batches, SLICE):
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *[len(x) for x in texts]])
        docs = batch.column("doc_id").to_numpy()
        rows = batch.column("rows")
        owner = np.repeat(np.arange(len(docs)), rows.value_lengths().to_numpy())
        end, place = (rows.flatten().field(k).to_numpy() for k in range(2))
        if len(docs) > 1 or len(data) <= SLICE:
            yield data, offsets, docs, owner, end, place
            continue
        piece = np.maximum((place >> 16) // SLICE, 0)
        for k in range(-(-len(data) // SLICE)):
            own = piece == k
            # The windows of a block start within LENGTH of its first one.
            yield data[k * SLICE : (k + 1) * SLICE + 2 * LENGTH], np.array([-k * SLICE]), docs, owner[own], end[own], place[own]


def _refined(depth: int):
    """Cut open blocks into parts whose windows share a string of this depth, and settle these."""
    part = LENGTH + 1 - depth

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, docs, owner, end, place in _pieces(batches):
            gone = end > 0
            spans = (docs[owner[gone]], place[gone] >> 16, end[gone])
            owner, place = owner[~gone], place[~gone]
            first, count, reach = place >> 16, ((place >> 8) & 127) + 1, place & 127
            # Windows, by their distance before the q-gram: parts are aligned on it, so that they match between blocks.
            windows = np.repeat(np.arange(len(first)), count)
            step = np.arange(len(windows)) - np.repeat(np.cumsum(count) - count, count)
            distance = reach[windows] - step
            group = distance // part
            begins = np.ones(len(windows), bool)
            begins[1:] = (windows[1:] != windows[:-1]) | (group[1:] != group[:-1])
            lasts = np.append(np.flatnonzero(begins)[1:] - 1, len(windows) - 1) if len(windows) else np.zeros(0, np.int64)
            windows, group = windows[begins], group[begins]
            low, high = first[windows] + step[begins], first[windows] + step[lasts]
            gram = first[windows] + reach[windows]
            base = offsets[owner[windows]]
            found = identifiers(data, (depth, LENGTH))
            bucket = mix64(found[0][base + gram - group * part] + group.astype(np.uint64))
            name = named(found[1], base + low, base + high, base + gram) if part > 1 else bucket
            yield settle(docs[owner[windows]], low, high, gram, bucket, name, spans)

    return refine


def _bucketed(rows: DataFrame) -> DataFrame:
    """(doc_id, rows): removed spans and blocks that are still open, of each document that has any."""
    same = W.partitionBy("route", "name").orderBy("doc_id", "place")
    bucket = W.partitionBy("route")
    removed = F.col("place").bitwiseAND(F.lit(REMOVED)) != 0
    seen = rows.withColumns({"_doc": F.first("doc_id").over(same), "_place": F.first("place").over(same)})
    seen = seen.withColumns({"_low": F.min("name").over(bucket), "_high": F.max("name").over(bucket)})
    first = F.shiftright("place", 16)
    copy = ~removed & ((F.col("doc_id") != F.col("_doc")) | (first != F.shiftright("_place", 16)))
    still_open = ~removed & ((F.col("place").bitwiseAND(F.lit(OPEN)) != 0) | (F.col("_low") != F.col("_high")))
    end = F.when(removed, F.col("name")).when(copy, first + F.shiftright("place", 8).bitwiseAND(F.lit(127)) + LENGTH).otherwise(0)
    kept = seen.where(removed | copy | still_open).select("doc_id", F.struct(end.alias("end"), "place").alias("row"))
    return kept.groupBy("doc_id").agg(F.collect_list("row").alias("rows"))


def repeated_spans(docs: DataFrame, small: DataFrame) -> DataFrame:
    """(doc_id, rows) with the removed spans of (doc_id, text), as structs (end, place); small is packed(docs)."""
    found = _bucketed(docs.select("doc_id", "text").mapInArrow(_initial, ROW))
    for depth in REFINED:
        found = _bucketed(small.join(found, "doc_id").mapInArrow(_refined(depth), ROW))
    return found


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, rest, n_bytes, n_removed, spans, kept_sha256) of each document.

    text is what is left, without broken characters; rest is a struct of the
    other columns; spans are the removed byte ranges.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_column, text)]
    rest = F.struct(F.col(id_column).cast("bigint").alias("id"), (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("others"))
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest"))
    rows = document_keys(rows)
    small = packed(rows)
    joined = small.join(repeated_spans(rows, small), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches, SLICE):
            out = []
            for raw, found in zip(texts, batch.column("rows"), strict=True):
                spans = []
                if found.is_valid:
                    end, place = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    spans = list(zip(*(x.tolist() for x in merged(np.zeros(len(place), np.int64), place >> 16, end)[1:]), strict=True))
                ends = [0, *[e for _, e in spans]]
                rest = b"".join(raw[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(raw)], strict=True))
                out.append((rest.decode(errors="ignore"), len(raw), len(raw) - len(rest), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(rest).hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", "rest", "text", "n_bytes", "n_removed", "spans", "kept_sha256"])

    schema = f"doc_id bigint, rest {rows.schema['rest'].dataType.simpleString()}, text string, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    return joined.mapInArrow(cut, schema).withColumns({"doc_id": F.col("rest.id"), "rest": F.col("rest.others")})


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
