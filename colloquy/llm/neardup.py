"""MinHash near-duplicates, with odd sketches for candidate verification.

A document's set holds its distinct five-word shingles.  `MINHASHES` minimum
hashes form `BANDS` bands; documents of equal sets are one class, and a class is
represented by its smallest id.  Bands give candidates; the odd sketch of a
class is a bitmap into which its MinHash samples are folded by parity, and the
population count of the XOR of two sketches estimates their similarity.
Candidates far below the threshold by size or by sketch go; all others are
confirmed on the full sets.

Within a bucket no pairs are listed.  First each member is compared with one
pivot, the member that shares most buckets with others, which is the centre of a
group of copies; confirmed links form components.  All pairs with a pivot are judged
then.  Only buckets whose other members are of
several components are looked at again: members outside the
bucket's most frequent component are compared with the members of other
components.  Links within a component can add nothing and are not looked for,
and a shingle that occurs in one component only cannot be part of a link between
two; the same holds of a class and what a bucket's most frequent component does
not contain.  Classes and pairs whose other shingles are too few are left out.

Members of a bucket are dealt out in blocks of about `BLOCK` rows, so that a bucket of many
copies is the work of many tasks: a pivot goes to each block, and members that
are compared with others meet them block by block.

Defined results: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text of one to four words has its whole sequence as the one
shingle; texts of any length are taken whole.  Documents are in the order of
their ids, a null id last; component_id is the id of a component's first
document.  Rows that repeat an id with its text are one document and get equal
rows, so all of them are kept or none; different texts of one id are documents of
their own in the order of a hash, of which a component keeps only the first.  An empty
table gives an empty one; only id and text of the input are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import checkpointed, document_keys, list_column, mix64, odd_constants, packed, shingles, table, text_slices, unpacked, utf8, words

BANDS = 40
BAND_ROWS = 4
MINHASHES = BANDS * BAND_ROWS
SKETCH_BITS = 512
SKETCH_FLOOR = 0.4
SLICE = 1 << 20
BLOCK = 1024


def minhashes(values: np.ndarray, counts: np.ndarray, n: int = MINHASHES) -> np.ndarray:
    """Minimum hashes of each row that has values, shape (rows, n)."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    multipliers, out = odd_constants(n, 21), []
    addends = odd_constants(n, 22)
    for i in np.flatnonzero(counts):
        own = values[starts[i] : starts[i + 1]]
        least = None
        for j in range(0, len(own), 1024):
            part = (own[None, j : j + 1024] * multipliers[:, None] + addends[:, None]).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        out.append(least)
    return np.array(out, np.uint64).reshape(len(out), n)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words, shape (rows, SKETCH_BITS / 64)."""
    places = mix64(samples ^ odd_constants(samples.shape[1], 23)[None, :]) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(parity, (np.arange(len(samples))[:, None], places.astype(np.int64)), 1)
    return np.packbits(parity, axis=1).view(np.uint64).reshape(len(samples), SKETCH_BITS // 64)


def signatures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, set_a, set_b, bands, sketch) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            hashes, _, _, rows = words(*utf8(batch.column("text")))
            values, counts = shingles(hashes, rows, batch.num_rows)
            samples = minhashes(values, counts)
            grouped = samples.reshape(len(samples), BANDS, BAND_ROWS) * odd_constants(BAND_ROWS, 24)
            bands = mix64(grouped.sum(axis=2, dtype=np.uint64) ^ odd_constants(BANDS, 25)[None, :])
            full = (counts > 0).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            sets = np.frombuffer(b"".join(hashlib.blake2b(values[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(counts))), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array(sets[:, 0]),
                    pa.array(sets[:, 1]),
                    list_column(bands.view(np.int64).ravel(), full * BANDS, pa.int64()),
                    list_column(odd_sketch(samples).view(np.int64).ravel(), full * (SKETCH_BITS // 64), pa.int64()),
                ],
                ["doc_id", "n", "set_a", "set_b", "bands", "sketch"],
            )

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) from (doc_id, n_bytes, packed)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches, SLICE):
            hashes, _, _, rows = words(*utf8(pa.array(texts, pa.binary())))
            values, counts = shingles(hashes, rows, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(values.view(np.int64), counts, pa.int64())], ["doc_id", "shingles"])

    return docs.select("doc_id", "n_bytes", "packed").mapInArrow(sets, "doc_id bigint, shingles array<bigint>")


def may_link(n: tuple[Column, Column], threshold: int) -> Column:
    """Sizes alone allow a similarity of threshold percent."""
    return F.least(*n) * 100 >= F.greatest(*n) * threshold


def sketch_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity by the number of bits in which two odd sketches differ; 0 where that says nothing."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    rest = F.lit(1.0) - 2 * differ / F.lit(SKETCH_BITS)
    return F.when(rest <= 0, 0.0).otherwise(1 + F.log(rest) * F.lit(SKETCH_BITS / (4 * MINHASHES)))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(common * 100 >= (F.size("_sa") + F.size("_sb") - common) * threshold).select("a", "b")


def cross_counts(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, cross): how many shingles of each class occur in another component too.

    No link to another component can have more shingles in common.
    """
    own = labelled.select("rep", "component").distinct()
    held = sets.join(own, sets["doc_id"] == own["rep"]).select("rep", "component", F.explode("shingles").alias("shingle"))
    shared = held.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    return held.join(shared, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("cross"))


def blocks_of(many: Column) -> Column:
    """Blocks that so many rows are dealt out in."""
    return F.greatest(F.ceil(many / F.lit(float(BLOCK))).cast("int"), F.lit(1))


def own_block(rep: Column, many: Column) -> Column:
    return F.pmod(F.xxhash64(rep), blocks_of(many)).cast("int")


def all_blocks(many: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks_of(many) - 1))


def by_pivot(buckets: DataFrame, threshold: int) -> DataFrame:
    """The members of each bucket but its pivot, the most popular one, with the pivot where size and sketch leave a link to it possible.

    So all pairs with a pivot are judged, and only those of the members that are left are still open.
    """
    pivots = buckets.groupBy("key").agg(F.max_by(F.struct("rep", "n", "sketch"), F.struct("popularity", "rep")).alias("pivot"), F.first("many").alias("many"))
    pivots = pivots.select("key", "pivot", all_blocks(F.col("many")).alias("block"))
    own = buckets.withColumn("block", own_block(F.col("rep"), F.col("many")))
    rest = own.join(pivots, ["key", "block"]).where(F.col("rep") != F.col("pivot.rep"))
    alike = may_link((F.col("n"), F.col("pivot.n")), threshold) & (sketch_similarity(F.col("sketch"), F.col("pivot.sketch")) >= SKETCH_FLOOR)
    return rest.select("key", "rep", "n", "many", "sketch", F.when(alike, F.col("pivot.rep")).alias("pivot"))


def main_counts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, main, held): how many shingles of a class occur in the main component of a bucket that it is in."""
    mains = rows.where("component = main").select("rep", "main").distinct()
    theirs = sets.join(mains, sets["doc_id"] == mains["rep"]).select("main", F.explode("shingles").alias("shingle")).distinct()
    asked = rows.where("component <> main").select("rep", "main").distinct()
    own = sets.join(asked, sets["doc_id"] == asked["rep"]).select("rep", "main", F.explode("shingles").alias("shingle"))
    return own.join(theirs, ["main", "shingle"], "left_semi").groupBy("rep", "main").agg(F.count("*").alias("held"))


def in_several(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, rep, n, sketch) of buckets with members of several components: with their component, the bucket's most frequent one, its number of rows and those outside it."""
    stars = parts.where("node <> component").select(F.col("node").alias("rep"), "component")
    labelled = rows.join(stars, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("own"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.sum("own").alias("many"), F.max("own").alias("of_main"))
    main = main.where("of_main < many").select("key", "main", "many", (F.col("many") - F.col("of_main")).alias("asking"))
    return labelled.join(main, "key")


def across(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of one bucket and different components that can be similar, by what they can have in common and by their sketches.

    A pair of several common buckets comes from the one of least key; where one of the two is the pivot there, it is judged already.
    A bucket's rows and those that are compared with them are both cut into blocks, and each pair of blocks is a key of its own.
    """
    asking = rows.where("component <> main").join(main_counts(rows, sets), ["rep", "main"], "left")
    asking = asking.withColumns({"q_block": own_block(F.col("rep"), F.col("asking")), "block": all_blocks(F.col("many"))})
    asking = asking.select("key", "block", "q_block", *[F.col(c).alias(f"q_{c}") for c in ("rep", "n", "cross", "component", "held", "bands", "sketch")])
    rows = rows.withColumns({"block": own_block(F.col("rep"), F.col("many")), "q_block": all_blocks(F.col("asking"))})
    of_main = F.col("component") == F.col("main")
    other = (F.col("component") != F.col("q_component")) & (of_main | (F.col("rep") < F.col("q_rep")))
    common = F.least("cross", "q_cross", F.when(of_main, F.coalesce("q_held", F.lit(0))))
    near = common * 100 >= (F.col("n") + F.col("q_n") - common) * threshold
    alike = sketch_similarity(F.col("sketch"), F.col("q_sketch")) >= SKETCH_FLOOR
    once = F.array_min(F.array_intersect("bands", "q_bands")) == F.col("key")
    found = rows.join(asking, ["key", "block", "q_block"]).where(other & near & alike & once)
    return found.select(F.least("rep", "q_rep").alias("a"), F.greatest("rep", "q_rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each document."""
    given = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{id_column}`").cast("bigint").alias("id"))
    rows = document_keys(given)
    keys = None if rows is given else checkpointed(rows.select("doc_id", "id"))
    rows = rows.select("doc_id", "text")
    signed = checkpointed(signatures(rows))
    classes = signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes)
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = keyed.join(shared, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "many")).alias("buckets"), F.sum("many").alias("popularity"))  # at most BANDS a row
    members = checkpointed(members.join(classes.select("rep", "n", "sketch"), "rep"))
    texts = packed(rows.withColumn("rest", F.struct(F.lit(0).alias("none"))))
    sets = checkpointed(shingle_sets(texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")))

    buckets = members.select("rep", "n", "sketch", "popularity", F.inline("buckets"))
    rest = checkpointed(by_pivot(buckets, threshold))
    tried = rest.where("pivot is not null").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    parts = components(confirmed(tried.distinct(), sets, threshold))
    open_ = checkpointed(in_several(rest.where("many > 2").select("key", "rep", "n", "sketch"), parts))
    more = cross_counts(open_, sets).join(members.select("rep", F.col("buckets.key").alias("bands")), "rep")
    open_ = checkpointed(open_.join(more, "rep").where(F.col("cross") * 100 >= F.col("n") * threshold))
    second = confirmed(across(open_, sets, threshold).join(tried, ["a", "b"], "left_anti"), sets, threshold)
    parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))

    owners = classes.select("set_a", "set_b", "rep").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "set_a", "set_b").join(owners, ["set_a", "set_b"], "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    if keys is None:
        return out
    own = keys.distinct().select(F.col("doc_id").alias("_key"), F.col("id").alias("_id"))
    first = own.select(F.col("_key").alias("_first"), F.col("_id").alias("_of"))
    named = out.join(own, F.col("doc_id") == F.col("_key")).join(first, F.col("component_id") == F.col("_first"))
    return named.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("_of").alias("component_id"), "kept")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
