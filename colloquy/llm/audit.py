"""How filters interact: one pass over the texts, then an incidence matrix product.

Every document gets a mask of the filters that it fails.  All that any order of the
filters does to a part of the corpus is a sum over masks, so the documents are only
counted: a part has three rows of 32 counts (all, good by its label, toxic by its label).
These rows, stacked, are multiplied by 32-by-600 matrices of 0 and 1, one column for each
step of each of the 120 orders.

Defined cases: a null text is an empty one, a null language the part named by the empty
string.  A null id counts as larger than any other; rows that repeat an id with its text
are documents of their own, none of which is a copy of the other.  Of several labels of
an id the largest holds.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_slices

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MASKS = 1 << STEPS
#: Least words, least percent of distinct words, most percent of capitals, and characters that fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 200, 50, 3, rb"[#$%&*|]"
#: Texts are split into words by pieces of this many bytes.
PIECE = 4 << 20
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Parts whose steps are written together.
PARTS = 64
STEP = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def word_counts(raw: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and distinct words of a text; no more than a piece is split at once."""
    total, seen, start = 0, set(), 0
    while start < len(raw):
        end = start + piece
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = raw[start:end].split()
        total += len(words)
        seen.update(words)
        start = end
    return total, len(seen)


def mask_of(raw: bytes) -> int:
    """Bits of the first four filters that a text fails; the fifth depends on other texts."""
    n, distinct = word_counts(raw)
    capitals, chars = len(raw) - len(raw.translate(None, CAPITALS)), len(raw.translate(None, CONTINUED))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, re.search(ODD, raw) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each document; equal digests of 128 bits stand for equal texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = pa.array([blake2b(x, digest_size=16).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digests, pa.array([mask_of(x) for x in raw], pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(measure, "doc_id bigint, part string, digest binary, mask int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): how many documents, good ones and toxic ones of a part have each mask.

    The first document of each text is found by a minimum for each digest and met again by
    digest and id together, so copies of one text are never dealt to one task; rows of a null id go by their digest.
    """
    rows = checkpointed(measured(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("toxic")).withColumn("spread", F.lit(b""))
    known = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(b""))).join(marks, ["doc_id", "spread"], "left")
    r, f = known.alias("r"), firsts.alias("f")
    both = r.join(f, (F.col("r.digest") == F.col("f.digest")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    of = lambda label: F.sum(F.col("n") * F.coalesce(label, F.lit(0))).alias(label)
    cells = both.select("part", mask.alias("mask"), "n", "good", "toxic").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32


def incidence() -> dict[str, np.ndarray]:
    """The 32-by-600 matrices of what becomes of a document with a mask at each step of each order."""
    bits = np.array([[1 << FILTERS.index(c) for c in order] for order in ORDERS])
    own = bits.reshape(1, -1)
    before = (np.cumsum(bits, axis=1) - bits).reshape(1, -1)
    masks = np.arange(MASKS)[:, None]
    fails, earlier = (masks & own) != 0, (masks & before) != 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": masks == own}
    return {name: m.astype(np.int64) for name, m in found.items()}


def interactions(counts: DataFrame) -> DataFrame:
    """The steps of all orders for each part, from (part, cells): 600 rows a part."""
    letters = np.array([FILTERS.index(c) for order in ORDERS for c in order])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence()
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                n = some.num_rows
                stacked = np.zeros((n, 3, MASKS), np.int64)
                for i, cells in enumerate(some.column("cells").to_pylist()):
                    for c in cells:
                        stacked[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                made = {name: stacked[:, 0] @ m for name, m in matrices.items()}
                lost = stacked[:, 1:].reshape(2 * n, MASKS) @ matrices["removed"]
                by_filter = made["removed"] @ np.eye(STEPS, dtype=np.int64)[letters]
                made |= {"good_lost": lost[0::2], "toxic_lost": lost[1::2], "shapley": by_filter[:, letters]}
                part = some.column("part").take(pa.array(np.repeat(np.arange(n), len(letters))))
                order, step = [o for o in ORDERS for _ in FILTERS] * n, np.tile(np.arange(1, STEPS + 1, dtype=np.int32), n * len(ORDERS))
                yield pa.RecordBatch.from_arrays([part, pa.array(order), pa.array(step), *[pa.array(x.ravel()) for x in made.values()]], ["part", "filter_order", "step", *made])

    return counts.mapInArrow(multiply, STEP)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of the filters keeps, removes, finds already removed, and loses of good and toxic documents."""
    return interactions(histograms(docs, labels))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
