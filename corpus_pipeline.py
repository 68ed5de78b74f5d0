"""A training-data pipeline over the documents: five stages, each by one corpus operator.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of `documents`.  All stages take whole texts of any
length, hand the other columns on as they are (the columns are those of
`documents`; a stage's own names never reach its result, but those of the last),
and give an empty table for an empty one.  Rows are told apart by id and text: a
null id is an id like any other, the last in order, and texts that share an id
are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, document_keys, table
from colloquy.llm.mixing import mix
from colloquy.llm.neardup import near_duplicates
from colloquy.llm.pieces import Vocabulary, encode
from colloquy.llm.quality import quality
from colloquy.llm.repeats import remove_repeats


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, row) with a key for each id and text as doc_id, and whether keys and ids are the same."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    keyed = document_keys(rows)
    return keyed, keyed is rows


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is judged like an empty one; equal rows are judged alike, so all of them stay or go.
    """
    keyed, _ = _keyed(docs)
    rows = keyed.select(F.col("row.doc_id").alias("doc_id"), "text", F.col("doc_id").alias("key"))
    accepted = quality(rows, table(spark, sf_dir, "labels"), keep=("key",)).where("predicted = 1").select(F.col("key").alias("doc_id"))
    return keyed.join(accepted.distinct(), "doc_id", "left_semi").select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near duplicates.

    Null and empty texts are in no group and stay; of rows that repeat an id with its text one stays.
    """
    keyed, unique = _keyed(docs)
    kept = near_duplicates(keyed.select("doc_id", "text")).where("kept").select("doc_id")
    found = keyed.join(kept.distinct(), "doc_id", "left_semi")
    return (found if unique else found.dropDuplicates(["doc_id"])).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier passages; a document may become empty.

    A null text becomes an empty one; equal rows are cut alike; n_chars is that of the text that is left.
    """
    cut = remove_repeats(docs)
    text = {"text": F.col("text"), "doc_id": F.col("doc_id"), "n_chars": F.length("text").cast("bigint")}
    return cut.select(*[(text[c] if c in text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, the last one if at least half of it is taken.

    A document without words, so one of a null or empty text too, is taken never; a null source is a source; equal rows are taken equally often.
    """
    taken = mix(docs.select("doc_id", "text", "source", F.struct("*").alias("row")))
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    chosen = taken.where("size > 0").withColumn("_copies", copies).where("_copies > 0")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the text that they decode to; null ids for a null text."""
    vocabulary = Vocabulary.load()
    return encode(docs, vocabulary, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: No SQL can express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
