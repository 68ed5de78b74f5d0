"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds the
vectors of its letters, the first two permuted (rolled) by two and one places,
by multiplication; a text's vector bundles its trigrams by addition.  The
prototype of a language bundles the normalised vectors of its training texts,
and a text gets the language whose prototype has the largest cosine.

Training takes about `PER_LANGUAGE` texts of each of the `MOST_LANGUAGES` most
frequent languages, a hash sample of their ids; prediction covers all whole
texts.  Letters are lower-cased code points modulo `LETTERS` - 1, so that every letter of the
alphabets below U+0FFF has a vector of its own, and ideographs share vectors.
`DIMENSIONS` leave a noise of about 1 / sqrt(512) = 0.044 on a cosine of unrelated
vectors; profiles of languages differ by several times that.

Defined results: a null or empty text, or one without letters, is `und` with
score 0; so is every text if there is nothing to learn from.  Equal cosines go to the
language that is first by name.  Score is the share of the best language in the
softmax of all cosines, sharpened by `SHARPNESS`.  Rows are judged each by its
own text, so repeated rows and ids give equal results; rows with a null id are
predicted but not learnt from; a text of any length is read whole, its trigrams in
blocks.  An empty table gives an empty one; only id and text of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_slices, utf8

DIMENSIONS = 512
PER_LANGUAGE = 400
SHARPNESS = 20.0
LETTERS = 1 << 12
MOST_LANGUAGES = 1_000
VECTORS = 20_000
GROUP = 64


@cache
def letter_codes() -> np.ndarray:
    """Of each code point: 1 + its letter's code (lower-cased), or 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = 1 + ord(low[0]) % (LETTERS - 1)
    return out


@cache
def letter_vectors() -> np.ndarray:
    """Vectors of the letter codes; code 0 is the space between words."""
    return np.random.default_rng(61).integers(0, 2, (LETTERS, DIMENSIONS), np.int8) * 2 - 1


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    a, b, c = trigrams // LETTERS**2, trigrams // LETTERS % LETTERS, trigrams % LETTERS
    return (np.roll(letters[a], 2, axis=1) * np.roll(letters[b], 1, axis=1) * letters[c]).astype(np.float32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigram and count of the distinct trigrams of each text; runs of other characters count as one space."""
    n = len(offsets) - 1
    # Code points from UTF-8: the bytes that begin one, and their rows.
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))[(data & 0xC0) != 0x80]
    code = letter_codes()[points]
    keep = code > 0
    keep[:1] = True
    keep[1:] |= (code[:-1] > 0) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = code.astype(np.int64)
    value = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
    whole = (row[:-2] == row[2:]) & (value > 0)
    pairs, counts = np.unique(row[:-2][whole] * LETTERS**3 + value[whole], return_counts=True)
    return pairs // LETTERS**3, pairs % LETTERS**3, counts


class Profiles:
    """Bundles texts into vectors; keeps the vectors of trigrams that it has met, up to VECTORS."""

    def __init__(self) -> None:
        self.known, self.vectors = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32)

    def bundle(self, n: int, row: np.ndarray, trigram: np.ndarray, count: np.ndarray) -> np.ndarray:
        met = np.unique(trigram)
        if len(met) > VECTORS:
            block = np.searchsorted(met[::VECTORS], trigram, side="right")
            return sum(self.bundle(n, row[block == k], trigram[block == k], count[block == k]) for k in np.unique(block))
        place = np.searchsorted(self.known, met)
        new = met[(place >= len(self.known)) | (self.known[np.minimum(place, max(0, len(self.known) - 1))] != met if len(self.known) else True)]
        if len(new):
            if len(self.known) + len(new) > VECTORS:
                self.known, self.vectors, new = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), met
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.vectors = known[order], np.concatenate([self.vectors, trigram_vectors(new)])[order]
        place = np.searchsorted(self.known, trigram)
        out = np.zeros((n, DIMENSIONS), np.float32)
        for start in range(0, n, GROUP):
            a, b = np.searchsorted(row, [start, start + GROUP])
            counts = np.zeros((min(GROUP, n - start), len(self.known)), np.float32)
            counts[row[a:b] - start, place[a:b]] = count[a:b]
            out[start : start + GROUP] = counts @ self.vectors
        return out


def text_vectors(profiles: Profiles, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts, and whether each has a letter."""
    data, offsets = utf8(column)
    # A blank on either side lets a text of one letter have a trigram.
    padded = pa.array([f" {x} " for x in column.fill_null("").to_pylist()])
    vectors = profiles.bundle(len(column), *trigrams(*utf8(padded)))
    length = np.linalg.norm(vectors, axis=1)
    has = np.array([bool(x) for x in length > 0]) & (np.diff(offsets) > 0)
    return vectors / np.maximum(length, 1e-9)[:, None], has


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from (text, lang); one row of DIMENSIONS sums a language and task reaches the driver."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), {}
        for batch in text_slices(batches, "text"):
            vectors, has = text_vectors(profiles, batch.column("text"))
            for lang, vector, ok in zip(batch.column("lang").to_pylist(), vectors, has, strict=True):
                if ok:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = rows.select("text", "lang").mapInArrow(bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector"))
    found = parts.groupBy("lang", "pos").agg(F.sum("col").alias("value")).toPandas()
    if not len(found):
        return [], np.zeros((0, DIMENSIONS))
    wide = found.pivot(index="lang", columns="pos", values="value").sort_index()
    values = wide.to_numpy()
    return list(wide.index), values / np.maximum(np.linalg.norm(values, axis=1), 1e-9)[:, None]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    names, prototypes = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in text_slices(batches, "text"):
            vectors, has = text_vectors(profiles, batch.column("text"))
            if names:
                cosines = vectors @ prototypes.T
                best = cosines.argmax(axis=1)
                weight = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                score = np.where(has, 1 / weight.sum(axis=1), 0.0)
            else:
                has, best, score = np.zeros(len(vectors), bool), np.zeros(len(vectors), int), np.zeros(len(vectors))
            langs = [names[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(predict, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_column)


def training_rows(docs: DataFrame, fold: int = 3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang) of the training: crc32(doc_id) mod fold is not 1, and about per_language rows of each language by a hash of the id."""
    known = docs.where("lang is not null and text is not null").where(crc_mod("doc_id", fold) != 1)
    often = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not often:
        return known.select("text", "lang")
    least = F.create_map(*[F.lit(x) for r in often for x in (r.lang, int(min(1.0, per_language / r["count"]) * (1 << 32)))])
    draw = F.crc32(F.concat(F.lit("langid:"), F.col("doc_id").cast("string")).cast("binary"))
    return known.where(draw < F.try_element_at(least, F.col("lang"))).select("text", "lang")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
