"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

`statistics` measures each whole text; `fit` maps the standardised statistics to
random Fourier features (which approximate a Gaussian kernel), sums the normal
equations by partition, solves the ridge problem, and fits an isotonic curve on
rows that the regression has not seen.  Everything that reaches the driver is
bounded by the number of features or bins, whatever the number of rows.

Training takes about `TRAIN_ROWS` labelled rows at most, a hash sample over all
of them, so that its cost does not grow with the corpus; scoring covers all rows.
The curve is fitted to the shares of label 1 in `BINS` equal ranges of the raw
score and drawn straight between their middles: rows whose raw scores differ by
less than a range (0.01) may get closer scores than an exact isotonic fit would give.

Defined results: a null text counts as an empty one; an empty text has
statistics of zero and is scored like any other; without labelled rows of both
classes every score is the share of label 1, or 0.5 if there are none.  Texts of any
length are measured whole.  Rows that repeat an id, and rows of a null id, are
scored each by its own text; labels that repeat an id count as their maximum, and
a null id or label is never learnt from; equal raw scores get equal scores.  An
empty table gives an empty one; only doc_id, text and the columns that are asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, mix64, odd_constants, shingles, table, text_slices, utf8, words

FEATURES = 256
GAMMA = 0.03
RIDGE = 1e-5
BINS = 200
TRAIN_ROWS = 60_000
THRESHOLD = 0.3
PARTS = 8

STATISTICS = (
    "log_bytes", "upper", "digit", "space", "stop", "symbol", "high", "log_words", "word_length", "word_spread", "distinct_words", "distinct_trigrams", "line_length", "distinct_lines", "symbol_end", "one_word", "same_word",
)


def _class(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(chars)] = 1
    return found


UPPER, DIGIT, BLANK = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b" \t")
STOP, HIGH = _class(b".,;:?'-"), _class(bytes(range(128, 256)))
SYMBOL = _class(b"!\"#$%&()*+/<=>@[\\]^_`{|}~")


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each text, shape (rows, len(STATISTICS))."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.diff(offsets)
    safe = np.maximum(size, 1)

    def share(lut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(lut[data])])[offsets]) / safe

    out[:, 0] = np.log1p(size)
    for k, lut in enumerate((UPPER, DIGIT, BLANK, STOP, SYMBOL, HIGH), 1):
        out[:, k] = share(lut)
    hashes, starts, ends, rows = words(data, offsets)
    counts = np.bincount(rows, minlength=n)
    some = np.maximum(counts, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(rows, length, n) / some
    out[:, 7] = np.log1p(counts)
    out[:, 8] = np.log1p(mean)
    out[:, 9] = np.log1p(np.sqrt(np.maximum(0, np.bincount(rows, length**2, n) / some - mean**2)))
    grams, gram_counts = shingles(hashes, rows, n, 3)
    out[:, 11] = gram_counts / np.maximum(counts - 2, 1)
    out[:, 14] = np.bincount(rows, SYMBOL[data[ends - 1]] if len(ends) else None, n) / some
    bounds = np.concatenate([[0], np.cumsum(counts)])
    # Lines are words here: the sum of the hashes between two line ends, with their order.
    line_end = np.cumsum(data == 10)
    for i in range(n):
        own = hashes[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        values, often = np.unique(own, return_counts=True)
        out[i, 10] = len(values) / len(own)
        out[i, 15] = often.max() / len(own)
        out[i, 16] = np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0
        line = line_end[starts[bounds[i] : bounds[i + 1]]]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        sums = mix64(np.add.reduceat(own * (np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) + 1).astype(np.uint64), first))
        out[i, 12] = np.log1p(len(own) / len(first))
        out[i, 13] = len(np.unique(sums)) / len(sums)
    return out


def statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, and a double for each of STATISTICS) of each whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = measure(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(x)) for x in found.T]], ["id", *STATISTICS])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{name} double" for name in STATISTICS)
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(rows, schema).withColumnRenamed("id", id_column)


class Model:
    """Standardisation, random features, ridge weights and calibration curve."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 31) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.maximum(deviation, 1e-9)
        self.frequencies = random.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(scaled @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing values nearest to the given ones, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in STATISTICS]) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def fit(rows: DataFrame, label: str, calibrate: str) -> Model:
    """Fit on rows with STATISTICS, a 0/1 label, and a boolean that marks the rows of the calibration."""
    moments = rows.agg(F.count("*"), F.avg(label), *[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
    k = len(STATISTICS)
    if not moments[0] or moments[1] in (0.0, 1.0):
        model = Model(np.zeros(k), np.ones(k))
        model.values = np.full(2, 0.5 if not moments[0] else moments[1])
        return model
    model = Model(np.array(moments[2 : 2 + k], float), np.array(moments[2 + k :], float))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_matrix(batch))
            total += z.T @ np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "value"])

    sums = rows.where(~F.col(calibrate)).select(*STATISTICS, F.col(label).cast("double").alias("label")).mapInArrow(equations, "place int, value double")
    found = sums.groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
    if len(found):
        found = found.reshape(FEATURES + 1, FEATURES + 2)
        rows_seen = found[-1, -2]
        model.weights = np.linalg.solve(found[:, :-1] + RIDGE * max(1.0, rows_seen) * np.eye(FEATURES + 1), found[:, -1])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS, 2))
        for batch in batches:
            place = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            np.add.at(total, place, np.column_stack([np.ones(len(place)), batch.column("label").to_numpy(zero_copy_only=False)]))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["bin", "n", "ones"])

    seen = rows.where(F.col(calibrate)).select(*STATISTICS, F.col(label).cast("double").alias("label")).mapInArrow(histogram, "bin int, n double, ones double")
    bins = seen.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n > 0").orderBy("bin").toPandas()
    if len(bins):
        model.knots = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
        model.values = isotonic((bins["ones"] / bins["n"]).to_numpy(), bins["n"].to_numpy())
    else:
        model.values = np.full(2, moments[1])
    return model


def with_score(measured: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` and score of each row with STATISTICS."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(_matrix(batch)))], [*keep, "score"])

    schema = ", ".join(f"`{c}` {measured.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return measured.select(*keep, *STATISTICS).mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, and the columns `keep`): rows with crc32(doc_id) mod fold = 0 are held out of the training."""
    rows = docs.select(F.struct("doc_id", *keep).alias("id"), "text")
    measured = checkpointed(statistics(rows, "id").select("id.*", *STATISTICS))
    own = labels.groupBy("doc_id").agg(F.max(label).alias("label")).where("label is not null").where(crc_mod("doc_id", fold) != 0)
    many = own.count()
    share = min(1.0, train_rows / max(1, many))
    draw = F.crc32(F.concat(F.lit("train:"), F.col("doc_id").cast("string")).cast("binary"))
    own = own.where(draw < F.lit(int(share * (1 << 32)))).withColumn("calibrate", crc_mod("doc_id", fold) == 1)
    train = checkpointed(measured.join(own, "doc_id").repartition(PARTS, "doc_id"))
    scored = with_score(measured, fit(train, "label", "calibrate"), ["doc_id", *keep])
    return scored.select("doc_id", (crc_mod("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *keep)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
