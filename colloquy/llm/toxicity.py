"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, reported speech,
article, other).  Five transducers read the classes of a clause; each hands
every symbol on, some with a mark, and gives it a weight:

* negation: marks what follows a negation with nothing but articles between;
* reported speech: marks all that follows a verb of saying;
* target: marks what comes within `NEAR` words after a target;
* insult: weighs insults by their marks, and a target soon after one;
* threat: weighs threats by their marks, in full once a target follows.

`composed` makes one transducer of two: its states are the pairs of their states
that can be reached, and weights of one symbol add up.  `GRAMMAR` is the
composition of all five, so a clause is read once.  Clauses are scored, not
words; a text's features are the sum and the maximum of its clause scores, and a
logistic curve maps them to 0..1.

The insult lexicon starts from `INSULTS`; further terms and all weights are
learnt from up to about `TRAIN_ROWS` labelled rows, a hash sample over all: half
for the terms, half for the curve.  At most `MOST_TERMS` terms are learnt, those
of greatest log-likelihood ratio of at least `LEAST_G` whose log odds are at
least `LEAST_WEIGHT`.  A known word that is learnt keeps its class: an insult or
threat gets the learnt weight, words of the other classes stay as they are.

Defined results: a null text is an empty one; a text without matches, an empty
one too, gets the curve's lowest score; without labels of both kinds the curve
is `DEFAULT_CURVE`.  A text of any length is read whole.  Terms of equal ratio
are ordered by their hash.  Rows that repeat an id are scored each by its own
text; labels that repeat an id count as their maximum; a null id or label is
never learnt from.  An empty table gives an empty one.  Only the columns doc_id
and text of the documents are read, whatever others they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, table, text_slices, utf8, words

TRAIN_ROWS = 40_000
MOST_TERMS = 3_000
LEAST_G = 24.0
LEAST_WEIGHT = 3.0
THRESHOLD = 0.3
DEFAULT_CURVE = (-4.0, 1.0, 1.0)

# Words of the grammar's classes.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown dumb fool jerk imbecile coward filth parasite vermin idiote imbécile abruti crétin ordure dummkopf trottel abschaum versager estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy beat attack murder strangle shoot stab burn tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your yourself u he she him her they them people tu toi vous ton ta tes du dich dir ihr euch dein tú te ti usted ustedes".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn nicht kein keine nie pas jamais ni nunca".split()
REPORTS = "said says say called calls quoted wrote claimed reported according dit disait écrit sagte sagt nannte dijo dice llamó".split()
ARTICLES = "a an the so very such un une le la ein eine einen una el".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, ARTICLE = range(7)
INSULT_WEIGHT, THREAT_WEIGHT = 4.0, 4.0
NEAR = 3


CLASSES = 7
#: A symbol is a class plus CLASSES times the sum of its marks.
NEGATED, REPORTED, AIMED = 1, 2, 4
SYMBOLS = CLASSES * 8


@dataclass(frozen=True)
class Transducer:
    """Tables by state and symbol; state 0 is the start.

    An arc's weight is factor times the weight of the word that is read plus
    bonus times the greatest word weight of the clause so far.
    """

    following: np.ndarray
    output: np.ndarray
    factor: np.ndarray
    bonus: np.ndarray

    @classmethod
    def of(cls, states: int, step) -> Transducer:
        """step(state, class, marks) gives (next state, marks, factor, bonus)."""
        tables = [np.zeros((states, SYMBOLS), kind) for kind in (np.int64, np.int64, float, float)]
        for state in range(states):
            for symbol in range(SYMBOLS):
                kind, marks = symbol % CLASSES, symbol // CLASSES
                after, marked, factor, bonus = step(state, kind, marks)
                for table_, value in zip(tables, (after, kind + CLASSES * marked, factor, bonus), strict=True):
                    table_[state, symbol] = value
        return cls(*tables)


def composed(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; weights add up.  Only pairs of states that can be reached become states."""
    number, queue, rows = {(0, 0): 0}, [(0, 0)], []
    for x, y in queue:
        middle = a.output[x]
        after = list(zip(a.following[x].tolist(), b.following[y, middle].tolist(), strict=True))
        for pair in after:
            if pair not in number:
                number[pair] = len(number)
                queue.append(pair)
        rows.append(([number[pair] for pair in after], b.output[y, middle], a.factor[x] + b.factor[y, middle], a.bonus[x] + b.bonus[y, middle]))
    return Transducer(*(np.array(x) for x in zip(*rows, strict=True)))


def _said(marks: int) -> float:
    return 0.4 if marks & REPORTED else 1.0


def _negation(state: int, kind: int, marks: int) -> tuple[int, int, float, float]:
    """State 1: a negation is open."""
    return int(kind == NEGATION or (state and kind == ARTICLE)), marks | (NEGATED if state else 0), 0.0, 0.0


def _reported(state: int, kind: int, marks: int) -> tuple[int, int, float, float]:
    """State 1: a verb of saying was read."""
    return int(state or kind == REPORT), marks | (REPORTED if state else 0), 0.0, 0.0


def _target(state: int, kind: int, marks: int) -> tuple[int, int, float, float]:
    """State 0: no target near; k: NEAR + 1 - k words since a target, of which the last still is near."""
    return NEAR if kind == TARGET else max(0, state - 1), marks | (AIMED if state else 0), 0.0, 0.0


def _insult(state: int, kind: int, marks: int) -> tuple[int, int, float, float]:
    """States as of `_target`, for insults."""
    factor = _said(marks) * (0.1 if marks & NEGATED else 1.25 if marks & AIMED else 1.0) if kind == INSULT else 0.0
    bonus = 0.25 * _said(marks) if kind == TARGET and state else 0.0
    return NEAR if kind == INSULT else max(0, state - 1), marks, factor, bonus


def _threat(state: int, kind: int, marks: int) -> tuple[int, int, float, float]:
    """State 1: a threat waits for its target."""
    factor = _said(marks) * (0.1 if marks & NEGATED else 1.0 if marks & AIMED else 0.25) if kind == THREAT else 0.0
    bonus = 0.75 * _said(marks) if kind == TARGET and state else 0.0
    return int(kind != TARGET and (state or kind == THREAT)), marks, factor, bonus


PARTS = tuple(Transducer.of(n, step) for n, step in ((2, _negation), (2, _reported), (NEAR + 1, _target), (NEAR + 1, _insult), (2, _threat)))
GRAMMAR = reduce(composed, PARTS)

# Letters, digits and bytes of other scripts make words; these bytes end a clause.
BETWEEN = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[*b".!?;:\n"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cases the capitals of Latin-1 in UTF-8 (A-Z is done by the hash)."""
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(capital, data + np.uint8(0x20), data)


def hashed(terms: list[str]) -> np.ndarray:
    column = pa.array(terms)
    data, offsets = utf8(column)
    return words(lowered(data), offsets, BETWEEN)[0]


def _scores(classes: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of clauses that lie one after the other; all clauses take their next step together."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, left = starts[order], np.sort(lengths)
    state, total, held = np.zeros(len(order), np.int64), np.zeros(len(order)), np.zeros(len(order))
    for t in range(int(lengths.max(initial=0))):
        n = len(left) - int(np.searchsorted(left, t, side="right"))
        at = starts[:n] + t
        own, weight = classes[at], weights[at]
        total[:n] += GRAMMAR.factor[state[:n], own] * weight + GRAMMAR.bonus[state[:n], own] * held[:n]
        held[:n] = np.maximum(held[:n], weight)
        state[:n] = GRAMMAR.following[state[:n], own]
    out = np.zeros(len(order))
    out[order] = total
    return out


class Lexicon:
    """Class and weight of the known words, found by binary search of their hashes."""

    def __init__(self, learnt: dict[int, float] | None = None) -> None:
        known: dict[int, tuple[int, float]] = {}
        for kind, terms, weight in ((ARTICLE, ARTICLES, 0), (REPORT, REPORTS, 0), (NEGATION, NEGATIONS, 0), (TARGET, TARGETS, 0), (THREAT, THREATS, THREAT_WEIGHT), (INSULT, INSULTS, INSULT_WEIGHT)):
            known |= {int(h): (kind, weight) for h in hashed(terms)}
        for h, w in (learnt or {}).items():
            kind = known.get(h, (INSULT, 0))[0]
            if kind in (INSULT, THREAT):
                known[h] = (kind, w)
        self.hashes = np.array(sorted(known), np.uint64)
        self.classes = np.array([known[int(h)][0] for h in self.hashes])
        self.weights = np.array([known[int(h)][1] for h in self.hashes], float)

    def clauses(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and score of each clause that holds an insult or a threat."""
        data = lowered(data)
        hashes, starts, _, rows = words(data, offsets, BETWEEN)
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes
        classes = np.where(hit, self.classes[place], OTHER)
        ends = np.concatenate([[0], np.cumsum(CLAUSE_END[data])])[starts]
        begins = np.flatnonzero(np.concatenate([[True], (ends[1:] != ends[:-1]) | (rows[1:] != rows[:-1])]))
        bounds = np.append(begins, len(hashes))
        marked = np.unique(np.searchsorted(begins, np.flatnonzero((classes == INSULT) | (classes == THREAT)), side="right") - 1)
        # After NEAR other words in a row nothing but the reported state and a waiting threat is left, so further ones change nothing.
        clause = np.repeat(np.arange(len(begins)), np.diff(bounds))
        wanted = np.zeros(len(begins), bool)
        wanted[marked] = True
        since = np.arange(len(classes)) - np.maximum.accumulate(np.where(classes != OTHER, np.arange(len(classes)), 0))
        kept = np.flatnonzero(wanted[clause] & ((since <= NEAR) | (np.arange(len(classes)) - begins[clause] < NEAR)))
        weights = np.where((classes == INSULT) | (classes == THREAT), self.weights[place], 0.0)
        lengths = np.bincount(clause[kept], minlength=len(begins))[marked]
        return rows[begins[marked]], _scores(classes[kept], weights[kept], lengths)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log(1 + sum) and maximum of the clause scores of each text."""
        n = len(offsets) - 1
        rows, scores = self.clauses(data, offsets)
        most = np.zeros(n)
        np.maximum.at(most, rows, scores)
        return np.log1p(np.bincount(rows, scores, n)), most


def learn_terms(rows: DataFrame) -> dict[int, float]:
    """Weights (log odds) of the words that mark toxic texts, by their hashes, from (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            hashes, _, _, own = words(lowered(data), offsets, BETWEEN)
            order = np.lexsort((hashes, own))
            hashes, own = hashes[order], own[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
            terms, where = np.unique(hashes[first], return_inverse=True)
            toxic = np.bincount(where, label[own[first]], len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(toxic), pa.array(np.bincount(where, minlength=len(terms)) - toxic)], ["term", "toxic", "clean"])

    totals = rows.groupBy("label").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in totals if r["label"] == y) for y in (1, 0))
    if not n_toxic or not n_clean:
        return {}
    counts = rows.select("text", "label").mapInArrow(count, "term bigint, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    base = n_toxic / (n_toxic + n_clean)
    both = F.col("t") + F.col("c")
    g = 2 * (F.col("t") * F.log(F.col("t") / (both * base)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - base)))).otherwise(0.0))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    found = counts.where("t > 1").select("term", g.alias("g"), weight.alias("weight")).where((F.col("g") >= LEAST_G) & (F.col("weight") >= LEAST_WEIGHT))
    return {r.term % (1 << 64): r.weight for r in found.orderBy(F.desc("g"), "term").limit(MOST_TERMS).collect()}


def measured(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """Columns `keep`, total and most: the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            total, most = lexicon.features(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(total), pa.array(most)], [*keep, "total", "most"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", total double, most double"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit_curve(rows: DataFrame) -> tuple[float, float, float]:
    """Bias and weights of total and most, by Newton's method on (total, most, label), whose number is bounded by TRAIN_ROWS."""
    found = rows.select("total", "most", "label").toPandas()
    if found["label"].nunique() < 2:
        return DEFAULT_CURVE
    x = np.column_stack([np.ones(len(found)), found["total"], found["most"]])
    y, w = found["label"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * w)
    return tuple(w.tolist())


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, total, most): rows with crc32(doc_id) mod fold = 2 are held out of the training."""
    own = labels.groupBy("doc_id").agg(F.max(label).alias("label")).where("label is not null").where(crc_mod("doc_id", fold) != 2)
    share = min(1.0, train_rows / max(1, own.count()))
    draw = F.crc32(F.concat(F.lit("train:"), F.col("doc_id").cast("string")).cast("binary"))
    own = checkpointed(own.where(draw < F.lit(int(share * (1 << 32)))).withColumn("half", F.pmod(draw, F.lit(2))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The sample has train_rows ids as its mean, which bounds the broadcast; only the texts of the training move.
    drawn = own.count()
    if drawn > 2 * train_rows:
        raise ValueError(f"{drawn} rows were drawn for a training of {train_rows}")
    train = checkpointed(rows.join(F.broadcast(own), "doc_id"))
    lexicon = Lexicon(learn_terms(train.where("half = 0")))
    curve = fit_curve(measured(train.where("half = 1"), lexicon, ["label"]))
    found = measured(rows, lexicon, ["doc_id"])
    z = F.lit(curve[0]) + F.lit(curve[1]) * F.col("total") + F.lit(curve[2]) * F.col("most")
    score = 1 / (1 + F.exp(-z))
    return found.select("doc_id", (crc_mod("doc_id", fold) == 2).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "total", "most")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
