"""The model that judges candidates of personal data: features, boosted trees, calibration.

The trees are fitted on the driver from a table of a few thousand rows, which is made
by a rule and has a fixed size: sentences with a gap, and forms of values that fill it.  A
value is personal data if the sentence says so, or its form leaves no doubt and the sentence
does not speak against it.  The candidates of these sentences are found by the same
generators and described by the same expressions as those of a corpus; the fitted trees go
back to Spark as a literal array for each kind.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trees of a kind, their shrinkage and penalty, and folds of calibration.
TREES, RATE, PENALTY, FOLDS = 30, 0.3, 1.0, 5
#: Of the candidates that are accepted out of fold, this share at least must be right; no candidate below LEAST is accepted.
PRECISION, LEAST = 0.95, 0.5
#: Fillings of each pair of a sentence and a form, and their seed.
FILLINGS, SEED = 2, 20240

WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|schreib|escrib|écri)",
    "ip": r"(?i)\b(?:ip|ipv4|ipv6|host|server|serveur|servidor|address|adresse|dirección|ping|login from|connected from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|debit|credit|cc|pan)\b",
    "phone": r"(?i)\b(?:tel|tél|phone|telephone|telefon|téléphone|teléfono|call|ring|fax|mobile|mobil|móvil|portable|handy|whatsapp|sms|text me|appel|llam|ruf)",
    "against": r"(?i)\b(?:version|release|order|invoice|rechnung|bestellung|facture|commande|pedido|isbn|issn|doi|page|pages|seite|section|abschnitt|date|datum|serial|item|ref|ticket|build|time|uhr|at line|ratio|score|id|sku|tracking)\b",
}

SENTENCES = {
    "email": ("mail me: {}", "Contact {} for details", "E-Mail {} oder Post", "courriel : {}", "correo {} o visita", "please write to {} soon", "my email is {}"),
    "ip": ("login from IP {} at noon", "the server {} did not answer", "client address {} was blocked", "Adresse {} gesperrt", "serveur {} indisponible", "ping {} fails"),
    "card": ("card number {} valid", "paid by Visa {} today", "Kreditkarte {} gültig", "carte {} refusée", "tarjeta {} caducada", "charge my credit card {} please"),
    "phone": ("call me on {} tonight", "Tel. {} (office)", "Telefon: {}", "tél. {} le soir", "mi móvil es {} gracias", "phone {} or fax", "WhatsApp {} anytime"),
    "none": ("{}", "we saw {} there", "und dann {} noch einmal", "puis {} encore", "luego {} otra vez", "in a row {} of things"),
    "against": ("version {} is out", "order {} was sent", "invoice {} of last month", "ISBN {} in print", "pages {} of the book", "on date {} it rained", "serial {} was found", "tracking {} is open", "build {} passed", "the score was {} then"),
}

#: Forms by kind, each with what it is: 2 leaves no doubt, 1 is personal data where the sentence says so, 0 never is.
#: # is a digit, * a digit that is not 0, ~ a letter, % a hexadecimal digit; L is a number with a right check digit, in fours where a sign follows.
FORMS = {
    "email": (("~~~~ (at) ~~~~~ (dot) com", 2), ("~~~~.~~~~ [at] ~~~~~~.org", 2), ("~~~~ at ~~~~~ dot net", 2), ("~~ö~~~@~~~~~.de", 2), ("~~~~ at ~~~~~.~~", 0), ("~~~~ at ~~~~~.~~~~~~~~", 0), ("~~~@~~~~", 0), ("~~@##", 0)),
    "ip": (("2001:db8:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%", 2), ("fe80::%%%%:%%%%:%%%%:%%%%", 2), ("2a0#:%%%%::%%", 2), ("*#[.]*#[.]*#[.]*#", 2), ("1*#(.)**(.)*(.)*#", 2), ("1#:*#:*#", 0), ("%%:%%:%%:%%:%%:%%", 0), ("*:*:*", 0), ("*,*,*,*", 0), ("*# . *# . *# . *#", 1), ("*#,*#,*#,*#", 0)),
    "card": (("L", 2), ("L-", 2), ("L ", 2), ("L.", 2), ("################", 1), ("*### #### #### ####", 1), ("*### ###### #####", 1), ("*#############", 0), ("*##################", 0)),
    "phone": (("(*##) ###-####", 2), ("00** *## ######", 2), ("0** #######", 1), ("0***/######", 1), ("*##-###-####", 1), ("0#-##-##-##-##", 1), ("*## ### ###", 1), ("0##########", 1), ("*#########", 1), ("*##.### ###", 1), ("20#*-0*-1#", 0), ("1#.0*.19##", 0), ("*-**", 0), ("#*.#*", 0), ("19##-20##", 0)),
}


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of at most 19 digits is right."""
    filled = F.lpad(number, 19, "0")
    places = [F.substring(F.translate(filled, "0123456789", "0246813579") if (18 - i) % 2 else filled, i + 1, 1).cast("int") for i in range(19)]
    return sum(places[1:], places[0]) % 10 == 0


def features(hit: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that describe a candidate's form and surroundings."""
    number, count = digits(hit), lambda pattern: F.regexp_count(hit, F.lit(pattern))
    yes = lambda condition: F.coalesce(condition.cast("int"), F.lit(0))
    groups = F.greatest(count("[0-9]+"), F.lit(1))
    return {
        "f_digits": F.length(number), "f_groups": count("[0-9]+"), "f_mean_group": F.length(number) / groups, "f_letters": count(r"\p{L}"), "f_size": F.length(hit),
        "f_check": yes((F.length(number) >= 13) & (F.length(number) <= 19) & luhn(number)), "f_issuer": yes(hit.rlike("^[3-6]")), "f_fours": yes(hit.rlike("^[0-9]{4}([ ./-][0-9]{4}){3}$")),
        "f_abroad": yes(hit.rlike(r"^(\+|00)")), "f_zero": yes(hit.rlike("^[(]?0")), "f_brackets": yes(hit.rlike(r"[(\[{<]")), "f_spaces": count(" "), "f_hyphens": count("-"), "f_dots": count(r"\."),
        "f_slashes": count("/"), "f_commas": count(","), "f_colons": count(":"), "f_double": yes(F.contains(hit, F.lit("::"))), "f_hex": count("[A-Fa-f]"), "f_sign": yes(F.contains(hit, F.lit("@"))),
        "f_dot_word": yes(hit.rlike(r"(?i)[ \[({<](dot|punkt|punto|point)[ \])}>]")), "f_suffix": yes(hit.rlike(r"(?i)(\.|dot[ \])}>]? ?)[a-z]{2,6}$")), "f_day": yes(hit.rlike(r"^(19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}$|^[0-9]{1,2}[./-][0-9]{1,2}[./-](19|20)?[0-9]{2}$")),
        **{f"f_said_{name}": yes(before.rlike(pattern)) for name, pattern in WORDS.items()}, "f_glued": yes(before.rlike(r"[\p{L}0-9_#$%&*=\"']$")), "f_unit": yes(after.rlike(r"^ ?(%|€|\$|km|kg|px|ms|GB)")),
    }


#: The names of `features`, in order.
NAMES = (
    "f_digits", "f_groups", "f_mean_group", "f_letters", "f_size", "f_check", "f_issuer", "f_fours", "f_abroad", "f_zero", "f_brackets", "f_spaces", "f_hyphens", "f_dots", "f_slashes", "f_commas", "f_colons",
    "f_double", "f_hex", "f_sign", "f_dot_word", "f_suffix", "f_day", *[f"f_said_{name}" for name in WORDS], "f_glued", "f_unit",
)


@dataclass(frozen=True)
class Tree:
    """Two levels of splits: the first, one for each side, and four values."""

    splits: tuple[tuple[int, float], tuple[int, float], tuple[int, float]]
    values: tuple[float, float, float, float]

    def of(self, rows: np.ndarray) -> np.ndarray:
        (a, s), (b, t), (c, u) = self.splits
        low, high = np.where(rows[:, b] <= t, self.values[0], self.values[1]), np.where(rows[:, c] <= u, self.values[2], self.values[3])
        return np.where(rows[:, a] <= s, low, high)

    def sql(self) -> str:
        """The tree as an array: feature and threshold of the three splits, then the values."""
        numbers = [x for split in self.splits for x in split] + list(self.values)
        return "array(" + ", ".join(f"{float(x)!r}D" for x in numbers) + ")"


def _best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The feature and the threshold of the largest gain; the first of equal ones."""
    total, best = g.sum() ** 2 / (h.sum() + PENALTY), (1e-9, 0, float("inf"))
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        values, left, weight = rows[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        cut = values[:-1] < values[1:]
        if cut.any():
            gain = np.where(cut, left**2 / (weight + PENALTY) + (g.sum() - left) ** 2 / (h.sum() - weight + PENALTY) - total, -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), f, float((values[i] + values[i + 1]) / 2))
    return best[1], best[2] if np.isfinite(best[2]) else 1e9


def boosted(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    """Start and trees of a logistic model, by gradient boosting with second-order values."""
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    start = float(np.log(share / (1 - share)))
    margin, made = np.full(len(labels), start), []
    for _ in range(trees if len(labels) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = labels - p, p * (1 - p)
        value = lambda side: RATE * float(g[side].sum() / (h[side].sum() + PENALTY))  # noqa: B023, E731
        f, s = _best_split(rows, g, h)
        left = rows[:, f] <= s
        splits, values = [(f, s)], []
        for side in (left, ~left):
            at, t = _best_split(rows[side], g[side], h[side]) if side.any() else (0, 1e9)
            low = side & (rows[:, at] <= t)
            splits.append((at, t))
            values += [value(low), value(side & ~low)]
        made.append(Tree(tuple(splits), tuple(values)))
        margin = margin + made[-1].of(rows)
    return start, made


def margins(model: tuple[float, list[Tree]], rows: np.ndarray) -> np.ndarray:
    return model[0] + sum((t.of(rows) for t in model[1]), np.zeros(len(rows)))


def sigmoid_fit(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method with a small penalty."""
    w = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-3 * (w - np.array([1.0, 0.0]))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class Model:
    """For each kind: start and trees, slope and offset of calibration, the least probability that is accepted; precision and recall out of fold."""

    trees: dict[str, tuple[float, list[Tree]]]
    curves: dict[str, tuple[float, float]]
    least: dict[str, float]
    out_of_fold: dict[str, tuple[float, float]] = field(default_factory=dict)

    def probability(self, kind: Column) -> Column:
        """Of a row with the columns of `features`.

        Trees are a literal array that `aggregate` walks: as code they would be too long for a method.
        """
        described = F.array(*[F.col(n).cast("double") for n in NAMES])
        at = lambda values, tree, i: F.get(values, F.get(tree, F.lit(i)).cast("int"))
        side = lambda values, tree, i: at(values, tree, i) <= F.get(tree, F.lit(i + 1))
        value = lambda tree, i: F.get(tree, F.lit(6 + i))

        def walked(values: Column, tree: Column) -> Column:
            low = F.when(side(values, tree, 2), value(tree, 0)).otherwise(value(tree, 1))
            return F.when(side(values, tree, 0), low).otherwise(F.when(side(values, tree, 4), value(tree, 2)).otherwise(value(tree, 3)))

        trees = slope = offset = start = None
        for name, (first, made) in self.trees.items():
            own = F.expr("array(" + ", ".join(t.sql() for t in made) + ")") if made else F.array().cast("array<array<double>>")
            pick = lambda value, rest, own_kind=(kind == name): F.when(own_kind, value) if rest is None else rest.when(own_kind, value)
            trees, start, slope, offset = pick(own, trees), pick(first, start), pick(self.curves[name][0], slope), pick(self.curves[name][1], offset)
        margin = F.element_at(F.transform(F.array(described), lambda values: F.aggregate(trees, start, lambda sum_, tree: sum_ + walked(values, tree))), 1)
        return 1 / (1 + F.exp(-(margin * slope + offset)))

    def threshold(self, kind: Column) -> Column:
        found = F.lit(2.0)
        for name, least in self.least.items():
            found = F.when(kind == name, least).otherwise(found)
        return found


def _filled(form: str, r: random.Random) -> str:
    if form.startswith("L"):
        while True:
            number = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(15))
            if sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(number)) % 10 == 0:
                return number if form == "L" else form[1].join(number[i : i + 4] for i in range(0, 16, 4))
    signs = {"#": "0123456789", "*": "123456789", "%": "0123456789abcdef", "~": "abcdefghiklmnoprstuvw"}
    return "".join(r.choice(signs[c]) if c in signs else c for c in form)


@dataclass(frozen=True)
class Example:
    text: str
    kind: str
    start: int
    end: int
    label: int
    fold: int


def examples() -> list[Example]:
    """Every form in every sentence of its kind, of none, and against; all sentences of one wording are in one fold."""
    r, found = random.Random(SEED), []
    for kind, forms in FORMS.items():
        for said in (kind, "none", "against"):
            for i, sentence in enumerate(SENTENCES[said]):
                for form, sure in forms:
                    for _ in range(FILLINGS):
                        value, start = _filled(form, r), sentence.index("{}")
                        label = int(sure == 2 and said != "against" or sure == 1 and said == kind)
                        found.append(Example(sentence.replace("{}", value), kind, start, start + len(value), label, i % FOLDS))
    return found


def fitted(rows: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[tuple[float, list[Tree]], tuple[float, float], float, tuple[float, float]]:
    """The trees of a kind, their curve, the least probability that is accepted, and precision and recall out of fold at it."""
    margin = np.zeros(len(labels))
    for k in range(FOLDS):
        margin[folds == k] = margins(boosted(rows[folds != k], labels[folds != k]), rows[folds == k])
    slope, offset = sigmoid_fit(margin, labels)
    p = 1 / (1 + np.exp(-(margin * slope + offset)))
    order = np.argsort(-p, kind="stable")
    right, ends = np.cumsum(labels[order]), np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = ends & (p[order] >= LEAST) & (right >= PRECISION * np.arange(1, len(p) + 1))
    if not good.any():
        return boosted(rows, labels), (slope, offset), 2.0, (1.0, 0.0)
    last = int(np.flatnonzero(good)[-1])
    below = p[order][last + 1] if last + 1 < len(p) else 0.0
    least = max(LEAST, float(p[order][last] + below) / 2)  # halfway to the next candidate
    return boosted(rows, labels), (slope, offset), least, (float(right[last] / (last + 1)), float(right[last] / labels.sum()))


_models: list[Model] = []


def trained(spark: SparkSession, proposed: Callable[[DataFrame], DataFrame]) -> Model:
    """The model of the table of examples, fitted once a process; it depends on nothing else.

    A candidate is right if it is the value of its sentence, as its kind, and the value is personal data.
    """
    if not _models:
        table = examples()
        texts = spark.createDataFrame([(i, e.text) for i, e in enumerate(table)], "doc_id bigint, text string")
        described = proposed(texts).where("kind is not null and not base").withColumns(features(F.col("hit"), F.col("before"), F.col("after")))
        found = described.select("doc_id", "kind", "start", "end", *[F.col(n).cast("double").alias(n) for n in NAMES]).orderBy("doc_id", "kind", "start", "end", *NAMES).collect()
        parts = {}
        for kind in FORMS:
            own = [(table[f.doc_id], f) for f in found if f.kind == kind]
            labels = np.array([e.label if (e.kind, e.start, e.end) == (kind, f.start, f.end) else 0 for e, f in own], float)
            parts[kind] = fitted(np.array([[f[n] for n in NAMES] for _, f in own], float).reshape(-1, len(NAMES)), labels, np.array([e.fold for e, _ in own]))
        _models.append(Model(*({kind: part[i] for kind, part in parts.items()} for i in range(4))))
    return _models[0]
