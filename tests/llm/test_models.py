"""Classifiers: held-out accuracy on the small tables, and defined results for odd rows."""

from __future__ import annotations

import re

import numpy as np
import pytest

from colloquy.llm import langid, quality, toxicity
from colloquy.llm.common import utf8
from colloquy.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "fold", "least"), [("op1_toxicity", "toxic", 4, 0.9), ("op10_quality", "quality", 5, 0.9)])
def test_held_out_accuracy(spark, name, label, fold, least):
    found = queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found["predicted"] == found[label]).mean() >= least
    assert found["score"].between(0, 1).all()


def test_languages_of_held_out_documents(spark):
    found = queries()["op6_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97


def test_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(6, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (lambda d, y: quality.quality(d, y), lambda d, y: toxicity.toxicity(d, y)):
            rows = f(docs, labels).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
            assert f(empty, labels).count() == 0
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(langid.training_rows(docs))).collect()}
    assert found[0] == found[1] == found[2] == "und" and found[6] in ("en", "fr")
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}


def test_trigram_vectors_bind_and_bundle():
    letters = langid.letter_vectors().astype(int)
    one = langid.trigram_vectors(np.array([(5 * langid.LETTERS + 6) * langid.LETTERS + 7]))[0]
    assert np.array_equal(one, np.roll(letters[5], 2) * np.roll(letters[6], 1) * letters[7])
    import pyarrow as pa

    rows, grams, counts = langid.trigrams(*utf8(pa.array([" abab ", " a "])))
    assert counts[rows == 0].sum() == 4 and counts[rows == 1].sum() == 1


@pytest.mark.parametrize(("worse", "better"), [
    ("you are an idiot", "you are not an idiot"), ("you idiot", "he said you idiot"), ("you moron are here", "one two three four moron"),
    ("I will kill you", "I will kill time"), ("idiot", "house"), ("you are an idiot", "you are\nan idiot"),
])
def test_grammar_scores_clauses_in_context(worse, better):
    import pyarrow as pa

    total, _ = toxicity.Lexicon().features(*utf8(pa.array([worse, better])))
    assert total[0] > total[1]


def test_isotonic_fit():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


def strings(n, seed):
    r = np.random.default_rng(seed)
    return r.integers(0, toxicity.CLASSES, (n, 12))


def read(machine, symbols):
    """What a transducer writes, and the factors and bonuses of its arcs."""
    state, out, weights = 0, [], []
    for x in symbols:
        out.append(int(machine.output[state, x]))
        weights.append((machine.factor[state, x], machine.bonus[state, x]))
        state = machine.following[state, x]
    return out, np.array(weights)


def test_composed_transducers_equal_one_after_the_other():
    machines = (*toxicity.PARTS, toxicity.composed(toxicity.PARTS[0], toxicity.PARTS[2]))
    for a in machines:
        for b in machines:
            both = toxicity.composed(a, b)
            for symbols in strings(20, 3):
                middle, first = read(a, symbols)
                out, second = read(b, middle)
                assert read(both, symbols)[0] == out and np.allclose(read(both, symbols)[1], first + second)


def plain_score(classes, weights):
    """The grammar's rules for one clause, word by word."""
    total, said, negated, target, insult, waits, most = 0.0, 1.0, False, 99, 99, False, 0.0
    for c, w in zip(classes, weights, strict=True):
        near = target <= toxicity.NEAR
        if c == toxicity.INSULT:
            total += w * said * (0.1 if negated else 1.25 if near else 1.0)
        if c == toxicity.THREAT:
            total += w * said * (0.1 if negated else 1.0 if near else 0.25)
        if c == toxicity.TARGET:
            total += most * said * ((0.25 if insult <= toxicity.NEAR else 0) + (0.75 if waits else 0))
        negated = c == toxicity.NEGATION or (negated and c == toxicity.ARTICLE)
        said = 0.4 if c == toxicity.REPORT else said
        target, insult = (1 if c == toxicity.TARGET else target + 1), (1 if c == toxicity.INSULT else insult + 1)
        waits = c != toxicity.TARGET and (waits or c == toxicity.THREAT)
        most = max(most, w)
    return total


def test_texts_score_as_by_plain_rules():
    import random
    import re

    import pyarrow as pa

    r, kinds = random.Random(9), {}
    for kind, terms in ((toxicity.ARTICLE, toxicity.ARTICLES), (toxicity.REPORT, toxicity.REPORTS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.THREAT, toxicity.THREATS), (toxicity.INSULT, toxicity.INSULTS)):
        kinds |= dict.fromkeys(terms, kind)
    words = [*kinds, *["some", "other", "word"] * 30]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", "", ".", ";", "\n", ","]) for _ in range(r.randint(0, 300))) for _ in range(120)] + ["idiot " * 3000, None, ""]
    total, most = toxicity.Lexicon().features(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        scores = []
        for clause in re.split(r"[.!?;:\n]", text or ""):
            own = [kinds.get(w, toxicity.OTHER) for w in re.findall(r"[^\W_]+", clause)]
            scores.append(plain_score(own, [4.0 if c in (toxicity.INSULT, toxicity.THREAT) else 0.0 for c in own]))
        assert total[k] == pytest.approx(np.log1p(sum(scores))) and most[k] == pytest.approx(max(scores))


def test_a_learnt_word_keeps_its_class():
    threat, target, new = (int(toxicity.hashed([w])[0]) for w in ("kill", "you", "blorp"))
    lexicon = toxicity.Lexicon({threat: 7.0, target: 9.0, new: 5.0})
    found = {int(h): (int(c), float(w)) for h, c, w in zip(lexicon.hashes, lexicon.classes, lexicon.weights, strict=True)}
    assert found[threat] == (toxicity.THREAT, 7.0) and found[target][0] == toxicity.TARGET and found[new] == (toxicity.INSULT, 5.0)


def test_null_and_repeated_ids_and_clashing_names(spark, texts):
    made = "label half calibrate id score total most stop digit"
    rows = [(None, texts[6]), (None, None), (4, texts[4]), (4, texts[4]), (8, texts[8]), (8, texts[9]), (9, ""), (21, texts[18])]
    docs = spark.createDataFrame([(i, t, ("en", "fr")[k % 2], *made.split()) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in made.split())).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(8, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.quality(docs, labels).collect(), toxicity.toxicity(docs, labels).collect()):
        assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 4}) == 1
    langs = langid.identify(docs, langid.learn(langid.training_rows(docs))).collect()
    assert len(langs) == len(rows) and {r.lang_pred for r in langs if r.doc_id == 9} == {"und"}


def test_more_trigrams_than_are_remembered(monkeypatch):
    import pyarrow as pa

    column = pa.array([" ".join(chr(97 + (i * i + j) % 26) * (1 + i % 3) for i in range(400)) for j in range(3)])
    whole = langid.Profiles().bundle(3, *langid.trigrams(*utf8(column)))
    monkeypatch.setattr(langid, "VECTORS", 7)
    assert np.allclose(langid.Profiles().bundle(3, *langid.trigrams(*utf8(column))), whole)


def test_quality_equals_a_plain_fit(spark, texts):
    """Scores of the whole pipeline against normal equations and pooling over all rows at once."""
    names = quality.STATISTICS
    r = np.random.default_rng(2)
    x = r.normal(size=(600, len(names)))
    y = (x[:, 0] + 0.3 * r.normal(size=600) > 0).astype(float)
    rows = spark.createDataFrame([(i, float(y[i]), i % 5 == 1, *map(float, x[i])) for i in range(600)], "doc_id long, label double, calibrate boolean, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    model = quality.fit(rows, "label", "calibrate")
    held = np.arange(600) % 5 == 1
    plain = quality.Model(x.mean(axis=0), x.std(axis=0))
    z = plain.features(x[~held])
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * (~held).sum() * np.eye(z.shape[1]), z.T @ y[~held])
    assert np.allclose(model.raw(x), plain.features(x) @ weights, atol=1e-3)
    assert (np.diff(model.values) >= 0).all()
    place = np.clip((model.raw(x[held]) + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(place)
    assert np.allclose(model.values, quality.isotonic(np.array([y[held][place == b].mean() for b in bins]), np.array([(place == b).sum() for b in bins])))


def plain_vector(text):
    """The bundle of a text's trigrams, one by one."""
    letters, out = langid.letter_vectors().astype(float), np.zeros(langid.DIMENSIONS)
    codes = []
    for c in f" {text} ":
        code = 1 + ord(c.lower()[0]) % (langid.LETTERS - 1) if c.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if a or b or c:
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out / max(np.linalg.norm(out), 1e-9)


def test_languages_equal_plain_prototypes_and_cosines(spark):
    known = [("the cat and the dog", "en"), ("this is the end of that", "en"), ("le chat et le chien", "fr"), ("une fin, c'est \u00e7a!", "fr"), ("der Hund und die Katze", "de"), ("123 --", "de"), (None, "fr")]
    texts = ["the dog", "le chien", "die Katze", "\u6f22\u5b57 x", "A", "a" * 3000 + " the end", " ...", "", None]
    names, prototypes = langid.learn(spark.createDataFrame(known, "text string, lang string").repartition(3))
    wanted = {}
    for lang in ("de", "en", "fr"):
        total = sum(plain_vector(t) for t, x in known if x == lang and t and any(c.isalpha() for c in t))
        wanted[lang] = total / np.linalg.norm(total)
    assert names == ["de", "en", "fr"] and np.allclose(prototypes, np.array([wanted[x] for x in names]), atol=1e-5)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(rows, (names, prototypes)).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = np.array([plain_vector(text) @ wanted[x] for x in names])
        assert r.lang_pred == names[int(cosines.argmax())]
        assert r.score == pytest.approx(1 / np.exp(langid.SHARPNESS * (cosines - cosines.max())).sum(), abs=1e-4)


def plain_statistics(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(len(raw), 1)
    symbols = b"!\"#$%&()*+/<=>@[\\]^_`{|}~"
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(len(sizes), 1)
    spread = np.sqrt(max(0.0, sum(x * x for x in sizes) / max(len(sizes), 1) - mean**2))
    found = [np.log1p(len(raw)), share(range(65, 91)), share(b"0123456789"), share(b" \t"), share(b".,;:?'-"), share(symbols), share(range(128, 256)), np.log1p(len(words)), np.log1p(mean), np.log1p(spread)]
    grams = {tuple(low[i : i + 3]) for i in range(max(1, len(low) - 2))} if low else set()
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in line))) for line in raw.split(b"\n")]
    lines = [line for line in lines if line]
    most = max((low.count(w) for w in set(low)), default=0)
    same = np.mean([a == b for a, b in zip(low, low[1:], strict=False)]) if len(low) > 1 else 0
    found += [len(set(low)) / max(len(low), 1), len(grams) / max(len(words) - 2, 1), np.log1p(len(low) / len(lines)) if lines else 0, len(set(lines)) / len(lines) if lines else 0]
    return [*found, sum(w[-1] in symbols for w in words) / max(len(words), 1), most / max(len(low), 1), same]


def test_statistics_equal_plain_counts(texts):
    import pyarrow as pa

    own = [t or "" for t in texts.values()] + ["A a A\nb\n\nA a a\n", "x#y z# #", "\n\n", "one two\nONE two\none  two\tthree"]
    found = quality.measure(*utf8(pa.array(own)))
    for text, row in zip(own, found, strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(text), abs=1e-9), text[:60]
