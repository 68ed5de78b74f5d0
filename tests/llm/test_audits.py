"""The manifest, the filter audit and personal data, against plain code."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import audit, merkle, pii, pii_model

from .conftest import prose

ROW = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text), by the definition."""
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(said, r)))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t)

    def levels(nodes: list[str]) -> list[list[str]]:
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
        return found

    def above(found: list[list[str]], at: int) -> list[tuple[str, str]]:
        path = []
        for level in found[:-1]:
            start = at // 16 * 16
            path.append(("".join(level[start:at]), "".join(level[at + 1 : start + 16])))
            at //= 16
        return path

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    result = []
    for place, s in enumerate(sources):
        for at, r in enumerate(own[s]):
            path = above(trees[s], at) + above(top, place)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for before, after in path:
                node = sha(before + node + after)
            result.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), node, node == top[-1][0]))
    return result


def manifest_rows() -> list[tuple]:
    r = random.Random(5)
    rows = [(i, "hot", r.choice(("en", None)), i, f"Text {i} É{'A' * (i % 3)}") for i in range(300)]
    rows += [(1000 + i, f"s{i:02d}", "de", None, None if i % 3 else "") for i in range(40)]
    rows += [(None, "hot", "en", 1, "X"), (None, "hot", "en", 1, "X"), (7, "hot", "en", 7, "again"), (5, None, None, None, None), (6, "", "x", -3, "é A"), (2000, "é", "x", 3, "a" * 200_000 + "Z")]
    return rows


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_is_the_defined_tree(spark, depth):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, 0, "clash") for r in rows], ROW).repartition(5)
    found = merkle.manifest(docs, depth).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(4, "a", None, None, "B", 0, "")], ROW)
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.manifest(docs.where("false")).collect() == []


AUDITED = "doc_id long, lang string, text string, mask int, n int"


def plain_mask(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


def plain_audit(rows: list[tuple], labels: dict) -> dict:
    steps = {}
    masks = []
    for i, lang, text in rows:
        copy = any(t == text and j is not None and (i is None or j < i) for j, _, t in [(a, b, c or "") for a, b, c in rows] if t == (text or ""))
        masks.append((lang or "", plain_mask(text or "") + 16 * copy, labels.get(i, (0, 0))))
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone, stay = [m for m in left if m[1] & bit], [m for m in left if not m[1] & bit]
                redundant = sum(1 for m in own if m[1] & bit) - len(gone)
                steps[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(m[1] == bit for m in own), sum(m[2][0] for m in gone), sum(m[2][1] for m in gone), c]
                shapley[c] += len(gone)
                left = stay
        for (p, o, s), values in steps.items():
            if p == part:
                values[-1] = shapley[values[-1]]
    return {k: tuple(v) for k, v in steps.items()}


def test_audit_counts_each_order_step_by_step(spark):
    good = prose(9, 400)
    texts = [None, "", good, good, prose(3, 250) + " ABC" * 60, prose(4, 260) + " #", "x " * 500, prose(6, 210), "A" * 50, good + " |", "é\x00 ü" * 300]
    rows = [(i, ("en", None, "", "fr")[i % 4], t) for i, t in enumerate(texts * 3)]
    rows += [(None, "en", good), (None, "en", good), (2, "en", good), (500, "de", good)]
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 30, 2)}
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], AUDITED).repartition(3)
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, marks).collect()}
    fixed = [(i, lang, t or "") for i, lang, t in rows]
    assert found == plain_audit(fixed, labels)
    assert len(found) == 600 * 4


def test_audit_of_nothing(spark):
    docs, marks = spark.createDataFrame([], AUDITED), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, marks).collect() == []


def test_words_of_a_long_text_are_counted_by_pieces():
    text = (prose(1, 3000) + "\x0b" + "y" * 5000 + " " + prose(1, 3000)).encode()
    for piece in (1, 7, 1000, 1 << 20):
        assert audit.word_counts(text, piece) == (len(text.split()), len(set(text.split())))


LITERAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            check = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            tests = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and check, "phone": 9 <= len(digits) <= 15}
            if tests[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def personal_texts() -> list[str | None]:
    r, card = random.Random(3), "4111111111111111"
    texts = [None, "", "a@b.c_d@e.f.", "x..y@z-1.w-.q ü@é.com", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 007.08.9.255", f"{card} {card}", f"no {card[:4]}-{card[4:8]} {card[8:]} é +49 (30) 123-4567.", "+1 +1 2 +123456789 +1234567890123456"]
    texts += ["漢😀 +49 30 1234567 😀 q@w.ee " + card, "9" * 3000, "1.1.1.1 " * 300, "a" * 20000 + "@", "1 " * 300, "+" + "1 " * 200 + "x", "a@b.c" * 50]
    texts += ["".join(r.choice("aé1 2.3@+-()4,x:[]") for _ in range(200)) for _ in range(300)]
    texts += ["".join(r.choice("0123456789 .-+") for _ in range(80)) for _ in range(300)]
    return texts


@pytest.fixture(scope="module")
def personal(spark):
    texts = personal_texts()
    docs = spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key int, kind string").repartition(3)
    return texts, {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}


def test_base_spans_are_those_of_the_patterns(personal):
    texts, found = personal
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.base] == plain_base(text or ""), text


def test_added_spans_overlap_no_other(personal):
    texts, found = personal
    for i in range(len(texts)):
        spans = [(s.start, s.end, s.base) for s in found[i]]
        for a in spans:
            assert all(a is b or a[2] and b[2] or a[1] <= b[0] or b[1] <= a[0] for b in spans)


def test_candidates_are_judged_by_form_and_context(spark):
    texts = ["write to jane (at) example (dot) com", "meet at home. Then", "call me on (030) 555-1234 now", "order (030) 555-1234 was sent", "on 2001-05-17 it rained", "at 12:30:45", "host fe80::1ff:fe23:4567:890a up", "card 4111111111111111 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert found[0] == [("email", "jane (at) example (dot) com")] and found[2] == [("phone", "(030) 555-1234")]
    assert found[1] == found[3] == found[4] == found[5] == [] and found[6] == [("ip", "fe80::1ff:fe23:4567:890a")]
    assert found[7] == [("card", "4111111111111111")] * 2
    hidden = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert hidden[0] == "write to [EMAIL]" and hidden[7] == "card [CARD] [CARD]" and hidden[3] == texts[3]


def test_trees_give_the_same_in_spark(spark):
    model = pii_model.trained(spark, pii.proposed)
    docs = spark.createDataFrame([(i, e.text) for i, e in enumerate(pii_model.examples()[::7])], "doc_id long, text string")
    rows = pii.proposed(docs).where("not base").withColumns(pii_model.features(F.col("hit"), F.col("before"), F.col("after")))
    assert tuple(pii_model.features(F.col("hit"), F.col("hit"), F.col("hit"))) == pii_model.NAMES
    for r in rows.withColumn("p", model.probability(F.col("kind"))).collect():
        slope, offset = model.curves[r.kind]
        margin = pii_model.margins(model.trees[r.kind], np.array([[float(r[n]) for n in pii_model.NAMES]]))[0]
        assert r.p == pytest.approx(1 / (1 + np.exp(-(margin * slope + offset))), rel=1e-6)
    assert all(precision >= pii_model.PRECISION and recall > 0.8 for precision, recall in model.out_of_fold.values())


def test_personal_data_of_nothing_and_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc"), (1, None), (1, "x"), (1, "y@z.de")], "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii.personal_data(docs).collect()) == [0, 0, 1, 1, 1]
    assert pii.personal_data(docs.where("false")).collect() == []
