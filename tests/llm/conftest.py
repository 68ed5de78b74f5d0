from __future__ import annotations

import random

import pytest

SYLLABLES = "the an ti er on re st ou ha en is of to and in ble sh ly ed wh".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(SYLLABLES) * 2
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Texts by id: null, empty, short, long, copies, near copies, shared passages, repeats, other scripts."""
    base, passage = prose(1, 300), prose(2, 60)
    found = [None, "", " \n\t ", "one", "one two three", "ONE two  three", base, base, edited(base, 3, 4), edited(base, 4, 30), base.upper()]
    found += [f"{prose(10 + i, 40)} {passage} {prose(20 + i, 30)}" for i in range(4)]
    found += ["ab" * 400, "x " * 500, "Ünïcödé ▁ 漢字 😀\r\n\x00 tail" * 5, prose(30, 5000), base[:150], "a" * 99, "a" * 100, "a" * 101]
    found += [edited(base, 40 + i, 2) for i in range(8)]
    return dict(enumerate(found))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t or ""), "clash", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rest string, size int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
