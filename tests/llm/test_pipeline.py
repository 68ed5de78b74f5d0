"""The stages of the pipeline on odd rows: null and repeated ids, null and empty texts, clashing names, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import mixing, quality
from colloquy.llm.common import table

from .conftest import prose

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rest string, `key` int, component_id string, taken int, `_copy` int"
STAGES = dict(corpus_pipeline.STAGES)


def rows():
    good, passage = [prose(100 + i, 260) for i in range(8)], prose(7, 60)
    found = [(None, good[0]), (None, good[1]), (3, good[2]), (3, good[2]), (4, good[3]), (4, good[4]), (5, None), (6, ""), (7, good[2] + " end"), (8, f"{good[5]} {passage}"), (9, f"{passage} {good[6]}"), (10, "x " * 4000), (11, "Ünïcödé 漢字 " * 40)]
    return [(i, t, ("en", None, "fr")[k % 3], ("a", None, "b")[k % 3], len(t or ""), f"own {k}", k, "clash", -k, k) for k, (i, t) in enumerate(found)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, name):
    found = STAGES[name](spark, odd_docs, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or found.columns == odd_docs.columns
    given = {r.rest: r for r in odd_docs.collect()}
    # Columns of any name come through as they are, each with its own row; the last stage has columns of its own.
    for r in [] if last else found.collect():
        mine = given[r.rest]
        assert all(r[c] == mine[c] for c in ("doc_id", "lang", "source", "key", "component_id", "taken", "_copy"))
    nothing = STAGES[name](spark, odd_docs.where("false"), SF)
    assert nothing.columns == found.columns and nothing.count() == 0


def kept(found):
    return sorted(r["key"] for r in found.collect())


def test_quality_keeps_what_the_classifier_accepts(spark, odd_docs):
    judged = quality.quality(odd_docs.select("doc_id", "text", F.col("key").alias("k")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long"))), table(spark, SF, "labels"), keep=("k",))
    by_text = {r["key"]: r.text or "" for r in odd_docs.collect()}
    good = {by_text[r.k] for r in judged.where("predicted = 1").collect()}
    found = kept(STAGES["quality"](spark, odd_docs, SF))
    assert found == sorted(k for k, t in by_text.items() if t in good)


def test_one_of_each_group_stays(spark, odd_docs):
    found = kept(STAGES["near_duplicates"](spark, odd_docs, SF))
    # 2 and 3 are equal rows, 8 is a near copy of them with a greater id.
    assert len({2, 3} & set(found)) == 1 and 8 not in found
    assert set(found) - {2, 3} == set(range(13)) - {2, 3, 8}


def test_passages_go_from_the_later_document(spark, odd_docs):
    found = {r["key"]: r for r in STAGES["repeats"](spark, odd_docs, SF).collect()}
    given = {r["key"]: r for r in odd_docs.collect()}
    assert len(found) == len(given) and found[6].text == "" and found[7].text == ""
    assert found[9].text == given[9].text and prose(7, 60)[:90] not in found[10].text and prose(106, 260)[-200:] in found[10].text
    assert found[2].text == found[3].text and all(r.n_chars == len(r.text) for r in found.values())
    # Ids come before null ids, so a null id's text gives way to no smaller one here.
    assert found[0].text == given[0].text and len(found[11].text) < 200


def test_copies_are_those_of_the_mix(spark, odd_docs):
    taken = {r["key"]: (r["size"], r["taken"]) for r in mixing.mix(odd_docs.drop("taken")).collect()}
    wanted = sorted(k for k, (size, t) in taken.items() if size for _ in range((2 * t + size) // (2 * size)))
    assert kept(STAGES["mixing"](spark, odd_docs, SF)) == wanted and wanted


def test_pieces_decode_to_the_text(spark, odd_docs):
    given = {(r.doc_id, r.text) for r in odd_docs.collect()}
    found = STAGES["pieces"](spark, odd_docs, SF).collect()
    assert {(r.doc_id, r.text) for r in found} == given and len(found) == 13
    assert all((r.token_ids is None) == (r.text is None) for r in found)


def test_each_task_of_pieces_holds_one_worker(spark, odd_docs, capsys):
    STAGES["pieces"](spark, odd_docs, SF).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_batches_are_bounded_by_bytes(spark, odd_docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    table(spark, SF, "documents")
    assert spark.conf.get(name) == "4m"
    spark.conf.set(name, "1m")
    table(spark, SF, "documents")
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
