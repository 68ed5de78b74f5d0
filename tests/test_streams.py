"""A stream that is merged into an archive, and batches that come twice."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import identity
from colloquy.sources import batch as B
from colloquy.sources.archive import read_archive
from colloquy.streaming import incremental as I


def row(session, *texts, source="alpha"):
    return json.dumps({"source": source, "execution_context": "cli", "collected_at": "2024-01-01T00:00:00Z", "contract": {"schema_version": "2026-03-19"}, "source_session_id": session, "messages": [{"role": "user", "text": t} for t in texts]})


def held(spark, root, every=False):
    rows = read_archive(spark, root, include_superseded=every).collect()
    return sorted(((r.source, r.source_session_id, len(r.messages), r.superseded_at is not None) for r in rows), key=str)


def test_a_stream_is_merged_by_batches(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    (source / "alpha").mkdir(parents=True)
    (source / "alpha" / "1.jsonl").write_text(row("s1", "a") + "\n" + row("s2", "a", source="beta") + "\n")
    run = lambda: I.merge_stream(I.archive_stream(spark, str(source)), root, checkpoint).awaitTermination()
    run()
    assert held(spark, root) == [("alpha", "s1", 1, False), ("beta", "s2", 1, False)]
    (source / "alpha" / "2.jsonl").write_text(row("s1", "a", "b") + "\n" + row("s2", "a", source="beta") + "\n")
    run()
    run()
    assert held(spark, root) == [("alpha", "s1", 2, False), ("beta", "s2", 1, False)]
    assert held(spark, root, every=True) == [("alpha", "s1", 1, True), ("alpha", "s1", 2, False), ("beta", "s2", 1, False)]
    ledger = sorted(p.name for p in (tmp_path / "archive" / "runs" / "stream-merge").glob("*.json"))
    assert ledger == ["batch-0.json", "batch-1.json"]
    counts = json.loads((tmp_path / "archive" / "runs" / "stream-merge" / "batch-1.json").read_text())["sources"]
    assert (counts["alpha"]["upgraded_conversation_count"], counts["beta"]["skipped_conversation_count"]) == (1, 1)


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "archive")
    (tmp_path / "in" / "alpha").mkdir(parents=True)
    (tmp_path / "in" / "alpha" / "1.jsonl").write_text("\n".join([row("s1", "a"), row(None, "x"), row("s2", "b", source="beta")]) + "\n")
    rows = read_archive(spark, str(tmp_path / "in")).drop("line")
    assert I.merge_batch(rows, 0, root, "m", "2024-02-01T00:00:00Z")
    before = held(spark, root, every=True)
    assert not I.merge_batch(rows, 0, root, "m", "2024-02-02T00:00:00Z") and held(spark, root, every=True) == before
    # A break after the rows and before the ledger: the batch comes once more.
    (tmp_path / "archive" / "runs" / "stream-m" / "batch-0.json").unlink()
    assert I.merge_batch(rows, 0, root, "m", "2024-02-02T00:00:00Z") and held(spark, root, every=True) == before
    # A break between two sources.
    broken, done = str(tmp_path / "broken"), []

    def once(spark, root, source, incoming, moment):
        if done:
            raise OSError("break")
        done.append(source)
        return B.write_incremental(spark, root, source, incoming, moment)

    monkeypatch.setattr(I, "write_incremental", once)
    with pytest.raises(OSError, match="break"):
        I.merge_batch(rows, 0, broken, "m", "2024-02-01T00:00:00Z")
    monkeypatch.setattr(I, "write_incremental", B.write_incremental)
    assert I.merge_batch(rows, 0, broken, "m", "2024-02-01T00:00:00Z") and held(spark, broken, every=True) == before


def test_sources_are_merged_in_the_same_jobs(spark, tmp_path, monkeypatch):
    root, found, calls = tmp_path / "archive", identity.components, []
    for source, lines in (("alpha", [row("s1", "a"), "no json", row("s3", "z")]), ("beta", [row("s2", "b", source="beta")])):
        (root / source).mkdir(parents=True)
        (root / source / "1.jsonl").write_text("".join(f"{x}\n" for x in lines))
    (tmp_path / "in" / "mixed").mkdir(parents=True)
    (tmp_path / "in" / "mixed" / "1.jsonl").write_text("\n".join([row("s1", "a", "b"), row("s2", "b", source="beta"), row("s9", "n", source="beta"), row("s1", "c", source="gamma")]) + "\n")
    monkeypatch.setattr(identity, "components", lambda edges: calls.append(1) or found(edges))
    counts = B.write_incremental_sources(spark, str(root), read_archive(spark, str(tmp_path / "in")).drop("line"), "2024-02-01T00:00:00Z")
    assert len(calls) == 1
    assert {s: tuple(n.values()) for s, n in counts.items()} == {"alpha": (1, 2, 1, 1, 0), "beta": (2, 2, 1, 0, 1), "gamma": (1, 1, 1, 0, 0)}
    rows = read_archive(spark, str(root), strict=False, include_superseded=True).collect()
    assert sorted((r.source, r.source_session_id, len(r.messages), r.superseded_at) for r in rows if r.superseded_at) == [("alpha", "s1", 1, "2024-02-01T00:00:00Z")]
    assert sorted((r.source, r.source_session_id, len(r.messages)) for r in rows if not r.superseded_at) == [("alpha", "s1", 2), ("alpha", "s3", 1), ("beta", "s2", 1), ("beta", "s9", 1), ("gamma", "s1", 1)]
    kept = [x for p in sorted((root / "alpha").glob("part-*")) for x in p.read_text().splitlines() if x in ("no json", row("s3", "z"))]
    assert kept == ["no json", row("s3", "z")]  # in their order, as they were
    assert (root / "beta" / "1.jsonl").exists() and not (root / "alpha" / "1.jsonl").exists()


def test_a_merge_reads_each_row_once(spark, tmp_path):
    (tmp_path / "alpha").mkdir()
    (tmp_path / "alpha" / "1.jsonl").write_text("".join(f"{x}\n" for x in (row("s1", "a"), row(None, "x"), row("s1", "a", "b"), row(None, "x"), row(None, "y"))))
    read, compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    counted = F.udf(lambda text: read.add(1) or text, "string").asNondeterministic()
    printed = F.udf(lambda messages: compared.add(int(messages is not None)) or str(messages), "string").asNondeterministic()
    rows = read_archive(spark, str(tmp_path)).withColumn("collected_at", counted("collected_at"))
    decided = identity.incremental_merge(rows.where("row_number <= 2"), rows.where("row_number > 2"), printed("messages"))
    assert sorted((r.row_number, r.decision) for r in decided.collect()) == [(1, "supersede"), (2, "keep"), (3, "upgrade"), (4, "skip"), (5, "insert")]
    assert (read.value, compared.value) == (10, 3)  # the rows are read for either half, and those without identity compared
