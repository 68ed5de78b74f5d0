"""Collection runs into an archive, its index, and its streaming export."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from colloquy.model import CONVERSATION
from colloquy.operators.readiness import acceptance_findings, finding_entries, merged_policy
from colloquy.operators.runs import run_sources
from colloquy.operators.verify import declared_and_actual
from colloquy.sources.archive import read_archive, read_runs, write_archive
from colloquy.sources.batch import collect_batch
from colloquy.sources.collectors import provider_candidates, provider_class
from colloquy.sources.index import ensure_index, index_status, read_index, refresh_index
from colloquy.streaming.incremental import archive_stream, export_memory_stream


def session(path, *texts, secret=""):
    said = [{"type": "response_item", "payload": {"type": "message", "role": "user" if i % 2 == 0 else "assistant", "content": t + secret}} for i, t in enumerate(texts)]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(x) for x in [{"type": "session_meta", "payload": {"id": path.stem[-1]}}, *said]))


def test_runs_merge_into_the_archive(spark, tmp_path):
    root, home = str(tmp_path / "an archive"), tmp_path / "home"
    session(home / "sessions/rollout-a.jsonl", "one")
    session(home / "sessions/rollout-b.jsonl", "two", secret=" api_key=hunter2hunter2hunter2")
    (tmp_path / "blobs/conversations").mkdir(parents=True)
    (tmp_path / "broken/tmp/p/chats").mkdir(parents=True)
    inputs = {"codex_cli": str(home), "claude": str(tmp_path / "none"), "gemini": str(tmp_path / "broken")}
    (tmp_path / "broken/tmp/p/chats/session-1.json").write_text("{}")
    first = {r.source: r for r in run_sources(collect_batch(spark, root, inputs, sources=["codex_cli", "claude"], now="2024-01-01T00:00:00Z")).collect()}
    assert (first["codex_cli"].status, first["codex_cli"].written_conversation_count, first["codex_cli"].scanned_artifact_count) == ("complete", 2, 2)
    assert first["codex_cli"].redaction_event_count >= 1
    assert (first["claude"].status, first["claude"].written_conversation_count, first["claude"].failed) == ("complete", 0, False)
    assert "hunter2" not in "".join(m.text for r in read_archive(spark, root).collect() for m in r.messages)
    session(home / "sessions/rollout-a.jsonl", "one", "and an answer")
    second = run_sources(collect_batch(spark, root, inputs, sources=["codex_cli"], now="2024-01-02T00:00:00Z")).first()
    assert (second.written_conversation_count, second.upgraded_conversation_count, second.skipped_conversation_count) == (1, 1, 1)
    rows = {(r.source_session_id, len(r.messages)): r.superseded_at for r in read_archive(spark, root, include_superseded=True).collect()}
    assert rows == {("a", 1): "2024-01-02T00:00:00Z", ("a", 2): None, ("b", 1): None}
    assert sorted(r.run_id for r in read_runs(spark, root).collect()) == ["20240101T000000Z", "20240102T000000Z"]
    blocked = acceptance_findings(run_sources(read_runs(spark, root))).collect()
    assert {(r.run_id, r.source, r.code) for r in blocked} == {("20240101T000000Z", "claude", "source_missing_artifacts"), ("20240101T000000Z", "claude", "source_no_written_conversations")}
    with pytest.raises(OSError):
        collect_batch(spark, root, {}, sources=["claude"], now="2024-01-02T00:00:00Z")


def test_a_failing_source_does_not_stop_a_run(spark, tmp_path, monkeypatch):
    from colloquy.sources import collectors

    def broken(spark, root):
        raise ValueError("no such store")

    monkeypatch.setitem(collectors.SOURCES, "claude", collectors.Source("claude", "cli", "complete", broken, ("*.txt",)))
    (tmp_path / "x.txt").write_text("x")
    session(tmp_path / "sessions/rollout-a.jsonl", "one")
    run = {r.source: r for r in run_sources(collect_batch(spark, str(tmp_path / "archive"), {"claude": str(tmp_path), "codex_cli": str(tmp_path)}, sources=["claude", "codex_cli"])).collect()}
    assert (run["claude"].status, run["claude"].failure_reason) == ("failed", "ValueError: no such store")
    assert run["codex_cli"].status == "complete"


def rows(spark, *sessions):
    some = spark.createDataFrame([(s, "cli", "2024-01-01T00:00:00Z", i) for s, i in sessions], "source string, execution_context string, collected_at string, source_session_id string")
    missing = [F.lit(None).alias(f.name).cast(f.dataType) for f in spark.createDataFrame([], CONVERSATION).schema if f.name not in some.columns]
    said = F.expr("array(named_struct('role', 'user', 'text', source_session_id))")
    kind = next(f.dataType for f in spark.createDataFrame([], CONVERSATION).schema if f.name == "messages")
    return some.select("*", *missing).withColumn("messages", F.from_json(F.to_json(said), kind))


def test_index_follows_the_files(spark, tmp_path):
    tmp_path = tmp_path / "an archive"
    root = str(tmp_path)
    write_archive(rows(spark, ("s", "a"), ("t", "b")), root)
    assert index_status(spark, root).state == "missing"
    assert ensure_index(spark, root).conversation_count == 2
    write_archive(rows(spark, ("s", "c")), root)
    stale = index_status(spark, root)
    assert (stale.state, stale.added_file_count, stale.updated_file_count, stale.removed_file_count, stale.conversation_count) == ("stale", 1, 0, 0, 2)
    refresh_index(spark, root)
    assert sorted(r.source_session_id for r in read_index(spark, root).collect()) == ["a", "b", "c"]
    changed = next(f for f in (tmp_path / "t").glob("*.txt"))
    time.sleep(1)
    changed.write_text(changed.read_text().replace('"b"', '"bb"'))
    for crc in (tmp_path / "t").glob(".*.crc"):
        crc.unlink()
    next((tmp_path / "s").glob("*.txt")).unlink()
    status = index_status(spark, root)
    assert (status.updated_file_count, status.removed_file_count) == (1, 1)
    assert ensure_index(spark, root).ready
    found = [r.source_session_id for r in read_index(spark, root).collect()]
    assert len(found) == 2 and "bb" in found and "b" not in found
    (tmp_path / "archive-index/files").rename(tmp_path / "archive-index/lost")
    assert index_status(spark, root).state == "rebuild_required"
    assert ensure_index(spark, root).conversation_count == 2


def test_rows_are_exported_once(spark, tmp_path):
    root = str(tmp_path / "archive")
    write_archive(rows(spark, ("s", "a"), ("s", "b")), root)
    for _ in range(2):
        export_memory_stream(archive_stream(spark, root), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    write_archive(rows(spark, ("s", "c")), root)
    export_memory_stream(archive_stream(spark, root), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_providers(spark):
    sessions = ['{"responderUsername":"GitHub Copilot","metadata":{"extensionId":"Google.GeminiCodeAssist"}}', '{"provider":"Claude"}', '{"provider":7,"providerId":"acme"}', "{}", "[]"]
    found = spark.createDataFrame([(s,) for s in sessions], "s string").select(provider_class(provider_candidates(F.parse_json("s"))).alias("c")).collect()
    assert [(r.c.provider, r.c.candidate) for r in found] == [("gemini", "Google.GeminiCodeAssist"), ("foreign", "Claude"), ("unknown", "acme"), ("unknown", None), ("unknown", None)]


def test_entries_are_added_once(spark):
    found = spark.createDataFrame([("s", "warning", "x"), ("s", "warning", "x"), ("s", "error", "y"), (None, "warning", "x"), ("s", "warning", "drift_suspected")], "source string, level string, code string")
    entries = finding_entries(found, "verify")
    assert [(r.source, r.code) for r in entries.collect()] == [("s", "x")]
    empty = spark.createDataFrame([], "id string, kind string, source string, report string, code string, limitation string")
    once = merged_policy(empty, entries)
    assert [r.added for r in once.collect()] == [True]
    assert [r.added for r in merged_policy(once.drop("added"), entries).collect()] == [False]


def test_manifest_against_rows(spark):
    kinds = "run_id string, source string, output_path string, written_conversation_count int, status string, failed boolean, unsupported boolean, partial boolean, scanned_artifact_count int, conversation_count int"
    declared = spark.createDataFrame([("r", "s", "p", 1, "complete", None, None, None, 1, 1), ("r", "t", None, 0, "complete", None, None, None, 2, 0)], kinds)
    held = rows(spark, ("s", "a"), ("s", "b")).withColumn("output_path", F.lit("p"))
    assert {(r.source, r.code) for r in declared_and_actual(declared, held).collect()} == {("s", "conversation_count_mismatch"), ("t", "drift_suspected")}
