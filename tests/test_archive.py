from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import archive as A
from colloquy.operators import identity as I
from colloquy.operators import runs as R
from colloquy.operators import verify as V
from colloquy.operators.graph import components
from colloquy.sources.archive import parsed, read_archive, read_lines, write_archive


def line(**fields):
    row = {"source": "alpha", "execution_context": "cli", "collected_at": "2024-01-01T00:00:00Z", "contract": {"schema_version": "2026-03-19"}, "messages": [{"role": "user", "text": "Hello"}]}
    return json.dumps({k: v for k, v in (row | fields).items() if v is not None})


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "archive" / "alpha"
    folder.mkdir(parents=True)
    (folder / "memory_chat_v1-1.jsonl").write_text("\n".join([
        line(source_session_id="s1", messages=[{"role": "user", "text": "Straße one"}, {"role": "assistant", "text": "two"}]),
        "", line(source_session_id="s1", transcript_completeness="partial", limitations=["cut", "cut"]),
        line(source_session_id="s2", superseded_at="2024-02-01T00:00:00Z"), line(source_session_id=" s2 ", source_artifact_path="p", messages=[]),
    ]))
    return str(tmp_path / "archive")


def test_scan_numbers_lines_and_drops_superseded_rows(spark, root):
    found = read_archive(spark, root).select("row_number", "source_session_id").orderBy("row_number").collect()
    assert [(r.row_number, r.source_session_id) for r in found] == [(1, "s1"), (3, "s1"), (5, " s2 ")]
    assert read_archive(spark, root, include_superseded=True).count() == 4


def test_malformed_lines_raise_or_are_left_out(spark, tmp_path):
    folder = tmp_path / "bad" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text(line() + "\n{broken\n")
    lines = read_lines(spark, str(tmp_path / "bad"))
    assert parsed(lines, strict=False).count() == 1
    with pytest.raises(Exception, match="malformed row"):
        parsed(lines).collect()
    assert [r.row_number for r in V.malformed(lines).collect()] == [2]


def test_find_folds_case(spark, root):
    found = A.find(read_archive(spark, root), "STRASSE").collect()
    assert [(r.row_number, r.matched_message_count, r.preview) for r in found] == [(1, 1, "Straße one")]


def test_show_needs_exactly_one(spark, root):
    rows = read_archive(spark, root)
    assert A.show(rows, "alpha", " s2 ").count() == 1
    with pytest.raises(LookupError):
        A.show(rows, "alpha", "s1")
    with pytest.raises(LookupError):
        A.show(rows, "alpha", "none")


def test_duplicate_limitations_are_counted(spark, root):
    assert [(r.limitation, r.raw_count) for r in A.limitation_counts(read_archive(spark, root)).collect()] == [("cut", 2)]


def test_unknown_role_is_an_error_of_the_profile(spark, tmp_path):
    folder = tmp_path / "roles" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text(line(messages=[{"role": "robot", "text": "x"}]))
    with pytest.raises(ValueError, match="unknown role"):
        A.check_roles(read_archive(spark, str(tmp_path / "roles")))


def test_incremental_merge_needs_strictly_richer_rows(spark, root):
    rows = read_archive(spark, root)
    exact = S.transcript(F.col("messages"))
    decisions = {r.row_number: r.decision for r in I.incremental_merge(rows.where("row_number = 3"), rows.where("row_number <> 3"), exact).collect()}
    assert decisions == {1: "upgrade", 3: "supersede", 5: "insert"}
    again = {r.row_number: r.decision for r in I.incremental_merge(rows.where("row_number = 1"), rows.where("row_number = 3"), exact).collect()}
    assert again == {1: "keep", 3: "skip"}


def test_components_join_by_way_of_others(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_written_archive_reads_back(spark, root, tmp_path):
    rows = read_archive(spark, root)
    write_archive(rows, str(tmp_path / "copy"))
    copy = read_archive(spark, str(tmp_path / "copy"))
    assert sorted(r.t for r in copy.select(S.transcript(F.col("messages")).alias("t")).collect()) == sorted(r.t for r in rows.select(S.transcript(F.col("messages")).alias("t")).collect())


def test_redaction_counts_each_pattern_in_order(spark):
    text = 'Authorization: Bearer abc.def "token": "x" api_key=zzz sk-abcdefghijklmnopqrst'
    row = spark.range(1).select(S.redacted(F.lit(text)).alias("t"), S.redaction_events(F.lit(text)).alias("n")).first()
    assert row.t == 'Authorization: Bearer [REDACTED] "token": "[REDACTED]" api_key=[REDACTED] [REDACTED_API_KEY]'
    assert row.n == 4


def test_metadata_is_redacted_by_field_name(spark):
    row = spark.createDataFrame([('{"a":{"api-key":"x","list":["token=y"]},"n":1}',)], "j string").select(S.redact_json("j").alias("r")).first().r
    assert json.loads(row.value) == {"a": {"api-key": "[REDACTED]", "list": ["token=[REDACTED]"]}, "n": 1} and row.events == 2


def test_diff_and_trend_of_runs(spark):
    rows = spark.createDataFrame([("r1", "a", "failed", 1, 2), ("r2", "a", "partial", 3, 4), ("r3", "a", "complete", 3, 4), ("r3", "b", "complete", 1, 1)], "run_id string, source string, status string, conversation_count long, message_count long")
    found = {r.source: (r.presence, r.change, r.delta_message_count) for r in R.diff(rows, "r2", "r3").collect()}
    assert found == {"a": ("both", "improved", 0), "b": ("added", None, 1)}
    summary = {r.source: (r.improved, r.recovered, r.latest_status) for r in R.trend_summary(R.trend(rows)).collect()}
    assert summary == {"a": (2, 1, "complete"), "b": (0, 0, "complete")}
    with pytest.raises(ValueError):
        R.diff(rows, "r1", "r1")


def test_verify_finds_each_breach(spark, tmp_path):
    folder = tmp_path / "v" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text("\n".join([line(), line(source="beta"), line(contract={"schema_version": "1"}), line(execution_context=None), line(messages=[{"role": "user"}]), line(transcript_completeness="odd")]))
    rows = read_archive(spark, str(tmp_path / "v"))
    found = sorted((r.row_number, r.code) for r in V.findings(rows).collect())
    assert found == [(2, "invalid_field"), (3, "invalid_contract"), (4, "missing_required_field"), (5, "missing_required_field"), (6, "invalid_enum")]
    assert V.quarantine(rows.select("output_path", "row_number", "line"), V.findings(rows)).count() == 5
    assert V.findings(V.migrated(rows.where("row_number = 3"))).count() == 0


def test_lines_of_several_splits_are_numbered_by_split(spark, tmp_path):
    from colloquy.sources.archive import read_lines

    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jsonl").write_text("".join(f"{i}\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = read_lines(spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2000 and all(int(r.line) == r.row_number for r in rows)
    windows = [x for x in plan.splitlines() if "windowspecdefinition" in x and "_order#" in x]
    assert windows and not any("_block#" in x.split("_order#")[0] and " ASC" in x.split("windowspecdefinition")[1].split("_order#")[0] for x in windows)


def test_rows_that_break_the_form_are_named(spark, tmp_path):
    from colloquy.sources.archive import invalid_rows, read_lines

    folder = tmp_path / "f" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text("\n".join([line(), "{broken", "[1]", line(source=7), line(messages="none"), line(source_session_id=[1]), ""]))
    found = sorted((r.row_number, r.reason) for r in invalid_rows(read_lines(spark, str(tmp_path / "f"))).collect())
    assert found == [(2, "no JSON object"), (3, "no JSON object"), (4, "source"), (5, "messages"), (6, "source_session_id")]


def test_conversations_without_source_are_not_written(spark, tmp_path):
    from colloquy.sources.archive import write_archive

    folder = tmp_path / "w" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text(line())
    rows = read_archive(spark, str(tmp_path / "w"))
    write_archive(rows, str(tmp_path / "out"))
    assert read_archive(spark, str(tmp_path / "out")).count() == 1 and not list((tmp_path / "out").glob(".staging*"))
    with pytest.raises(Exception, match="without source"):
        write_archive(rows.withColumn("source", F.lit(None).cast("string")), str(tmp_path / "out"))


def test_spans_of_all_lengths_meet_their_points(spark):
    from colloquy.operators.attribution import within_span

    spans = [(1, 0, 10), (2, 5_000, 5_700), (3, 1_000, 40_000_000), (4, 100, 50)]
    points = [(k, t) for k, t in enumerate((0, 130, 131, 5_300, 39_999_999, 40_000_121, -120))]
    found = within_span(spark.createDataFrame(points, "p long, t long"), spark.createDataFrame(spans, "s long, low long, high long"), [], "t", "low", "high", 120)
    wanted = {(p, s) for p, t in points for s, low, high in spans if low <= high and low - 120 <= t <= high + 120}
    assert {(r.p, r.s) for r in found.collect()} == wanted and found.count() == len(wanted)
