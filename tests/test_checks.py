"""Verification of archives, validation of runs, and baseline policies, against what each breach must give."""

from __future__ import annotations

import json

import pytest

from colloquy.operators import checks as C
from colloquy.operators import policy as P
from colloquy.sources.archive import files_of, read_lines, read_manifests

GOOD = {"source": "alpha", "execution_context": "cli", "collected_at": "2024-01-01T00:00:00Z", "contract": {"schema_version": "2026-03-19"}, "messages": [{"role": "user", "text": "Hello"}]}


def row(drop=(), **fields):
    return json.dumps({k: v for k, v in (GOOD | fields).items() if k not in drop})


#: Rows, and the findings (level, code, what) of each.
ROWS = [
    (row(), []), ("{broken", [("error", "malformed_row", "line")]), ("[1]", [("error", "malformed_row", "line")]), ("3", [("error", "malformed_row", "line")]),
    (row(drop=["source"]), [("error", "missing_required_field", "source")]), (row(source=5), [("error", "invalid_field", "source")]), (row(source=""), [("error", "invalid_field", "source")]), (row(source="beta"), [("error", "invalid_field", "source is another")]),
    (row(collected_at=None, execution_context=""), [("error", "invalid_field", "execution_context"), ("error", "invalid_field", "collected_at")]),
    (row(drop=["contract"]), [("error", "missing_required_field", "contract")]), (row(contract=[]), [("error", "invalid_field", "contract")]), (row(contract={}), [("error", "missing_required_field", "contract.schema_version")]),
    (row(contract={"schema_version": "1"}), [("error", "invalid_contract", "1")]), (row(contract={"schema_version": 1}), [("error", "invalid_field", "contract.schema_version")]),
    (row(transcript_completeness=None), [("error", "invalid_field", "transcript_completeness")]), (row(transcript_completeness="partial"), [("warning", "incomplete_transcript", "partial")]),
    (row(transcript_completeness="odd"), [("error", "invalid_enum", "transcript_completeness"), ("warning", "incomplete_transcript", "odd")]),
    (row(drop=["messages"]), [("error", "missing_required_field", "messages")]), (row(messages={}), [("error", "invalid_field", "messages")]), (row(messages=[]), []),
    (row(messages=[7, {"role": "tool", "text": None}, {"text": 3, "role": ""}]), [("error", "malformed_row", "messages[1]"), ("error", "invalid_enum", "messages[2].role"), ("error", "invalid_field", "messages[3].role"), ("error", "invalid_field", "messages[3].text")]),
    (row(messages=[{"role": "user"}, {"text": "x"}]), [("error", "missing_required_field", "messages[1].text or images"), ("error", "missing_required_field", "messages[2].role")]),
    (row(messages=[{"role": "user", "images": {}}, {"role": "user", "images": [1, {}, {"source": ""}, {"source": "u"}]}]),
     [("error", "invalid_field", "messages[1].images"), ("error", "invalid_field", "messages[2].images[1]"), ("error", "missing_required_field", "messages[2].images[2].source"), ("error", "invalid_field", "messages[2].images[3].source")]),
]


def test_each_breach_of_a_row(spark):
    lines = spark.createDataFrame([("alpha", "f", i, line) for i, (line, _) in enumerate(ROWS)] + [("alpha", "f", 99, "  ")], "source_dir string, output_path string, row_number long, line string")
    found = {}
    for r in C.row_findings(lines).collect():
        found.setdefault(r.row_number, []).append((r.level, r.code, r.what))
    for i, (line, wanted) in enumerate(ROWS):
        assert sorted(found.get(i, [])) == sorted(wanted), line
    assert 99 not in found
    assert "invalid_contract" not in {r.code for r in C.row_findings(lines, contract=False).collect()}


def test_paths(spark):
    paths = {"/a/./b//c/": "/a/b/c", "file:///a/b": "/a/b", "file:/a/../b": "/b", "hdfs://host:1/x/y": "/x/y", "/../..": "/"}
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.plain_path(C.F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in found} == paths


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    (root / "alpha").mkdir(parents=True)
    (root / "beta dir").mkdir()
    (root / "alpha" / "memory_chat_v1-1.jsonl").write_text("\n".join([row(), "", row(transcript_completeness="partial"), "{bad"]) + "\n")
    (root / "alpha" / "memory_chat_v1-alpha.jsonl").write_text(row() + "\n")
    (root / "alpha" / "memory_chat_v1-alpha-00001.jsonl").write_text(row(transcript_completeness="partial") + "\n")
    (root / "alpha" / "stray.jsonl").write_text(row(transcript_completeness="unsupported") + "\n")
    (root / "beta dir" / "part-1.txt").write_text(row(source="beta dir") + "\n")
    return root


def manifest(root, run, payload, **sources):
    folder = root / "runs" / run
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text(payload if isinstance(payload, str) else json.dumps(payload))


def verified(spark, root, policy=None, expected=None):
    return C.verify(read_lines(spark, str(root)), files_of(spark, str(root)), read_manifests(spark, str(root)), str(root), policy, expected)


def test_manifests_link_files(spark, archive):
    manifest(archive, "r1", {"sources": [{"source": "alpha", "output_path": str(archive / "alpha" / "memory_chat_v1-1.jsonl")}, {"source": "b", "output_path": None}, 7, {"output_path": "relative"}, {"output_path": ""}, {"output_path": "/elsewhere/x"}, {"output_path": 3}]})
    manifest(archive, "r2", {"sources": [{"output_path": f"{archive}/beta dir"}]})
    manifest(archive, "r3", "{no json")
    manifest(archive, "r4", {"sources": {}})
    manifest(archive, "r5", "[]")
    found = verified(spark, archive)
    bad = [(r.output_path.split("/")[-2], r.what) for r in found.findings.where("code = 'invalid_manifest_reference'").collect()]
    assert sorted(bad) == [("r1", "sources[3]"), ("r1", "sources[4].output_path"), ("r1", "sources[5].output_path"), ("r1", "sources[6].output_path"), ("r1", "sources[7].output_path"), ("r3", "manifest"), ("r4", "sources"), ("r5", "manifest")]
    files = {r.output_path.split("/")[-1]: r for r in found.files.collect()}
    assert {n: (r.manifest_linked, r.orphan) for n, r in files.items()} == {
        "memory_chat_v1-1.jsonl": (True, False), "memory_chat_v1-alpha.jsonl": (False, False), "memory_chat_v1-alpha-00001.jsonl": (False, False), "stray.jsonl": (False, True), "part-1.txt": (True, False),
    }
    assert (files["memory_chat_v1-1.jsonl"].row_count, files["memory_chat_v1-1.jsonl"].bad_row_count, files["memory_chat_v1-1.jsonl"].status) == (3, 1, "error")
    whole = found.whole.first()
    assert (whole.file_count, whole.row_count, whole.bad_row_count, whole.orphan_file_count, whole.error_count, whole.warning_count) == (5, 7, 1, 1, 1, 3 + 1 + 8)


ENTRY = "place long, id string, kind string, source string, report string, code string, limitation string, support_level string, status string, reason string"


def test_policy_lays_over_a_verification(spark, archive):
    policy = spark.createDataFrame([
        (1, "z", "finding", "alpha", "archive_verify", "incomplete_transcript", None, None, None, "known"), (2, "a", "finding", "alpha", "archive_verify", "incomplete_transcript", None, None, None, "later"),
        (3, "m", "finding", "alpha", "archive_verify", "malformed_row", None, None, None, "errors stay"), (4, "v", "finding", "alpha", "validate", "orphan_output_file", None, None, None, "another report"),
    ], ENTRY)
    expected = spark.createDataFrame([("alpha", "gone.jsonl")], "source_dir string, output_path string")
    found = verified(spark, archive, policy, expected)
    assert {(r.code, r.suppressed_by) for r in found.findings.collect()} == {("incomplete_transcript", "z"), ("malformed_row", None), ("orphan_output_file", None), ("missing_file", None)}
    files = {r.output_path.split("/")[-1]: r for r in found.files.collect()}
    part, stray = files["memory_chat_v1-alpha-00001.jsonl"], files["stray.jsonl"]
    assert (part.status, part.raw_status, part.suppressed_warning_count, part.warning_count) == ("success", "warning", 1, 0)
    assert (stray.status, stray.raw_status, stray.warning_count) == ("warning", "warning", 1)
    alpha = found.sources.where("source = 'alpha'").first()
    assert (alpha.error_count, alpha.warning_count, alpha.suppressed_warning_count, alpha.file_count) == (2, 2, 3, 4)  # the linkless files with other names


def good_run(root, run, **changes):
    source = {
        "source": "alpha", "support_level": "complete", "status": "complete", "archive_root": str(root), "output_path": str(root / "alpha" / "memory_chat_v1-alpha.jsonl"), "input_roots": ["/in"], "scanned_artifact_count": 1, "conversation_count": 1,
        "skipped_conversation_count": 0, "written_conversation_count": 1, "message_count": 1, "failed": False, "partial": False, "unsupported": False,
    } | changes.pop("source", {})
    source = {k: v for k, v in source.items() if v != "drop"}
    payload = {"run_id": run, "archive_root": str(root), "run_dir": str(root / "runs" / run), "manifest_path": str(root / "runs" / run / "manifest.json"), "source_count": 1, "failed_source_count": 0}
    payload |= {"conversation_count": 1, "skipped_conversation_count": 0, "written_conversation_count": 1, "message_count": 1, "sources": [source]}
    manifest(root, run, {k: v for k, v in (payload | changes).items() if v != "drop"})


RUNS = {
    "good": ({}, set()),
    "run": ({"run_id": "x", "archive_root": "rel", "run_dir": "/other", "source_count": 2, "failed_source_count": "drop", "message_count": True}, {
        ("invalid_field", "run_id is another"), ("invalid_field", "archive_root"), ("invalid_field", "run_dir is another"), ("count_mismatch", "source_count"), ("missing_required_field", "failed_source_count"), ("invalid_field", "message_count")}),
    "list": ({"sources": "none"}, {("invalid_field", "sources")}),
    "entry": ({"sources": [4]}, {("invalid_field", "sources[1]"), ("count_mismatch", "conversation_count"), ("count_mismatch", "written_conversation_count"), ("count_mismatch", "message_count")}),
    "state": ({"source": {"support_level": "partial", "status": "failed", "failed": False, "partial": True}}, {("degraded_support_level", "partial"), ("degraded_source_status", "failed"), ("status_mismatch", "partial")}),
    "enums": ({"source": {"support_level": "odd", "status": "odd"}}, {("invalid_enum", "support_level"), ("degraded_support_level", "odd"), ("invalid_enum", "status"), ("degraded_source_status", "odd"), ("status_mismatch", "complete")}),
    "counts": ({"source": {"conversation_count": 3, "written_conversation_count": 2, "message_count": 9}}, {
        ("count_mismatch", "skipped and written"), ("count_mismatch", "written_conversation_count"), ("count_mismatch", "message_count"), ("count_mismatch", "conversation_count")}),
    "null": ({"source": {"output_path": None}}, {("missing_required_field", "output_path of the status"), ("count_mismatch", "written_conversation_count without output_path"), ("count_mismatch", "written_conversation_count"), ("count_mismatch", "message_count")}),
    "gone": ({"source": {"output_path": "ROOT/alpha/none.jsonl"}}, {("missing_file", "output_path"), ("count_mismatch", "written_conversation_count"), ("count_mismatch", "message_count")}),
    "outside": ({"source": {"output_path": "/tmp/none.jsonl", "archive_root": "/tmp"}}, {("invalid_field", "output_path is outside"), ("invalid_field", "archive_root is another"), ("missing_file", "output_path"), ("count_mismatch", "written_conversation_count"), ("count_mismatch", "message_count")}),
    "kinds": ({"source": {"source": "drop", "failed": "no", "input_roots": [3, "rel"], "skipped_conversation_count": "drop"}}, {
        ("missing_required_field", "source"), ("invalid_field", "failed"), ("invalid_field", "input_roots[1]"), ("invalid_field", "input_roots[2]"), ("missing_required_field", "skipped_conversation_count"), ("invalid_field", "source is another")}),
    "drift": ({"conversation_count": 0, "written_conversation_count": 0, "message_count": 0, "source": {"status": "unsupported", "unsupported": True, "output_path": None, "conversation_count": 0, "written_conversation_count": 0, "message_count": 0}},
        {("drift_suspected", "conversation_count"), ("degraded_source_status", "unsupported")}),
}


def test_each_breach_of_a_run(spark, archive):
    for run, (changes, _) in RUNS.items():
        changes = json.loads(json.dumps(changes).replace("ROOT", str(archive)))
        good_run(archive, run, **changes)
    manifest(archive, "text", "{no")
    found = C.validate(read_manifests(spark, str(archive)), files_of(spark, str(archive)), read_lines(spark, str(archive)), str(archive), runs=["good", "never"])
    by_run = {}
    for r in found.findings.where("level <> 'success'").collect():
        by_run.setdefault(r.run_id, set()).add((r.code, r.what))
    for run, (_, wanted) in RUNS.items():
        assert by_run.get(run, set()) == wanted, run
    assert by_run["text"] == {("invalid_field", "manifest")} and by_run["never"] == {("missing_file", "manifest")}
    good = [(r.code, r.source) for r in found.findings.where("run_id = 'good'").collect()]
    assert sorted(good, key=str) == [("manifest_loaded", None), ("source_validated", "alpha")]
    report = found.sources.where("run_id = 'good'").first()
    assert (report.row_count, report.actual_message_count, report.validation_status) == (1, 1, "success")


def test_no_path_lies_in_the_repository(spark, archive):
    good_run(archive, "r")
    found = C.validate(read_manifests(spark, str(archive)), files_of(spark, str(archive)), read_lines(spark, str(archive)), str(archive), repository=str(archive.parent))
    assert {r.what for r in found.findings.where("code = 'external_archive_only_violation'").collect()} == {"archive_root", "run_dir", "manifest_path", "output_path"}


def test_the_most_specific_entry_of_a_degraded_source(spark, archive):
    state = {"support_level": "partial", "status": "partial", "partial": True, "output_path": f"{archive}/alpha/memory_chat_v1-alpha-00001.jsonl"}
    good_run(archive, "r", source=state)
    entries = [("any", None, None), ("status", None, "partial"), ("level", "partial", None), ("level too", "partial", None), ("wrong", "partial", "failed")]
    policy = spark.createDataFrame([(i, e, "degraded_source", "alpha", None, None, None, level, status, "why") for i, (e, level, status) in enumerate(entries)] + [(9, "f", "finding", "alpha", "validate", "incomplete_transcript", None, None, None, "why")], ENTRY)

    def read(own):
        return C.validate(read_manifests(spark, str(archive)), files_of(spark, str(archive)), read_lines(spark, str(archive)), str(archive), policy=own)

    found = {r.code: (r.suppressed_by, r.suppression_kind) for r in read(policy).findings.where("level = 'warning'").collect()}
    assert found == {"degraded_support_level": ("level", "degraded_source"), "degraded_source_status": ("level", "degraded_source"), "incomplete_transcript": ("f", "finding")}
    report = read(policy).sources.first()
    assert (report.validation_status, report.raw_validation_status, report.suppressed_warning_count) == ("success", "warning", 3)
    found = {r.code: r.suppressed_by for r in read(policy.where("id in ('any', 'status', 'wrong')")).findings.where("level = 'warning'").collect()}
    assert found == {"degraded_support_level": "status", "degraded_source_status": "status", "incomplete_transcript": None}


def test_policies_are_parsed_strictly_and_saved_in_order(spark, tmp_path):
    path = tmp_path / "baseline-policy.json"
    good = [
        {"kind": "limitation", "source": "b", "limitation": "no tools", "reason": "r", "code": "left out"}, {"kind": "finding", "source": "a", "report": "validate", "code": "x", "reason": "r", "id": "own"},
        {"kind": "degraded_source", "source": "a", "status": "partial", "reason": "r", "added_at": "2024-01-01T00:00:00Z"}, {"kind": "finding", "source": "a", "report": "validate", "code": "x", "reason": "again"},
    ]
    path.write_text(json.dumps({"version": 1, "entries": good}))
    entries = P.read_policy(spark, str(path))
    assert [(r.id, r.code) for r in entries.orderBy("place").collect()] == [("limitation:b:no tools", None), ("own", "x"), ("degraded_source:a:*:partial", None), ("finding:validate:a:x", "x")]
    assert P.write_policy(entries, str(tmp_path / "saved.json")) == 3
    saved = json.loads((tmp_path / "saved.json").read_text())
    assert saved["version"] == 1 and [e["id"] for e in saved["entries"]] == ["degraded_source:a:*:partial", "own", "limitation:b:no tools"]
    assert P.read_policy(spark, str(tmp_path / "saved.json")).count() == 3
    bad = ["[]", "{", json.dumps({"version": 2, "entries": []}), json.dumps({"version": "1", "entries": []}), json.dumps({"version": 1})]
    broken = [7, {}, good[0] | {"kind": "odd"}, good[0] | {"reason": " "}, {"kind": "limitation", "source": "a", "reason": "r"}, good[1] | {"report": "odd"}, good[1] | {"code": "drift_suspected"}, {k: v for k, v in good[1].items() if k != "code"}, good[2] | {"status": 3}]
    for text in bad + [json.dumps({"version": 1, "entries": [good[0], e]}) for e in broken]:
        path.write_text(text)
        with pytest.raises(ValueError, match="policy|entries|entry 2"):
            P.read_policy(spark, str(path))
