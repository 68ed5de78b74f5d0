from __future__ import annotations

import json
import sqlite3

import pytest

from colloquy.sources.blobs import WireError, decoded, wire_fields
from colloquy.sources.collectors import SOURCES, selected


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else "\n".join(json.dumps(x) for x in text))


def collected(spark, key, root):
    return {r.source_session_id: [(m.role, m.text) for m in r.messages] for r in SOURCES[key].collect(spark, str(root)).collect()}


def test_rollouts(spark, tmp_path):
    said = lambda role, content: {"type": "response_item", "payload": {"type": "message", "role": role, "content": content, "id": "m"}}
    rows = [{"type": "session_meta", "payload": {"id": "s1", "originator": "codex_vscode", "cwd": "/x"}}, said("user", [{"type": "input_text", "text": " hi "}, {"type": "tool", "text": "no"}, "plain"]), said("assistant", "yes"), said("tool", "no"), {"type": "response_item", "payload": {"type": "call"}}]
    put(tmp_path / "sessions/2024/01/02/rollout-a.jsonl", "\n".join(json.dumps(r) for r in rows) + "\n{broken")
    put(tmp_path / "archived_sessions/rollout-b.jsonl", [said("user", "only")])
    assert collected(spark, "codex_cli", tmp_path) == {"s1": [("user", "hi\n\nplain"), ("assistant", "yes")], "rollout-b": [("user", "only")]}
    assert list(collected(spark, "codex_ide_extension", tmp_path)) == ["s1"] and collected(spark, "codex_app", tmp_path) == {}


def test_claude(spark, tmp_path):
    put(tmp_path / "projects/p/one.jsonl", [{"type": "summary", "sessionId": "c1"}, {"type": "user", "message": {"content": [{"type": "text", "text": "look"}, {"type": "image", "path": "a.png"}]}}, {"type": "assistant", "message": {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "ok"}]}}])
    put(tmp_path / "projects/p/c1/subagents/kid.jsonl", [{"type": "user", "sessionId": "c1", "message": {"content": "sub"}}])
    put(tmp_path / "history.jsonl", [{"display": "/ide", "sessionId": "c1"}, {"display": "x", "sessionId": "c9"}])
    assert collected(spark, "claude", tmp_path) == {"c1": [("user", "look"), ("assistant", "ok")], "c1/subagents/kid": [("user", "sub")]}
    images = [m.images for r in SOURCES["claude"].collect(spark, str(tmp_path)).collect() for m in r.messages if m.images]
    assert images[0][0].source == "a.png"
    assert "c1" in collected(spark, "claude_code_ide", tmp_path)


def test_json_chats(spark, tmp_path):
    put(tmp_path / "tmp/abc/chats/session-1.json", json.dumps({"sessionId": "g", "messages": [{"type": "user", "content": [{"text": "a"}, {"parts": ["b"]}]}, {"type": "info", "content": "no"}, {"type": "gemini", "content": "c"}]}))
    assert collected(spark, "gemini", tmp_path) == {"g": [("user", "a\n\nb"), ("assistant", "c")]}
    put(tmp_path / "User/workspaceStorage/w/chatSessions/x.json", json.dumps({"sessionId": "q", "responderUsername": "Gemini", "requests": [{"requestId": "1", "message": {"text": "ask"}, "response": {"message": "tell"}}]}))
    assert collected(spark, "gemini_code_assist_ide", tmp_path) == {"q": [("user", "ask"), ("assistant", "tell")]}


def test_editor_store(spark, tmp_path):
    path = tmp_path / "User/globalStorage/state.vscdb"
    path.parent.mkdir(parents=True)
    base = sqlite3.connect(path)
    base.execute("create table cursorDiskKV (key text, value blob)")
    base.executemany("insert into cursorDiskKV values (?, ?)", [
        ("composerData:k", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}, {"bubbleId": "2", "type": 2}, {"bubbleId": "3", "type": 2}]})),
        ("bubbleId:k:1", json.dumps({"text": "question"})), ("bubbleId:k:2", json.dumps({"text": " ", "content": "answer"})),
    ])
    base.commit()
    base.close()
    assert collected(spark, "cursor_editor", tmp_path) == {"k": [("user", "question"), ("assistant", "answer")]}
    assert SOURCES["cursor_editor"].collect(spark, str(tmp_path)).first().transcript_completeness == "partial"


def field(number, value):
    return bytes([number << 3 | 2, len(value)]) + value


def test_blobs(spark, tmp_path):
    (tmp_path / "conversations").mkdir()
    (tmp_path / "conversations/a.pb").write_bytes(field(1, b"z") + field(2, field(1, b"m1") + bytes([2 << 3, 1]) + field(3, b"hello")) + field(2, field(2, b"assistant") + field(3, b"there")))
    (tmp_path / "conversations/b.pb").write_bytes(b"\xff\xff")
    assert collected(spark, "antigravity_editor_view", tmp_path) == {"z": [("user", "hello"), ("assistant", "there")], "b": []}
    with pytest.raises(ValueError):
        wire_fields(b"\x0a\x05ab")


def test_memories_and_rules(spark, tmp_path):
    put(tmp_path / "memories/note.md", " remember \n")
    put(tmp_path / "rules/style.md", "---\ntrigger: always\n# no\n---\nUse tabs.")
    assert collected(spark, "windsurf_editor", tmp_path) == {"note": [("assistant", "remember")], "style": [("system", "Use tabs.")]}


def test_command_logs(spark, tmp_path):
    put(tmp_path / "logs/20240102T030405/cli.log", 'start\n{"other": 1}\n{"argv": ["x"]}\n{"argv": ["y"]}\n')
    row = SOURCES["cursor"].collect(spark, str(tmp_path)).first()
    assert json.loads(row.session_metadata) == {"argv": ["x"]} and row.transcript_completeness == "unsupported"


def store(path, table, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    base = sqlite3.connect(path)
    base.execute(f"create table {table} (key text, value blob)")
    base.executemany(f"insert into {table} values (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()])
    base.commit()
    base.close()


def test_invocations_get_the_messages_of_their_session(spark, tmp_path):
    at = 1704164645000  # 20240102T030405
    for slug in ("20240102T030405", "20240102T031000", "20240102T031405", "20240102T050000", "20240103T000000"):
        put(tmp_path / f"logs/{slug}/cli.log", [{"argv": ["x"]}])

    def workspace(name, composer, prompts, created, done):
        values = {"composer.composerData": {"allComposers": [{"composerId": composer, "createdAt": created}]}, "aiService.prompts": [{"text": p} for p in prompts], "aiService.generations": [{"type": "composer", "unixMs": done}, {"type": "other", "unixMs": 1}]}
        store(tmp_path / f"User/workspaceStorage/{name}/state.vscdb", "ItemTable", values)

    workspace("w1", "k", [" question "], at - 60000, at + 60000)
    workspace("w2", "l", ["never said"], at + 500000, at + 500000)
    for name in ("w3", "w4"):  # the same distance from the third invocation, so neither
        workspace(name, "m", ["never said"], at + 7000000, at + 86400000 - 11045000)
    store(tmp_path / "User/globalStorage/state.vscdb", "cursorDiskKV", {
        "composerData:k": {"fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}, {"bubbleId": "t", "type": 2}, {"bubbleId": "2", "type": 2}]},
        "bubbleId:k:1": {"text": "question"}, "bubbleId:k:t": {"toolFormerData": {"a": 1}}, "bubbleId:k:2": {"text": "answer"},
        "composerData:l": {"fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}]}, "bubbleId:l:1": {"text": "something else"},
    })
    found = {r.source_session_id: r for r in SOURCES["cursor"].collect(spark, str(tmp_path)).collect()}
    whole = found["20240102T030405"]
    assert [(m.role, m.text, m.timestamp) for m in whole.messages] == [("user", "question", None), ("assistant", "answer", "2024-01-02T03:05:05Z")]
    assert (whole.transcript_completeness, whole.limitations) == ("complete", []) and json.loads(whole.session_metadata)["transcript_attribution"]["composer_id"] == "k"
    for slug in ("20240102T031000", "20240102T031405"):
        assert found[slug].messages == [] and found[slug].transcript_completeness == "partial"
        assert json.loads(found[slug].session_metadata)["workspace_prompt_evidence"]["composer_id"] == "l"
    assert {found[s].transcript_completeness for s in ("20240102T050000", "20240103T000000")} == {"unsupported"}


def test_editor_command_marker_keeps_a_session(spark, tmp_path):
    marker, said = "<command-name>/ide</command-name>", {"type": "user", "message": {"content": "hi"}}
    put(tmp_path / "projects/p/raw.jsonl", [said, {"type": "user", "message": {"content": [{"type": "text", "text": "<local-command-stdout>no</local-command-stdout>"}, {"type": "text", "text": "yes"}]}}, {"type": "x", "n": marker}])
    put(tmp_path / "projects/p/escaped.jsonl", json.dumps(said) + "\n" + json.dumps({"type": "system", "subtype": "local_command", "message": {"content": [marker]}}).replace("/", "\\/"))
    put(tmp_path / "projects/p/other.jsonl", [said])
    assert collected(spark, "claude_code_ide", tmp_path) == {"raw": [("user", "hi"), ("user", "yes")], "escaped": [("user", "hi")]}
    put(tmp_path / "history.jsonl", [{"display": "/ide", "sessionId": "other"}])
    assert collected(spark, "claude_code_ide", tmp_path).keys() == {"raw", "escaped", "other"}


def test_selection():
    assert [s.key for s in selected(least_level="complete", excluded=("gemini",))] == ["codex_cli", "codex_ide_extension", "codex_app", "claude"]
    with pytest.raises(KeyError):
        selected(["nobody"])


def state(path, **items):
    path.parent.mkdir(parents=True, exist_ok=True)
    base = sqlite3.connect(path)
    base.execute("create table ItemTable (key text, value blob)")
    base.executemany("insert into ItemTable values (?, ?)", list(items.items()))
    base.commit()
    base.close()


VIEW = {"workbench.view.extension.geminiChat.state": "{}"}


def test_indexed_chat_sessions_and_what_is_left_over(spark, tmp_path):
    storage = tmp_path / "User/workspaceStorage"
    index = lambda *ids: json.dumps({"version": 1, "entries": [{"sessionId": i, "isEmpty": i == "q2", "lastMessageDate": 1700000000000} for i in ids]})
    state(storage / "w1/state.vscdb", **VIEW, **{"chat.ChatSessionStore.index": index("q1", "q2", "q3", "gone")})
    state(storage / "w2/state.vscdb", **VIEW)
    state(storage / "w3/state.vscdb", **{"chat.ChatSessionStore.index": index("q1")})
    state(storage / "w4/state.vscdb", **VIEW, **{"chat.ChatSessionStore.index": index("q4")})
    put(storage / "w1/workspace.json", json.dumps({"folder": "file:///home/u/a%20b"}))
    turn = [{"requestId": "1", "message": {"text": "ask"}, "response": {"message": "tell"}}]
    for name, provider, requests in (("w1/chatSessions/q1", "Gemini", turn), ("w1/chatSessions/q2", "Gemini", []), ("w1/chatSessions/q3", "GitHub Copilot", turn), ("w1/chatSessions/unnamed", "Gemini", turn), ("w3/chatSessions/q1", "Gemini", turn), ("w4/chatSessions/q4", "Gemini", turn)):
        put(storage / f"{name}.json", json.dumps({"sessionId": "own", "responderUsername": provider, "requests": requests}))
    found = {r.source_session_id: r for r in SOURCES["gemini_code_assist_ide"].collect(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["vscode:w1:q1", "vscode:w1:residue", "vscode:w2:residue", "vscode:w4:q4"]
    one, left, bare = found["vscode:w1:q1"], found["vscode:w1:residue"], found["vscode:w2:residue"]
    assert [(m.role, m.text) for m in one.messages] == [("user", "ask"), ("assistant", "tell")] and json.loads(one.provenance)["cwd"] == "/home/u/a b"
    meta = json.loads(one.session_metadata)
    assert (meta["scope"], meta["chat_session_id"], meta["chat_session_session_count"], meta["chat_session_empty_count"], meta["gemini_chat_session_count"], meta["foreign_chat_session_count"]) == ("chat_session", "q1", 4, 1, 2, 1)
    assert (list(left.messages), left.transcript_completeness, left.limitations) == ([], "unsupported", ["metadata_only_ide_state", "gemini_owned_chat_session_body_missing", "foreign_chat_session_rejected"])
    assert bare.limitations == ["no_confirmed_gemini_code_assist_ide_transcript_store", "metadata_only_ide_state", "chat_session_provider_attribution_required"]
    assert json.loads(left.session_metadata)["metadata_only_chat_session_residue_count"] == 2


def test_editor_prompts_stand_in_for_a_transcript(spark, tmp_path):
    path = tmp_path / "User/globalStorage/state.vscdb"
    path.parent.mkdir(parents=True)
    base = sqlite3.connect(path)
    base.execute("create table cursorDiskKV (key text, value blob)")
    base.executemany("insert into cursorDiskKV values (?, ?)", [
        ("composerData:full", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}]})), ("bubbleId:full:1", json.dumps({"body": {"markdown": "stored"}})),
        ("composerData:lost", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "9", "type": 2}]})),
    ])
    base.commit()
    base.close()
    prompts = lambda composer, *texts: {"composer.composerData": json.dumps({"allComposers": [{"composerId": composer}]}), "aiService.prompts": json.dumps([{"text": t} for t in texts]), "aiService.generations": json.dumps([{"unixMs": 1700000000000, "type": "composer"}])}
    for i, composer in enumerate(("full", "lost", "only")):
        state(tmp_path / f"User/workspaceStorage/w{i}/state.vscdb", **prompts(composer, "one", "two"))
    found = {r.source_session_id: r for r in SOURCES["cursor_editor"].collect(spark, str(tmp_path)).collect()}
    assert [(m.text, m.provenance.body_source) for m in found["full"].messages] == [("stored", "cursor_disk_kv.body.markdown")] and found["full"].limitations is None
    assert [(m.text, m.timestamp) for m in found["only"].messages] == [("one", "2023-11-14T22:13:20Z"), ("two", None)]
    fallback = ["cursor_disk_kv_transcript_not_found", "assistant_body_unverified", "workspace_prompt_cache_not_explicitly_composer_scoped"]
    assert found["only"].limitations == fallback and found["lost"].limitations == [*fallback, "bubbles without a body"]
    assert {r.transcript_completeness for r in found.values()} == {None, "partial"}
    assert found["only"].source_artifact_path.endswith("w2/state.vscdb#only")


UUIDS = [f"0000000{i}-1111-4222-8333-444444444444" for i in range(8)]


def test_blobs_say_what_could_not_be_read(spark, tmp_path):
    said = lambda role, text, **more: field(2, b"".join([field(1, b"m")] + ([bytes([2 << 3, role])] if isinstance(role, int) else [field(2, role)]) + [field(3, text)] + [field(4, v) for v in more.values()]))
    blobs = {
        0: field(1, UUIDS[0].upper().encode()) + said(1, b" ask ", at=b"2024-01-01T00:00:00Z") + said(b"Assistant", b"tell"),
        1: field(1, UUIDS[2].encode()) + said(2, b"only") + field(2, b"\xff"),
        2: field(1, UUIDS[2].encode()) + said(7, b"who"),
        3: b"\x0b\x00", 4: field(1, b"x") + b"\x12\x7fab", 5: b"", 6: field(1, b"a") + bytes([5 << 3 | 1]) + b"12345678" + bytes([6 << 3 | 5]) + b"1234" + said(1, b"q"),
    }
    for i, raw in blobs.items():
        put(tmp_path / f"conversations/{UUIDS[i]}.pb", "")
        (tmp_path / f"conversations/{UUIDS[i]}.pb").write_bytes(raw)
    for name, text in ((f"brain/{UUIDS[0]}/plan.md", "p"), (f"brain/{UUIDS[0]}/plan.md.metadata.json", "{}"), (f"brain/{UUIDS[0]}/shot.PNG", "i"), (f"brain/{UUIDS[0]}/x.resolved", "r"), ("brain/other/no.md", "n"), (f"annotations/{UUIDS[0]}.pbtxt", 'title: "T"\nseen: true\n'), (f"browser_recordings/{UUIDS[1].upper()}/1.jpg", "f")):
        put(tmp_path / name, text)
    found = {UUIDS.index(r.source_session_id): r for r in SOURCES["antigravity_editor_view"].collect(spark, str(tmp_path)).collect()}
    state = {i: (r.transcript_completeness, r.limitations) for i, r in found.items()}
    lost = ["decode_failed", "metadata_only_session_family"]
    assert state == {
        0: (None, None), 1: ("partial", ["variant_unknown", "conversation_protobuf_session_id_mismatch", "user_message_missing_from_conversation_protobuf"]), 2: ("unsupported", ["variant_unknown", "metadata_only_session_family"]),
        3: ("unsupported", ["variant_unknown", *lost]), 4: ("unsupported", lost), 6: ("partial", ["assistant_message_missing_from_conversation_protobuf"]),
    }
    assert [(m.role, m.text, m.timestamp, m.source_message_id) for m in found[0].messages] == [("user", "ask", "2024-01-01T00:00:00Z", "m"), ("assistant", "tell", None, "m")]
    meta = {i: json.loads(r.session_metadata) for i, r in found.items()}
    brain = meta[0]["brain"]
    assert (brain["artifact_names"], brain["artifact_summary_count"], brain["image_artifact_count"], brain["resolved_artifact_count"]) == (["plan.md"], 1, 1, 1)
    assert json.loads(meta[0]["annotation"]["fields"]) == {"title": "T", "seen": True} and meta[1]["browser_recording"]["frame_count"] == 1 and "brain" not in meta[1]
    assert [meta[i]["conversation_blob"]["decode_status"] for i in sorted(meta)] == ["decoded", "partially_decoded", "variant_unknown", "decode_failed", "decode_failed", "partially_decoded"]
    assert meta[4]["conversation_blob"]["failure"] == {"error": "cut field at 5", "offset": 5, "stage": "field", "number": 2, "kind": 2}
    assert decoded(b"\x80")["failure"]["stage"] == "varint" and decoded(b"\x00")["failure"]["stage"] == "tag"
    with pytest.raises(WireError, match="long number"):
        wire_fields(b"\xff" * 11)
