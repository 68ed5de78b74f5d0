"""SQLite tables as a data source, and desktop rollouts joined with threads and automation runs."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from colloquy.sources import desktop as D
from colloquy.sources import sqlite_source as Q


def database(path, **tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    base = sqlite3.connect(path)
    for name, (columns, rows) in tables.items():
        base.execute(f"create table {name} ({', '.join(columns)})")
        base.executemany(f"insert into {name} values ({', '.join('?' * len(columns))})", rows)
    base.commit()
    return base


def test_tables_are_read_by_file_and_filtered_inside(spark, tmp_path):
    database(tmp_path / "a b.db", t=(["key text", "value blob", "n int"], [("k*1", "x", 1), ("k*2", b"\xc3\xa9", 2), ("kk", None, 3), (b"k*3", "bytes", "odd")])).close()
    database(tmp_path / "c.db", other=(["x"], [])).close()
    (tmp_path / "no.db").write_bytes(b"no database at all, but long enough to be read as a page of one")
    held = database(tmp_path / "wal.db", t=(["key text", "value text"], []))
    held.execute("pragma journal_mode=wal")
    held.execute("insert into t values ('w', 'in the log')")
    held.commit()
    paths = [f"file://{tmp_path}/{n}".replace(" ", "%20") for n in ("a b.db", "c.db", "no.db", "wal.db", "gone.db")]
    read = lambda: Q.tables(spark, paths, "t", "key string, value string, n bigint, absent string")
    rows = sorted((r.path.rpartition("/")[2], r.key, r.value, r.n, r.absent) for r in read().collect())
    assert rows == [("a%20b.db", "k*1", "x", 1, None), ("a%20b.db", "k*2", "é", 2, None), ("a%20b.db", "k*3", "bytes", None, None), ("a%20b.db", "kk", None, 3, None), ("wal.db", "w", "in the log", None, None)]
    assert read().rdd.getNumPartitions() == 5
    for condition, wanted in ((F.col("key") == "kk", ["kk"]), (F.col("key").isin("k*1", "w"), ["k*1", "w"]), (F.col("key").startswith("k*"), ["k*1", "k*2", "k*3"]), ((F.col("key").startswith("k")) & (F.col("n") > 1), ["k*2", "kk"]), (F.col("value").isNull(), ["kk"])):
        found = read().where(condition)
        assert sorted(r.key for r in found.collect()) == wanted
    plan = read().where(F.col("key") == "kk")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    held.close()


def rollout(folder, name, session, cwd, *messages, archived=False, originator="Codex Desktop"):
    path = folder / ("archived_sessions" if archived else "sessions") / f"rollout-{name}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [{"type": "session_meta", "payload": {k: v for k, v in {"id": session, "timestamp": "2024-01-01T00:00:00Z", "originator": originator, "cwd": cwd}.items() if v is not None}}]
    lines += [{"type": "response_item", "payload": {"type": "message", "role": r, "content": [{"type": "input_text", "text": t}]}} for r, t in messages]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    return str(path)


@pytest.fixture
def store(tmp_path):
    both = ("user", "q"), ("assistant", "a")
    rollout(tmp_path, "plain", "p", "/w", *both)
    rollout(tmp_path, "cli", "c", "/w", *both, originator="cli")
    rollout(tmp_path, "thread", "t1", "/w", ("developer", "d"), ("assistant", "a"), archived=True)
    by_path = rollout(tmp_path, "path", None, None, ("assistant", "a"))
    rollout(tmp_path, "title", "t3", "/w", ("assistant", "only"))
    rollout(tmp_path, "text", "t4", "/x", ("user", "do it"))
    rollout(tmp_path, "twice", "t5", "/x", ("user", "again"))
    rollout(tmp_path, "empty", "t6", "/w", ("developer", "d"))
    columns = list(D.THREAD)
    database(tmp_path / "state_5.sqlite", threads=(columns, [
        ("t1", None, "/w", "title one", "thread question", 1, "1.0"), ("t2", by_path, "/w", None, "from the thread", 0, None), ("t3", None, None, "weekly", None, 0, None), ("t4", None, None, None, None, 0, None),
    ])).close()
    database(tmp_path / "sqlite" / "codex-dev.db", automations=(list(D.DEFINITION), [("auto", "Name", "p", "on", "FREQ=DAILY", None, "high")]), automation_runs=(list(D.RUN), [
        ("t1", "auto", "done", "run title", "/w", "inbox", "summary", "archived question", "archived answer", "kept"), ("t2", "auto", "done", None, "/w", None, None, None, None, None), ("r3", "auto2", "done", "weekly", "/w", "weekly", None, " ", "x", None),
        ("r4", "auto", "done", None, "/x", None, None, "do it", "archived answer", None), ("r5", "auto", "done", None, "/x", None, None, "again", None, None), ("r6", "auto", "done", None, "/x", None, None, "again", None, None), ("t6", "auto", "failed", None, None, None, None, None, None, None),
    ])).close()
    definition = tmp_path / "automations" / "auto2" / "automation.toml"
    definition.parent.mkdir(parents=True)
    definition.write_text('version = 1\nname = "From the file"  # yes\nrrule = "FREQ=WEEKLY"\nmodel = \'m\'\n')
    return tmp_path


def test_rollouts_meet_threads_and_runs(spark, store):
    found = {r.source_session_id: r for r in D.codex_app(spark, str(store)).collect()}
    assert set(found) == {"p", "t1", "t2", "t3", "t4", "t5", "t6"}
    said = {k: [(m.role, m.text, m.provenance.body_source if m.provenance else None) for m in r.messages] for k, r in found.items()}
    assert said["p"] == [("user", "q", None), ("assistant", "a", None)] and found["p"].transcript_completeness is None
    assert said["t1"] == [("developer", "d", "rollout.message"), ("user", "archived question", "automation_runs.archived_user_message"), ("assistant", "a", "rollout.message")]
    assert said["t2"] == [("user", "from the thread", "threads.first_user_message"), ("assistant", "a", None)]
    assert said["t3"] == [("assistant", "only", None)] and said["t4"] == [("user", "do it", None), ("assistant", "archived answer", "automation_runs.archived_assistant_message")]
    assert said["t5"] == [("user", "again", None)] and said["t6"] == [("developer", "d", None)]
    limits = {k: r.limitations for k, r in found.items()}
    assert limits == {"p": None, "t1": [D.USER_SNAPSHOT], "t2": [D.USER_THREAD], "t3": [D.NO_USER], "t4": [D.ASSISTANT_SNAPSHOT], "t5": None, "t6": [D.NO_USER, D.NO_ASSISTANT]}
    assert {k for k, r in found.items() if r.transcript_completeness == "partial"} == {"t1", "t2", "t3", "t4", "t6"}
    origin = {k: json.loads(r.provenance) for k, r in found.items()}
    assert (origin["p"]["conversation_origin"], origin["t5"]["conversation_origin"], origin["t4"]["conversation_origin"]) == ("interactive", "interactive", "automation")
    one, three = origin["t1"]["automation"], origin["t3"]["automation"]
    assert (one["automation_name"], one["schedule"], one["resolved_title"], one["resolved_title_source"], one["resolved_summary"]) == ("Name", "FREQ=DAILY", "run title", "automation_runs.thread_title", "summary")
    assert (three["automation_name"], three["schedule"], three["model"], three["definition_path"]) == ("From the file", "FREQ=WEEKLY", "m", str(store / "automations" / "auto2" / "automation.toml"))
    assert (origin["t1"]["archived"], origin["t1"]["archived_reason"], origin["t1"]["cli_version"], origin["t2"]["cwd"]) == (True, "kept", "1.0", "/w")


def test_rollouts_without_databases(spark, tmp_path):
    rollout(tmp_path, "x", None, None, ("user", "q"))
    (row,) = D.codex_app(spark, str(tmp_path)).collect()
    assert (row.source_session_id, row.source, row.limitations) == ("rollout-x", "codex_app", None)
