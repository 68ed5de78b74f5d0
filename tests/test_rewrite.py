"""Archives written anew, migrated, exported and imported; and what a break at any step leaves."""

from __future__ import annotations

import json
import shutil

import pytest

from colloquy.functions import scalars as S
from colloquy.operators import identity as I
from colloquy.sources import bundles as B
from colloquy.sources import rewrite as W
from colloquy.sources.archive import read_archive, read_lines
from colloquy.sources.swap import recover


def row(drop=(), **fields):
    base = {"source": "alpha", "execution_context": "cli", "collected_at": "2024-01-01T00:00:00Z", "contract": {"schema_version": "2026-03-19"}, "messages": [{"role": "user", "text": "Hello"}]}
    return json.dumps({k: v for k, v in (base | fields).items() if k not in drop})


TWO = [{"role": "user", "text": "Hello"}, {"role": "assistant", "text": "Straße"}]


def make(folder):
    (folder / "alpha").mkdir(parents=True)
    (folder / "beta").mkdir()
    (folder / "alpha" / "memory_chat_v1-alpha.jsonl").write_text("\n".join([row(source_session_id="s1"), row(source_session_id="s2", unknown={"b": 1, "a": 2})]) + "\n")
    (folder / "alpha" / "more.jsonl").write_text("\n".join([row(source_session_id="s1", messages=TWO, collected_at="2024-01-02T00:00:00Z"), "", row(source_session_id="s3", superseded_at="2024-01-03T00:00:00Z"), row(), row()]) + "\n")
    (folder / "beta" / "memory_chat_v1-beta.jsonl").write_text(row(source="beta", transcript_completeness="complete", limitations=[]) + "\n")
    return str(folder)


@pytest.fixture
def root(tmp_path):
    return make(tmp_path / "archive")


def texts(spark, root):
    return sorted(r.line for r in read_lines(spark, root).where("line <> ''").collect())


def test_a_plan_writes_nothing(spark, root, tmp_path):
    before = texts(spark, root)
    plan = W.rewrite(spark, root)
    assert plan.mode == "dry_run" and texts(spark, root) == before
    alpha, beta = plan.sources
    assert {k: alpha[k] for k in ("before_conversation_count", "after_conversation_count", "dropped_row_count", "upgraded_row_count", "untouched_row_count", "input_file_count", "changed")} == {
        "before_conversation_count": 5, "after_conversation_count": 3, "dropped_row_count": 2, "upgraded_row_count": 2, "untouched_row_count": 1, "input_file_count": 2, "changed": True,
    }
    assert (beta["changed"], beta["untouched_row_count"]) == (False, 1)


def test_rewriting_in_place_keeps_a_backup_and_is_done_once(spark, root, tmp_path):
    with pytest.raises(ValueError, match="in one another"):
        W.rewrite(spark, root, execute=True, backup=f"{root}/backup")
    old = texts(spark, root)
    plan = W.rewrite(spark, root, execute=True, backup=str(tmp_path / "backup"))
    assert plan.mode == "in_place" and list(plan.written) == ["alpha"]
    rows = [json.loads(r.line) for r in read_lines(spark, root, "alpha").orderBy("output_path", "row_number").collect()]
    assert [(r.get("source_session_id"), r["collected_at"][8:10], len(r["messages"])) for r in rows] == [(None, "01", 1), ("s2", "01", 1), ("s1", "02", 2)]
    assert rows[1]["unknown"] == {"a": 2, "b": 1} and "superseded_at" not in json.dumps(rows)
    assert sorted(texts(spark, str(tmp_path / "backup")) + texts(spark, root)[-1:]) and len(texts(spark, str(tmp_path / "backup"))) == 6
    assert all(line in old for line in texts(spark, str(tmp_path / "backup")))
    assert not any(s["changed"] for s in W.rewrite(spark, root).sources)


def test_rewriting_elsewhere_leaves_the_archive(spark, root, tmp_path):
    before, other = texts(spark, root), str(tmp_path / "other")
    plan = W.rewrite(spark, root, output=other, execute=True)
    assert plan.mode == "staging" and texts(spark, root) == before and sorted(plan.written) == ["alpha", "beta"]
    assert read_archive(spark, other).count() == 4 and not any(s["changed"] for s in W.rewrite(spark, other).sources)


class Break(Exception):
    pass


def test_a_break_leaves_the_old_or_the_new_rows(spark, root, tmp_path):
    steps = []
    shutil.copytree(root, tmp_path / "whole")
    old = texts(spark, root)
    W.rewrite(spark, str(tmp_path / "whole"), execute=True, after=steps.append)
    new = texts(spark, str(tmp_path / "whole"))
    assert steps[:2] == ["prepared", "committed"] and steps[-1] == "done" and len(steps) == 6 and old != new
    for i, step in enumerate(steps):
        own = str(tmp_path / f"broken-{i}")
        shutil.copytree(root, own)

        def stop(at, step=step):
            if at == step:
                raise Break(at)

        with pytest.raises(Break):
            W.rewrite(spark, own, execute=True, after=stop)
        carried = recover(spark, own)
        assert texts(spark, own) == (old if step == "prepared" else new), step
        assert len(carried) == (0 if step in ("prepared", "done") else 1)
        assert recover(spark, own) == [] and not [p for p in (tmp_path / f"broken-{i}").iterdir() if p.name.startswith(".swap")]


def test_large_files_are_several_parts_in_order(spark, tmp_path):
    folder = tmp_path / "archive" / "alpha"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text("\n".join(row(source_session_id=f"s{i:04d}", collected_at=f"2024-01-{1 + i % 28:02d}T00:00:00Z") for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = W.rewrite(spark, str(tmp_path / "archive"), execute=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = plan.written["alpha"]
    assert len(names) > 1 and names == [f"memory_chat_v1-alpha-{i:05d}.jsonl" for i in range(len(names))]
    rows = [json.loads(line) for name in names for line in (folder / name).read_text().splitlines()]
    keys = [(r["collected_at"], r["source_session_id"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 2000
    assert not any(s["changed"] for s in W.rewrite(spark, str(tmp_path / "archive")).sources)


OLD = {"contract": {"schema_version": "2026-03-18", "focus": "x"}}


def test_migration(spark, root, tmp_path):
    folder = tmp_path / "archive" / "beta"
    (folder / "old.jsonl").write_text("\n".join([row(source="beta", provenance={"a": 1}, **OLD), row(source="beta")]) + "\n")
    run = tmp_path / "archive" / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text(json.dumps({"archive_root": root, "sources": [{"output_path": f"{root}/beta", "input_roots": ["/in"]}], "other": f"{root}x"}))
    before = texts(spark, root)
    plan = W.migrate(spark, root)
    assert (plan.mode, plan.total("migrated_row_count"), plan.total("row_count")) == ("dry_run", 1, 9) and texts(spark, root) == before
    other = str(tmp_path / "other")
    assert W.migrate(spark, root, output=other, execute=True).mode == "staging" and texts(spark, root) == before
    moved = json.loads((tmp_path / "other" / "runs" / "r1" / "manifest.json").read_text())
    assert moved == {"archive_root": other, "sources": [{"output_path": f"{other}/beta", "input_roots": ["/in"]}], "other": f"{root}x"}
    assert W.migrate(spark, other).total("migrated_row_count") == 0
    plan = W.migrate(spark, root, execute=True, backup=str(tmp_path / "backup"))
    assert list(plan.written) == ["beta"] and sorted(plan.written["beta"]) == ["memory_chat_v1-beta.jsonl", "old.jsonl"]
    lines = (folder / "old.jsonl").read_text().splitlines()
    assert json.loads(lines[0])["contract"] == {"schema_version": "2026-03-19", "focus": "x"} and lines[1] == row(source="beta")
    assert texts(spark, root) == texts(spark, other)
    steps = []
    W.migrate(spark, root, execute=True, after=steps.append)
    assert steps == []


@pytest.mark.parametrize("bad", ["{broken", row(drop=["messages"]), row(contract={"schema_version": "2020-01-01"}), row(contract={}), row(messages=[{"role": "tool", "text": "x"}])])
def test_what_breaks_the_form_is_not_migrated(spark, root, tmp_path, bad):
    (tmp_path / "archive" / "alpha" / "bad.jsonl").write_text(row(**OLD) + "\n" + bad + "\n")
    before = texts(spark, root)
    with pytest.raises(W.MigrationError, match="bad.jsonl, row 2"):
        W.migrate(spark, root, execute=True)
    assert texts(spark, root) == before


def test_migrations_that_are_refused(spark, root, tmp_path):
    for options, why in (({"output": f"{root}/in"}, "in one another"), ({"output": "/elsewhere", "source": "alpha"}, "one source"), ({"output": "/elsewhere", "backup": "/b"}, "in place"), ({"backup": root}, "in one another")):
        with pytest.raises(ValueError, match=why):
            W.migrate(spark, root, execute=True, **options)


def test_a_bundle_goes_out_and_comes_in(spark, root, tmp_path):
    bundle = str(tmp_path / "bundle")
    dry = B.export_bundle(spark, root, bundle, source="alpha", text=" STRASSE ")
    assert (dry["write_mode"], dry["conversation_count"], dry["message_count"], dry["source_count"], dry["filters"]["text"]) == ("dry_run", 1, 2, 1, "STRASSE") and not (tmp_path / "bundle").exists()
    whole = B.export_bundle(spark, root, bundle, execute=True)
    assert (whole["conversation_count"], whole["message_count"], whole["source_count"]) == (6, 7, 2)
    with pytest.raises(B.BundleError, match="already"):
        B.export_bundle(spark, root, bundle, execute=True)
    target = tmp_path / "target" / "alpha"
    target.mkdir(parents=True)
    (target / "old.jsonl").write_text(row(source_session_id="s1") + "\n" + row(source_session_id="s9") + "\n")
    plan, changes = B.import_bundle(spark, str(tmp_path / "target"), bundle)
    assert plan.mode == "dry_run" and {r.source: (r.imported, r.skipped, r.upgraded) for r in changes.collect()} == {"alpha": (2, 2, 1), "beta": (1, 0, 0)}
    rows, _ = B.read_bundle(spark, bundle)
    existing = read_archive(spark, str(tmp_path / "target")).withColumn("payload", S.canonical_row("line"))
    assert sorted(map(tuple, I.import_changes(existing, rows.select(*existing.columns), existing["payload"]).collect())) == sorted(map(tuple, changes.collect()))
    plan, _ = B.import_bundle(spark, str(tmp_path / "target"), bundle, execute=True)
    assert {s["source_dir"]: (s["before_conversation_count"], s["after_conversation_count"]) for s in plan.sources} == {"alpha": (2, 4), "beta": (0, 1)}
    assert read_archive(spark, str(tmp_path / "target")).count() == 5
    again, changes = B.import_bundle(spark, str(tmp_path / "target"), bundle, execute=True)
    assert again.written == {} and sum(r.imported + r.upgraded for r in changes.collect()) == 0


def test_a_bundle_that_was_tampered_with_is_refused(spark, root, tmp_path):
    B.export_bundle(spark, root, str(tmp_path / "bundle"), execute=True, source="alpha")
    manifest = tmp_path / "bundle" / "export-manifest.json"
    good, part = json.loads(manifest.read_text()), next((tmp_path / "bundle" / "conversations").glob("part-*"))
    changes = [{"conversation_count": 4}, {"message_count": 1}, {"source_count": 2}, {"write_mode": "dry_run"}, {"filters": good["filters"] | {"source": "beta"}}, {"filters": good["filters"] | {"text": "nowhere"}}, {"filters": {}}, {"message_count": True}, {"filters": good["filters"] | {"session": 3}}]
    (tmp_path / "bundle" / ".export-manifest.json.crc").unlink(missing_ok=True)
    for change in changes:
        manifest.write_text(json.dumps(good | change))
        with pytest.raises(B.BundleError):
            B.import_bundle(spark, str(tmp_path / "target"), str(tmp_path / "bundle"), execute=True)
    manifest.write_text("{")
    with pytest.raises(B.BundleError, match="no JSON"):
        B.read_bundle(spark, str(tmp_path / "bundle"))
    manifest.write_text(json.dumps(good))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    lines = part.read_text()
    for broken in (lines + "{bad\n", lines + row() + "\n", lines.replace("alpha", "beta", 1)):
        part.write_text(broken)
        with pytest.raises(B.BundleError):
            B.read_bundle(spark, str(tmp_path / "bundle"))
    manifest.unlink()
    with pytest.raises(B.BundleError, match="no manifest"):
        B.read_bundle(spark, str(tmp_path / "bundle"))
    assert not (tmp_path / "target").exists()


def test_memory_of_one_run(spark, root, tmp_path):
    run = tmp_path / "archive" / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text(json.dumps({"sources": [{"source": "alpha", "output_path": f"{root}/alpha/more.jsonl"}, {"source": "beta", "output_path": f"{root}/beta"}]}))
    assert sorted(r.collected_at[8:10] + r.source for r in B.rows_of_run(spark, root, "r1").collect()) == ["01alpha", "01alpha", "01beta", "02alpha"]
    assert B.rows_of_run(spark, root, "r1", "beta").count() == 1
    with pytest.raises(LookupError):
        B.rows_of_run(spark, root, "r2")
    manifest = B.export_memory(spark, root, str(tmp_path / "memory"), execute=True, run_id="r1", after="2024-01-01T00:00:00")
    assert (manifest["record_count"], manifest["message_count"]) == (1, 2)
    (line,) = spark.read.text(str(tmp_path / "memory" / "memory-records")).collect()
    assert json.loads(line.value)["transcript_text"] == "user: Hello\n\nassistant: Straße"
    assert json.loads((tmp_path / "memory" / "memory-export-manifest.json").read_text())["filters"]["run_id"] == "r1"


def test_lines_reach_python_in_batches_of_bounded_bytes(spark, tmp_path):
    from colloquy.sources.archive import read_lines

    (tmp_path / "src0").mkdir()
    (tmp_path / "src0" / "a.jsonl").write_text('{"a": 1}\n')
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    assert read_lines(spark, str(tmp_path)).count() == 1
    assert spark.conf.get(name) == "4m"
