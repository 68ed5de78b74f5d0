"""Writing an archive anew: compaction into canonical files, and migration to the current version.

Both say what they would do, and do it only when asked to; both replace files by one
commit (see `swap`), so that a break leaves the archive as it was or as it shall be.  Rows
are carried as their JSON text, so that fields the row model does not know are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import PREVIOUS_SCHEMA_VERSION, SCHEMA_VERSION
from ..operators import checks as C
from ..operators import identity as I
from ..session import checkpointed, shared_folder
from .archive import parsed, read_lines, read_manifests
from .swap import Store, begin, commit, recover, write_parts


@dataclass(frozen=True)
class Plan:
    """What a change does: its mode (dry_run, staging, in_place), and the rows of its report, one for each source."""

    mode: str
    output: str
    sources: list[dict]
    written: dict[str, list[str]] = field(default_factory=dict)
    backup: str | None = None

    def total(self, name: str) -> int:
        return sum(s[name] for s in self.sources)


def canonical_name(source: Column) -> Column:
    return F.concat(F.lit("memory_chat_v1-"), source, F.lit(".jsonl"))


def _rows(spark: SparkSession, root: str, source: str | None) -> DataFrame:
    """Active rows with `payload`, their canonical JSON; a malformed one is an error."""
    rows = parsed(read_lines(spark, root, source)).where(S.is_active(F.col("superseded_at")))
    return rows.withColumn("payload", S.canonical_row(F.col("line")))


def canonical_order(row: str = "") -> list[Column]:
    """The order of rows in a canonical file; unique but for equal rows."""
    at = lambda name: F.col(f"{row}{name}")
    return [at("collected_at"), F.coalesce(at("source_session_id"), F.lit("")), F.coalesce(at("source_artifact_path"), F.lit("")), at("payload")]


def compaction(rows: DataFrame) -> DataFrame:
    """The richest row of each group of rows (with payload), and what the group loses: (source_dir, keys of order, payload, dropped, upgraded).

    A group is upgraded if any of its rows is another than the richest, or none of the equal ones is in a canonical file.
    """
    found = I.candidates(rows).withColumns({"_key": I.group_key(F.col("payload")), "_canonical": C.canonical(F.col("source_dir"), F.col("output_path")), "_hash": F.xxhash64("payload")})
    own = F.struct("collected_at", "source_session_id", "source_artifact_path", "payload", "output_path")
    groups = found.groupBy("source_dir", "_key").agg(F.max_by(own, F.struct("selection", "payload")).alias("row"), F.count("*").alias("n"), (F.min("_hash") != F.max("_hash")).alias("_several"), F.max("_canonical").alias("_canonical"))
    return groups.select("source_dir", "row.*", (F.col("n") - 1).alias("dropped"), (F.col("_several") | ~F.col("_canonical")).alias("upgraded"))


def _report(rows: DataFrame, kept: DataFrame, more: DataFrame | None = None) -> list[dict]:
    """A row for each source: files and rows before, rows after, dropped, upgraded and untouched groups, and whether it changes."""
    files = rows.groupBy("source_dir").agg(F.count_distinct("output_path").alias("input_file_count"), F.count("*").alias("before_conversation_count"), F.min(C.canonical(F.col("source_dir"), F.col("output_path"))).alias("_canonical"))
    made = kept.groupBy("source_dir").agg(F.count("*").alias("after_conversation_count"), F.sum("dropped").alias("dropped_row_count"), F.count_if("upgraded").alias("upgraded_row_count"), F.count_if(~F.col("upgraded")).alias("untouched_row_count"))
    both = files.join(made, "source_dir", "full_outer")
    counts = [c for c in both.columns if c not in ("source_dir", "_canonical")]
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"_canonical": F.coalesce("_canonical", F.lit(True))})
    changed = (F.col("dropped_row_count") > 0) | (F.col("upgraded_row_count") > 0) | ~F.col("_canonical")
    both = both.withColumn("changed", changed).drop("_canonical")
    if more is not None:
        both = both.join(more, "source_dir", "left")
    return [r.asDict() for r in both.orderBy("source_dir").collect()]  # one row a source


def _old(spark: SparkSession, root: str, sources: list[str]) -> dict[str, list[str]]:
    store = Store(spark, root)
    return {s: [n for n in store.names(f"{root}/{s}") if n.endswith((".jsonl", ".txt"))] for s in sources}


def _mode(root: str, output: str | None, execute: bool) -> str:
    return "dry_run" if not execute else "in_place" if output is None or output.rstrip("/") == root.rstrip("/") else "staging"


def _apart(root: str, other: str, what: str) -> None:
    a, b = root.rstrip("/") + "/", other.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"the {what} and the archive must not lie in one another")


def place(spark: SparkSession, root: str, output: str, mode: str, rows: DataFrame, order: list[Column], replaced: list[str], backup: str | None = None, after: Callable[[str], None] = lambda step: None, gate: Callable[[str], None] = lambda folder: None) -> dict[str, list[str]]:
    """Write rows (source_dir, file, line, ...) into the archive in place of all files of the sources, or into another folder; `gate` sees the new files before they count."""
    if mode == "staging":
        aside = f"{output.rstrip('/')}/.swap-{uuid.uuid4().hex}"
        written = write_parts(spark, rows, order, f"{aside}/new")
        gate(f"{aside}/new")
        commit(spark, aside, _old(spark, output, list(written)), written, None, after)
        return written
    change = begin(root)
    written = write_parts(spark, rows, order, f"{change}/new")
    gate(f"{change}/new")
    commit(spark, change, _old(spark, root, replaced), written, backup, after)
    return written


def rewrite(spark: SparkSession, root: str, output: str | None = None, source: str | None = None, execute: bool = False, backup: str | None = None, after: Callable[[str], None] = lambda step: None) -> Plan:
    """Compact the archive: of each group of rows the richest, in canonical order, in the canonical files of each source.

    Without `execute` only the plan is made.  With an output folder the result goes there and the archive
    stays; else changed sources are replaced, and their files kept under `backup` if that is given.  Superseded rows are left out.
    """
    root, mode = root.rstrip("/"), _mode(root, output, execute)
    if backup is not None:
        _apart(root, backup, "backup")
    if execute:
        recover(spark, root)
    rows = _rows(spark, root, source)
    kept = checkpointed(compaction(rows))
    report = _report(rows, kept)
    written: dict[str, list[str]] = {}
    if execute:
        chosen = [r["source_dir"] for r in report if r["changed"] or mode == "staging"]
        new = kept.where(F.col("source_dir").isin(*chosen)).withColumns({"file": canonical_name(F.col("source_dir")), "line": F.col("payload")}) if chosen else None
        if new is not None:
            written = place(spark, root, output or root, mode, new, canonical_order(), chosen, backup, after)
    return Plan(mode, (output or root).rstrip("/"), report, written, backup)


class MigrationError(ValueError):
    """The archive cannot be migrated, or the result does not hold what it must."""


def _refuse(found: DataFrame, why: str) -> None:
    bad = found.orderBy("output_path", "row_number", "code", "what").limit(3).collect()
    if bad:
        raise MigrationError(f"{why}: " + "; ".join(f"{r.output_path}, row {r.row_number}: {r.code} ({r.what})" for r in bad))


def _signatures(lines: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free digest of what migration must not touch: a row's place of origin and its provenance."""
    v = F.try_parse_json("line")
    part = lambda name: F.coalesce(F.to_json(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("null"))
    core = F.xxhash64("source_dir", part("provenance"), part("source_artifact_path"), part("source_session_id"))
    n, total = lines.where(F.trim("line") != "").agg(F.count("*"), F.coalesce(F.sum(core.cast("decimal(38,0)")), F.lit(0))).first()
    return n, int(total)


def migrate(spark: SparkSession, root: str, output: str | None = None, source: str | None = None, execute: bool = False, backup: str | None = None, after: Callable[[str], None] = lambda step: None) -> Plan:
    """Bring rows of the previous contract version to the current one; lines that are current stay as they are, in the same files.

    Gates: rows that break the form in any other way, and unknown versions, are refused before anything is written;
    the new files are read back before they count, and must hold rows without errors, as many, of the same origin and provenance.  In another
    folder the runs' manifests are written too, with their paths led there.  Migrating again changes nothing.
    """
    root, mode = root.rstrip("/"), _mode(root, output, execute)
    if output is not None and mode != "in_place":
        if source is not None:
            raise ValueError("one source alone is not migrated into another folder")
        _apart(root, output, "output folder")
        if backup is not None:
            raise ValueError("a backup is made of an archive that is migrated in place")
    if backup is not None:
        _apart(root, backup, "backup")
    if execute:
        recover(spark, root)
    lines = read_lines(spark, root, source).where(F.trim("line") != "")
    version = C.text(F.try_parse_json("line"), "$.contract.schema_version")
    _refuse(C.row_findings(lines).where(f"level = 'error' and (code <> 'invalid_contract' or what <> '{PREVIOUS_SCHEMA_VERSION}')"), "rows that cannot be migrated")
    staged = lines.withColumn("moved", version != SCHEMA_VERSION).withColumn("file", F.element_at(F.split(C.file_path(F.col("output_path")), "/"), -1))
    counts = staged.groupBy("source_dir").agg(F.count_distinct("file").alias("file_count"), F.count("*").alias("row_count"), F.count_if("moved").alias("migrated_row_count"), F.count_if(~F.col("moved")).alias("unchanged_row_count"))
    report = [r.asDict() | {"changed": mode == "staging" or r.migrated_row_count > 0} for r in counts.orderBy("source_dir").collect()]
    written: dict[str, list[str]] = {}
    chosen = [r["source_dir"] for r in report if r["changed"]]
    if execute and chosen:
        own = staged.where(F.col("source_dir").isin(*chosen))
        before = _signatures(own)

        def gate(folder: str) -> None:
            made = read_lines(spark, folder)
            _refuse(C.row_findings(made).where("level = 'error'"), "migrated rows do not hold")
            if _signatures(made) != before:
                raise MigrationError("migrated rows are not those that were read")

        new = own.withColumn("line", F.when(F.col("moved"), S.with_version(F.col("line"), F.lit(SCHEMA_VERSION))).otherwise(F.col("line")))
        written = place(spark, root, output or root, mode, new, [F.col("row_number")], chosen, backup, after, gate)
        if mode == "staging":
            copy_manifests(spark, root, output.rstrip("/"))
    return Plan(mode, (output or root).rstrip("/"), report, written, backup)


def moved_paths(payload: object, root: str, output: str) -> tuple[object, int]:
    """A manifest whose texts that lie under one root lead to another, and how many there are."""
    if isinstance(payload, dict):
        parts = {k: moved_paths(v, root, output) for k, v in payload.items()}
        return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
    if isinstance(payload, list):
        parts = [moved_paths(v, root, output) for v in payload]
        return [v for v, _ in parts], sum(n for _, n in parts)
    if isinstance(payload, str) and (payload == root or payload.startswith(root + "/")):
        return output + payload[len(root) :], 1
    return payload, 0


def copy_manifests(spark: SparkSession, root: str, output: str) -> int:
    """Write the manifests of an archive's runs into another one, with their paths led there; returns how many paths were."""
    import json

    store, total = Store(spark, output), 0
    for r in read_manifests(spark, root).orderBy("run_id").toLocalIterator():  # one small file a run
        payload, n = moved_paths(json.loads(r.text), root, output)
        store.write(f"{output}/runs/{r.run_id}/manifest.json", payload)
        total += n
    return total


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
