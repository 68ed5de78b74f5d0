"""Bundles: rows of an archive written with a manifest of their counts, and imported only if the two agree.

A bundle is a folder with a manifest and a folder of JSON lines in order, newest first, whose
files are as many as the rows need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import checks as C
from ..operators import identity as I
from ..operators import memory as M
from ..session import checkpointed
from .archive import found_any, parsed, read_archive, read_lines, read_manifests
from .rewrite import Plan, _rows, canonical_name, canonical_order, compaction, place
from .swap import Store, recover

#: Names in a bundle.
MANIFEST, MEMORY_MANIFEST = "export-manifest.json", "memory-export-manifest.json"
ROWS, MEMORY_ROWS = "conversations", "memory-records"
FILTERS = ("source", "session", "transcript_completeness", "text")


class BundleError(ValueError):
    """A bundle is not there, not complete, or not what its manifest says."""


def _matching(rows: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    return A.matching(rows, source=filters["source"], session=filters["session"], completeness=filters["transcript_completeness"], text=filters["text"])


def _ordered_text(rows: DataFrame, folder: str) -> None:
    """Write the lines of rows, newest first, by ranges."""
    newest = A.newest_first()
    rows.repartitionByRange(*newest).sortWithinPartitions(*newest).select(F.col("line").alias("value")).write.text(folder)


def export_bundle(spark: SparkSession, root: str, target: str, execute: bool = False, **filters: str | None) -> dict:
    """The rows that fulfil the filters, as a bundle; returns its manifest.  Without `execute` nothing is written.

    The manifest is written last: a folder without it is no bundle.
    """
    chosen = dict.fromkeys(FILTERS) | filters
    if set(chosen) != set(FILTERS):
        raise TypeError(f"filters are {', '.join(FILTERS)}")
    if chosen["text"] is not None:
        chosen["text"] = chosen["text"].strip()
    rows = _matching(read_archive(spark, root, chosen["source"]), chosen).withColumn("line", S.canonical_json(F.col("line")))
    totals = M.report(rows).first().asDict()
    manifest = {"archive_root": root, "output_dir": target, "write_mode": "write" if execute else "dry_run", "filters": chosen} | {k: totals[k] for k in ("conversation_count", "message_count", "source_count")}
    if execute:
        store = Store(spark, target)
        if store.exists(f"{target}/{MANIFEST}"):
            raise BundleError(f"{target} already holds a bundle")
        store.delete(f"{target}/{ROWS}")
        _ordered_text(rows, f"{target}/{ROWS}")
        store.write(f"{target}/{MANIFEST}", manifest)
    return manifest


def _manifest(spark: SparkSession, bundle: str) -> dict:
    """The manifest of a bundle; anything that it lacks or that is of another kind is an error."""
    store = Store(spark, bundle)
    if not store.exists(f"{bundle}/{MANIFEST}"):
        raise BundleError(f"{bundle} has no manifest")
    try:
        found = store.read(f"{bundle}/{MANIFEST}")
    except ValueError as error:
        raise BundleError(f"the manifest of {bundle} is no JSON") from error
    if not isinstance(found, dict) or found.get("write_mode") != "write" or not isinstance(found.get("filters"), dict):
        raise BundleError(f"the manifest of {bundle} is not that of a written bundle")
    for name in ("conversation_count", "message_count", "source_count"):
        if not isinstance(found.get(name), int) or isinstance(found[name], bool):
            raise BundleError(f"the manifest of {bundle} lacks a whole number for {name}")
    for name in FILTERS:
        if name not in found["filters"] or not isinstance(found["filters"][name], str | None):
            raise BundleError(f"the manifest of {bundle} lacks the filter {name}")
    return found


def read_bundle(spark: SparkSession, bundle: str) -> tuple[DataFrame, dict]:
    """Rows and manifest of a bundle, of which one aggregate has shown that they agree.

    Counts of rows, messages and sources must be those of the manifest, every row must be whole and fulfil its filters, and no row may lack its source.
    """
    manifest = _manifest(spark, bundle)
    if not found_any(spark, f"{bundle}/{ROWS}/*"):
        raise BundleError(f"{bundle} has no rows")
    lines = spark.read.text(f"{bundle}/{ROWS}").select(F.lit("bundle").alias("source_dir"), F.lit(bundle).alias("output_path"), F.monotonically_increasing_id().alias("row_number"), F.col("value").alias("line")).where(F.trim("line") != "")
    rows = parsed(lines, strict=False)
    actual = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("messages")), F.lit(0)), F.count_distinct("source"), F.count_if(F.col("source").isNull() | F.col("messages").isNull())).first()
    if lines.count() != actual[0] or actual[3]:
        raise BundleError(f"{bundle} holds rows that are malformed")
    for name, said, found in zip(("conversation_count", "message_count", "source_count"), (manifest["conversation_count"], manifest["message_count"], manifest["source_count"]), actual, strict=False):
        if said != found:
            raise BundleError(f"{name} of {bundle}: the manifest says {said}, its rows are {found}")
    if _matching(rows, manifest["filters"]).count() != actual[0]:
        raise BundleError(f"{bundle} holds rows that do not fulfil its filters")
    return rows.withColumns({"source_dir": F.col("source"), "payload": S.canonical_row(F.col("line"))}), manifest


def import_bundle(spark: SparkSession, root: str, bundle: str, execute: bool = False, after: Callable[[str], None] = lambda step: None) -> tuple[Plan, DataFrame]:
    """Merge a bundle into an archive; returns the plan and (source, imported, skipped, upgraded), what it changes.

    Nothing is merged from a bundle that does not hold what its manifest says.  Each source that changes is written
    anew, compacted and in canonical order, by one commit; other sources stay.  Importing again changes nothing.
    """
    root = root.rstrip("/")
    rows, _ = read_bundle(spark, bundle)
    if execute:
        recover(spark, root)
    sources = sorted(r.source for r in rows.select("source").distinct().collect())  # one row a source
    has = [s for s in sources if found_any(spark, f"{root}/{s}/*")]
    existing = _rows(spark, root, None).where(F.col("source_dir").isin(*has)) if has else rows.where("false")
    incoming = rows.select(*existing.columns)
    changes = checkpointed(I.import_changes(existing, incoming, F.col("payload")))
    both = existing.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    kept = checkpointed(compaction(both))
    counts = existing.groupBy("source_dir").agg(F.count("*").alias("before_conversation_count"), F.count_distinct("output_path").alias("input_file_count"), F.min(C.canonical(F.col("source_dir"), F.col("output_path"))).alias("_canonical"))
    made = kept.groupBy("source_dir").agg(F.count("*").alias("after_conversation_count"))
    report = made.join(counts, "source_dir", "left").join(changes.withColumnRenamed("source", "source_dir"), "source_dir", "left")
    changed = (F.col("imported") > 0) | (F.col("upgraded") > 0) | ~F.coalesce("_canonical", F.lit(False))
    listed = [r.asDict() for r in report.withColumn("changed", changed).drop("_canonical").na.fill(0).orderBy("source_dir").collect()]
    chosen, written = [r["source_dir"] for r in listed if r["changed"]], {}
    if execute and chosen:
        new = kept.where(F.col("source_dir").isin(*chosen)).withColumns({"file": canonical_name(F.col("source_dir")), "line": F.col("payload")})
        written = place(spark, root, root, "in_place", new, canonical_order(), chosen, None, after)
    return Plan("in_place" if execute else "dry_run", root, listed, written), changes


def rows_of_run(spark: SparkSession, root: str, run_id: str, source: str | None = None) -> DataFrame:
    """Active rows of the files that a run names for their source."""
    manifests = read_manifests(spark, root).where(F.col("run_id") == run_id)
    links = C.manifest_links(manifests, root).where("path is not null")
    if links.isEmpty():
        raise LookupError(f"{root} has no run {run_id} with outputs")
    lines = read_lines(spark, root, source)
    files = C.by_link(lines.select("source_dir", "output_path").distinct(), links).where("manifest_linked").select("output_path")
    rows = parsed(lines.join(files, "output_path", "left_semi")).where(S.is_active(F.col("superseded_at")))
    return rows.where(F.col("source") == F.col("source_dir"))


def export_memory(spark: SparkSession, root: str, target: str, execute: bool = False, run_id: str | None = None, source: str | None = None, after: str | None = None) -> dict:
    """Memory records of the archive's rows, or of those of one run, collected after a moment; returns the manifest, which is written last."""
    rows = rows_of_run(spark, root, run_id, source) if run_id is not None else read_archive(spark, root, source)
    if after is not None:
        rows = M.after(rows, after)
    records = M.memory_records(rows)
    totals = M.report(rows).first().asDict()
    manifest = {"archive_root": root, "output_dir": target, "write_mode": "write" if execute else "dry_run", "filters": {"run_id": run_id, "source": source, "after": after}, "record_count": totals["conversation_count"]} | totals
    if execute:
        store = Store(spark, target)
        if store.exists(f"{target}/{MEMORY_MANIFEST}"):
            raise BundleError(f"{target} already holds a bundle")
        store.delete(f"{target}/{MEMORY_ROWS}")
        _ordered_text(records.withColumn("line", F.to_json(F.struct(*records.columns))), f"{target}/{MEMORY_ROWS}")
        store.write(f"{target}/{MEMORY_MANIFEST}", manifest)
    return manifest
