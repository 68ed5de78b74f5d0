"""Collection runs: collect sources, merge what is new into an archive, and leave a manifest of the run."""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import CONVERSATION, RUN
from ..operators import identity as I
from ..operators.memory import redacted_conversations
from ..session import checkpointed
from .archive import FILES, conversation_names, place_staged, read_archive, read_lines, write_archive
from .collectors import SOURCES, candidates, matching, selected

#: Fixed value: the form of times in an archive.
TIME = "%Y-%m-%dT%H:%M:%SZ"


def mark_superseded(spark: SparkSession, root: str, rows: DataFrame, moment: str) -> None:
    """Rewrite the files that hold the rows (output_path, row_number), with superseded_at set on these; other lines stay as they are.

    All files of all sources go through one job, a large file as several ordered parts.  Lines are
    read once, and put in order before they are changed, so that no line is changed twice.  New files are
    in place before old ones are deleted: after a break between the two, rows stand
    twice, never nowhere, and `identity_audit` shows them.
    """
    marks = rows.select("output_path", "row_number").distinct()
    old = [r.output_path for r in marks.select("output_path").distinct().collect()]
    if not old:
        return
    keys, place = ["source_dir", "output_path", "row_number"], ["output_path", "row_number"]
    lines = read_lines(spark, root, paths=old).join(marks.withColumn("_hit", F.lit(True)), place, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    rows = lines.repartitionByRange(*keys).select(*keys, "line", "_hit", F.from_json(F.when(F.col("_hit"), F.col("line")), CONVERSATION).alias("_row")).select(*keys, "line", "_hit", "_row.*")
    made = rows.withColumn("superseded_at", F.when(F.col("_hit"), F.lit(moment))).select(*keys, "line", "_hit", S.conversation_json(*conversation_names()).alias("_new"))
    ordered = made.sortWithinPartitions(*keys).select("source_dir", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("line")).alias("value"))
    staging = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.staging-{uuid.uuid4().hex}")
    ordered.write.partitionBy("source_dir").text(staging.toString())
    place_staged(spark, root, staging)
    fs = staging.getFileSystem(spark._jsc.hadoopConfiguration())
    for path in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(urllib.parse.unquote(path)), False)


def write_incremental(spark: SparkSession, root: str, source: str, incoming: DataFrame, moment: str) -> dict[str, int]:
    """Merge conversations of one source into the archive, as `write_incremental_sources` does. Returns the counts."""
    return write_incremental_sources(spark, root, incoming, moment).get(source, dict.fromkeys(("conversation_count", "message_count", "written_conversation_count", "upgraded_conversation_count", "skipped_conversation_count"), 0))


def write_incremental_sources(spark: SparkSession, root: str, incoming: DataFrame, moment: str) -> dict[str, dict[str, int]]:
    """Merge conversations of any sources into the archive, all in the same jobs: new rows are appended before those they supersede are marked. Returns the counts by source."""
    placed = incoming.withColumns({"source_dir": F.col("source"), "output_path": F.lit("incoming"), "row_number": F.monotonically_increasing_id()})
    rows = checkpointed(placed)  # their numbers and times must not change between the steps
    totals = rows.groupBy("source").agg(F.count("*").alias("conversation_count"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("message_count"))
    counts = {r.source: r.asDict() for r in totals.collect()}  # one row a source
    held = [s for s in sorted(s for s in counts if s is not None) if matching(spark, [f"{root}/{s}/{FILES}"])]
    existing = read_archive(spark, root, held, strict=False).drop("line") if held else rows.where("false")
    decided = checkpointed(I.incremental_merge(existing, rows.select(*existing.columns), S.message_fingerprint(F.col("messages"))))
    n = {(r.source, r.decision): r["count"] for r in decided.groupBy("source", "decision").count().collect()}
    made = {decision for _, decision in n}
    if made & {"insert", "upgrade"}:
        write_archive(rows.join(decided.where("decision in ('insert', 'upgrade')").select("row_number"), "row_number", "left_semi"), root)
    if "supersede" in made:
        mark_superseded(spark, root, decided.where("decision = 'supersede'"), moment)
    for source, own in counts.items():
        del own["source"]
        new, better, poorer = (n.get((source, decision), 0) for decision in ("insert", "upgrade", "skip"))
        own |= {"written_conversation_count": new + better, "upgraded_conversation_count": better, "skipped_conversation_count": poorer}
    return counts


def write_manifest(spark: SparkSession, root: str, run: dict) -> str:
    """Write the manifest of a run, complete or not at all; returns its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/{run['run_id']}/manifest.json")
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/{run['run_id']}/.manifest-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray(json.dumps(run, indent=2, sort_keys=True).encode()))
    out.close()
    if not fs.rename(part, path):
        raise OSError(f"cannot write {path.toString()}")
    return path.toString()


def collect_batch(spark: SparkSession, root: str, inputs: Mapping[str, str], sources: list[str] | None = None, least_level: str = "scaffold", excluded: tuple[str, ...] = (), redact: bool = True, now: str | None = None) -> DataFrame:
    """Collect the selected sources from their input folders into the archive; returns the run as a row of its manifest.

    A source that fails is noted with its reason and does not stop the others; one
    without a folder or without files counts nothing.  A source is unsupported or partial
    if a row of it is, else as its support level says.  Two runs of one second are an error.
    """
    started = now or datetime.now(UTC).strftime(TIME)
    chosen = selected(sources, least_level, excluded)
    results = []
    for s in chosen:
        result = {"source": s.key, "support_level": s.support_level, "archive_root": root, "output_path": None, "input_roots": [inputs[s.key]] if s.key in inputs else [], "failed": False}
        result |= dict.fromkeys(("scanned_artifact_count", "conversation_count", "message_count", "written_conversation_count", "upgraded_conversation_count", "skipped_conversation_count", "redaction_event_count"), 0)
        low = high = False
        try:
            result["scanned_artifact_count"] = candidates(spark, s, inputs[s.key]) if s.key in inputs else 0
            if result["scanned_artifact_count"]:
                rows = checkpointed(redacted_conversations(s.collect(spark, inputs[s.key]))) if redact else checkpointed(s.collect(spark, inputs[s.key]))
                if redact:
                    result["redaction_event_count"] = rows.agg(F.coalesce(F.sum("redaction_event_count"), F.lit(0))).first()[0]
                result |= write_incremental(spark, root, s.key, rows.drop("redaction_event_count"), started) | {"output_path": f"{root}/{s.key}"}
                low, high = rows.agg(*[F.coalesce(F.bool_or(F.col("transcript_completeness") == c), F.lit(False)) for c in ("partial", "unsupported")]).first()
            if not low and not high:
                low, high = s.support_level == "partial", s.support_level == "scaffold"
        except Exception as error:  # noqa: BLE001 - the run goes on and says why this source did not
            result |= {"failed": True, "failure_reason": f"{type(error).__name__}: {error}"[:2000]}
        status = "failed" if result["failed"] else "unsupported" if high else "partial" if low else "complete"
        results.append(result | {"partial": low, "unsupported": high, "status": status})
    run_id = started.replace("-", "").replace(":", "")
    left_out = [{"source": s.key, "support_level": s.support_level, "reason": "not selected"} for s in SOURCES.values() if s not in chosen]
    run = {"run_id": run_id, "archive_root": root, "run_dir": f"{root}/runs/{run_id}", "manifest_path": f"{root}/runs/{run_id}/manifest.json", "started_at": started, "completed_at": now or datetime.now(UTC).strftime(TIME)}
    write_manifest(spark, root, run | {"selected_sources": [s.key for s in chosen], "excluded_sources": left_out, "sources": results})
    return spark.read.schema(RUN).json(run["manifest_path"], multiLine=True)
