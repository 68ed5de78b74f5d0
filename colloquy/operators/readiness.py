"""Baseline entries made from reports, readiness of sources, parser drift, and the acceptance gate of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Findings that no baseline may hold, and sources that may be degraded in an accepted run.
NEVER = ("drift_suspected",)
BY_SOURCE = ("degraded_support_level", "degraded_source_status")
MAY_BE_DEGRADED = ("antigravity_editor_view", "cursor", "cursor_editor")

KEY = ("kind", "source", "report", "code", "limitation", "support_level", "status")


def _entries(rows: DataFrame, kind: str, **values: Column | str) -> DataFrame:
    given = {k: F.lit(None).cast("string") for k in KEY} | {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()} | {"kind": F.lit(kind)}
    return rows.select(*[given[k].alias(k) for k in KEY]).distinct()


def finding_entries(found: DataFrame, report: str) -> DataFrame:
    """One entry for each source and code of the warnings of a report; those without a source, drift and degraded sources are left out."""
    own = found.where((F.col("level") == "warning") & F.col("source").isNotNull() & ~F.col("code").isin(*NEVER, *BY_SOURCE))
    return _entries(own, "finding", source="source", report=F.lit(report), code="code")


def degraded_entries(sources: DataFrame) -> DataFrame:
    """One entry for each source of a run whose support level or status is not complete; null counts as complete."""
    lower = {c: F.nullif(F.col(c), F.lit("complete")) for c in ("support_level", "status")}
    return _entries(sources.where(reduce(lambda a, b: a | b, [c.isNotNull() for c in lower.values()])), "degraded_source", source="source", **lower)


def limitation_entries(suspicious: DataFrame) -> DataFrame:
    """One entry for each source and limitation of suspicious conversations."""
    return _entries(suspicious.select("source", F.explode("limitations").alias("limitation")), "limitation", source="source", limitation="limitation")


def merged_policy(policy: DataFrame, entries: DataFrame) -> DataFrame:
    """The policy with the entries that it lacks, and whether each row was added; entries are equal if all of `KEY` is, nulls too."""
    absent = [F.lit(None).cast("string").alias(k) for k in KEY if k not in policy.columns]
    old = policy.select("*", *absent)
    same = [entries[k].eqNullSafe(old[k]) for k in KEY]
    new = entries.dropDuplicates(list(KEY)).join(old, same, "left_anti")
    return old.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)


def parser_drift(counts: DataFrame) -> DataFrame:
    """Adds drift_suspected to rows (source, observed, reconstructed): artifacts were seen, but none gave a conversation."""
    return counts.withColumn("drift_suspected", (F.coalesce("observed", F.lit(0)) > 0) & (F.coalesce("reconstructed", F.lit(0)) == 0))


def readiness(sources: DataFrame) -> DataFrame:
    """Adds status (ready, partial-ready, missing) and status_reason to rows (source, support_level, readable_root_count, observed, reconstructed)."""
    rows = parser_drift(sources)
    rules = (
        (F.coalesce("readable_root_count", F.lit(0)) == 0, "missing", F.lit("no input folder can be read")),
        (F.col("drift_suspected"), "partial-ready", F.lit("artifacts were seen, but no conversation could be read from them")),
        (F.coalesce("observed", F.lit(0)) == 0, "partial-ready", F.lit("the input folders hold no artifact of the source")),
        (F.col("support_level") != "complete", "partial-ready", F.concat(F.lit("there are artifacts, but the support of the source is only "), "support_level")),
    )
    status, reason = F.lit("ready"), F.lit("there are artifacts in folders that can be read")
    for holds, name, why in reversed(rules):
        status, reason = F.when(holds, name).otherwise(status), F.when(holds, why).otherwise(reason)
    return rows.withColumns({"status": status, "status_reason": reason})


def acceptance_findings(sources: DataFrame, may_be_degraded: tuple[str, ...] = MAY_BE_DEGRADED) -> DataFrame:
    """(run_id, source, code): what keeps a run from being accepted; no row means that it passes."""
    failed = F.coalesce("failed", F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.coalesce("scanned_artifact_count", F.lit(0)) <= 0, F.lit("source_missing_artifacts")), F.when(F.coalesce("written_conversation_count", F.lit(0)) <= 0, F.lit("source_no_written_conversations")),
        F.when((F.col("status") != "complete") & ~F.col("source").isin(*may_be_degraded), F.lit("source_unexpected_degraded")),
    ))
    return sources.select("run_id", "source", F.explode(F.when(failed, F.array(F.lit("source_failed"))).otherwise(codes)).alias("code"))
