"""Run history: sources of runs, totals, diff, trend, rerun and pruning plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import COMPLETENESS, STATUSES

COUNTS = ("scanned_artifact_count", "conversation_count", "message_count", "written_conversation_count", "upgraded_conversation_count", "skipped_conversation_count", "redaction_event_count")


def run_sources(runs: DataFrame) -> DataFrame:
    """One row for each source of each run, with the defaults of absent counts."""
    rows = runs.select("run_id", "started_at", "completed_at", F.explode("sources").alias("s")).select("run_id", "started_at", "completed_at", "s.*")
    return rows.withColumns({
        "skipped_conversation_count": F.coalesce("skipped_conversation_count", F.lit(0)), "upgraded_conversation_count": F.coalesce("upgraded_conversation_count", F.lit(0)),
        "written_conversation_count": F.coalesce("written_conversation_count", "conversation_count"), "redaction_event_count": F.coalesce("redaction_event_count", F.lit(0)),
    })


def latest_runs(sources: DataFrame, n: int = 1) -> list[str]:
    """The newest n run ids."""
    return [r.run_id for r in sources.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n).collect()]


def totals(sources: DataFrame) -> DataFrame:
    """Sums of each run, and how many of its sources failed or are degraded."""
    return sources.groupBy("run_id").agg(
        F.count("*").alias("source_count"), *[F.sum(c).alias(c) for c in COUNTS if c in sources.columns],
        F.count_if(F.col("status") == "failed").alias("failed_source_count"), F.count_if(F.col("status").isin("partial", "unsupported")).alias("degraded_source_count"),
    )


def diff(sources: DataFrame, before: str, after: str, counts: tuple[str, ...] = ("conversation_count", "message_count")) -> DataFrame:
    """What changed for each source between two runs; counts of an absent source are 0."""
    if before == after:
        raise ValueError("a run is not compared with itself")
    a = sources.where(F.col("run_id") == before).select("source", F.col("status").alias("from_status"), *[F.col(c).alias(f"from_{c}") for c in counts])
    b = sources.where(F.col("run_id") == after).select("source", F.col("status").alias("to_status"), *[F.col(c).alias(f"to_{c}") for c in counts])
    both = a.join(b, "source", "full_outer")
    for c in counts:
        both = both.withColumn(f"from_{c}", F.coalesce(f"from_{c}", F.lit(0))).withColumn(f"to_{c}", F.coalesce(f"to_{c}", F.lit(0))).withColumn(f"delta_{c}", F.col(f"to_{c}") - F.col(f"from_{c}"))
    presence = F.when(F.col("from_status").isNull(), "added").when(F.col("to_status").isNull(), "removed").otherwise("both")
    return both.withColumns({"presence": presence, "change": S.transition(F.col("from_status"), F.col("to_status"))})


#: What else of a source two runs are compared by.
FACTS = ("support_level", "status", "output_path", "failure_reason")
DIFF_COUNTS = ("scanned_artifact_count", "conversation_count", "message_count", "skipped_conversation_count", "written_conversation_count", "redaction_event_count")


def source_diff(sources: DataFrame, before: str, after: str) -> DataFrame:
    """Each source of two runs: whether it was added, removed, changed or unchanged, and (from, to) of all it is compared by.

    Absent counts are 0, absent facts null.  A transition has a label and a category where both runs have the source, with another status.
    """
    if before == after:
        raise ValueError("a run is not compared with itself")
    own = lambda run, mark: sources.where(F.col("run_id") == run).select("source", F.lit(True).alias(f"_{mark}"), *[F.col(c).alias(f"{mark}_{c}") for c in (*FACTS, *DIFF_COUNTS)])
    both = own(before, "from").join(own(after, "to"), "source", "full_outer")
    both = both.withColumns({f"{m}_{c}": F.coalesce(f"{m}_{c}", F.lit(0)).cast("bigint") for m in ("from", "to") for c in DIFF_COUNTS})
    changed = reduce(lambda a, b: a | b, [~F.col(f"from_{c}").eqNullSafe(F.col(f"to_{c}")) for c in (*FACTS, *DIFF_COUNTS)])
    kind = F.when(F.col("_from").isNull(), "added").when(F.col("_to").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    moved = F.col("from_status") != F.col("to_status")
    rows = both.withColumns({f"delta_{c}": F.col(f"to_{c}") - F.col(f"from_{c}") for c in DIFF_COUNTS})
    label = F.when(moved, F.concat("from_status", F.lit("_to_"), "to_status"))
    return rows.withColumns({"change_type": kind, "changed": changed, "transition": label, "category": S.transition(F.col("from_status"), F.col("to_status"))}).drop("_from", "_to")


def policy_diff(runs: DataFrame, before: str, after: str) -> DataFrame:
    """(kind, change, source, from_entry, to_entry): sources that were selected or no longer are, and excluded ones that came, went, or have another entry.

    Entries are JSON.  No row means that the two runs select alike.
    """
    if before == after:
        raise ValueError("a run is not compared with itself")
    chosen = lambda run: runs.where(F.col("run_id") == run).select(F.explode("selected_sources").alias("source")).distinct()
    left = lambda run, name: runs.where(F.col("run_id") == run).select(F.explode("excluded_sources").alias("e")).groupBy(F.col("e.source").alias("source")).agg(F.max(F.to_json("e")).alias(name))
    selected = chosen(before).withColumn("_a", F.lit(True)).join(chosen(after).withColumn("_b", F.lit(True)), "source", "full_outer")
    selected = selected.withColumn("change", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")).where("change is not null")
    excluded = left(before, "from_entry").join(left(after, "to_entry"), "source", "full_outer")
    change = F.when(F.col("from_entry").isNull(), "added").when(F.col("to_entry").isNull(), "removed").when(F.col("from_entry") != F.col("to_entry"), "changed")
    excluded = excluded.withColumn("change", change).where("change is not null")
    none = F.lit(None).cast("string")
    return selected.select(F.lit("selected").alias("kind"), "change", "source", none.alias("from_entry"), none.alias("to_entry")).unionByName(excluded.select(F.lit("excluded").alias("kind"), "change", "source", "from_entry", "to_entry"))


def trend(sources: DataFrame) -> DataFrame:
    """The timeline of each source: its status before, the change, and the ratios of all statuses so far."""
    order = W.partitionBy("source").orderBy("run_id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.lag("status").over(order)
    rows = sources.withColumns({"previous_status": before, "_n": F.count("*").over(so_far)})
    ratios = {f"{s}_ratio": F.count_if(F.col("status") == s).over(so_far) / F.col("_n") for s in STATUSES}
    rows = rows.withColumns(ratios)
    label = F.when(F.col("previous_status") != F.col("status"), F.concat("previous_status", F.lit("_to_"), "status"))
    degraded = F.col("partial_ratio") + F.col("unsupported_ratio")
    return rows.withColumns({"transition": label, "category": S.transition(F.col("previous_status"), F.col("status")), "degraded_ratio": degraded}).drop("_n")


def trend_summary(timeline: DataFrame) -> DataFrame:
    """Of each source: first and latest run and status, counts of statuses and of changes."""
    return timeline.groupBy("source").agg(
        F.min("run_id").alias("first_run_id"), F.max("run_id").alias("latest_run_id"), F.max_by("status", "run_id").alias("latest_status"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES],
        *[F.count_if(F.col("category") == c).alias(c) for c in ("improved", "regressed", "changed")],
        F.count_if(F.col("previous_status").isin("partial", "unsupported") & (F.col("status") == "complete")).alias("recovered"),
    )


def snapshots(conversations: DataFrame) -> DataFrame:
    """Totals of the active rows of each file (output_path)."""
    known = S.completeness(F.col("transcript_completeness"))
    limited = F.size(F.coalesce("limitations", F.array().cast("array<string>"))) > 0
    return conversations.groupBy("output_path").agg(
        F.count("*").alias("archived_conversations"), F.sum(F.size("messages")).cast("bigint").alias("archived_messages"), *[F.count_if(known == c).alias(f"archived_{c}") for c in COMPLETENESS],
        F.count_if(limited).alias("archived_with_limitations"), F.min("collected_at").alias("earliest_collected_at"), F.max("collected_at").alias("latest_collected_at"),
    )


def with_snapshots(timeline: DataFrame, conversations: DataFrame, files: DataFrame) -> DataFrame:
    """Points of a trend (with output_path) with the totals of the file that each names, as the archive is now.

    A point without a file has a snapshot of zeros; so has one whose file is not among
    `files` (output_path), with snapshot_error; a file without active rows is no error.
    """
    known = files.select("output_path").distinct().withColumn("_there", F.lit(True))
    rows = timeline.join(known, "output_path", "left").join(snapshots(conversations), "output_path", "left")
    lost = F.col("output_path").isNotNull() & F.col("_there").isNull()
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("archived_conversations", "archived_messages", *[f"archived_{c}" for c in COMPLETENESS], "archived_with_limitations")}
    return rows.withColumns(zeros | {"archived_files": F.when(F.col("_there"), 1).otherwise(0), "snapshot_error": F.when(lost, F.concat(F.lit("the file of the run is not there: "), "output_path"))}).drop("_there")


def rerun_plan(sources: DataFrame, run_id: str, reason: str = "failed_or_degraded", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sources of a run to be collected again: by reason, with those named, without those excluded."""
    failed, degraded = F.col("status") == "failed", F.col("status").isin("partial", "unsupported")
    by = {"failed": failed, "degraded": degraded, "failed_or_degraded": failed | degraded}[reason]
    own = sources.where(F.col("run_id") == run_id).select("source", by.alias("by_reason"))
    return own.where((F.col("by_reason") | F.col("source").isin(*include)) & ~F.col("source").isin(*exclude)).select("source", F.when(F.col("by_reason"), reason).otherwise("included").alias("reason"))


def prune_plan(runs: DataFrame, keep_last: int | None = None, older_than_days: int | None = None, now: str | None = None) -> DataFrame:
    """Runs that go: beyond the newest `keep_last` and older than the days; both must hold if both are given."""
    if keep_last is None and older_than_days is None:
        raise ValueError("pruning needs a number of runs or of days")
    moment = F.coalesce(S.lenient_instant(F.col("completed_at")), S.lenient_instant(F.col("started_at")), S.lenient_instant(F.col("run_id")))
    newest = W.orderBy(F.desc("run_id"))
    rows = runs.select("run_id", moment.alias("moment")).withColumn("recency", F.row_number().over(newest))
    goes = F.lit(True)
    if keep_last is not None:
        goes &= F.col("recency") > keep_last
    if older_than_days is not None:
        today = S.lenient_instant(F.lit(now)) if now else F.current_timestamp()
        goes &= F.coalesce(F.col("moment") < today - F.make_dt_interval(F.lit(older_than_days)), F.lit(False))
    return rows.withColumn("pruned", goes)


def selection_diff(sources: DataFrame, before: str, after: str) -> DataFrame:
    """(change, source): sources that the later run selects and the earlier does not, and the other way round."""
    if before == after:
        raise ValueError("a run is not compared with itself")
    a, b = (sources.where(F.col("run_id") == run).select("source").distinct() for run in (before, after))
    return b.exceptAll(a).select(F.lit("added").alias("change"), "source").unionByName(a.exceptAll(b).select(F.lit("removed").alias("change"), "source"))
