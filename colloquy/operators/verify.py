"""Verification of archive rows against the contract, its roll-ups, quarantine and digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import COMPLETENESS, ROLES, SCHEMA_VERSION

#: Name of a source's compacted file, around the source.
CANONICAL = ("memory_chat_v1-", ".jsonl")
LEVELS = {"success": 0, "warning": 1, "error": 2}


def _finding(level: str, code: str, what: Column | str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(what) if isinstance(what, str) else what).alias("what"))


def findings(conversations: DataFrame) -> DataFrame:
    """One row for each breach of the contract: (source_dir, output_path, row_number, level, code, what).

    Superseded rows are verified too.
    """

    def missing(name: str) -> Column:
        return F.when(F.coalesce(F.trim(name), F.lit("")) == "", _finding("error", "missing_required_field", name))

    version = F.col("contract.schema_version")
    row_checks = [
        missing("source"), missing("collected_at"), missing("execution_context"),
        F.when(F.col("source") != F.col("source_dir"), _finding("error", "invalid_field", "source")),
        F.when(F.col("contract").isNull(), _finding("error", "missing_required_field", "contract")),
        F.when(F.col("contract").isNotNull() & version.isNull(), _finding("error", "missing_required_field", "contract.schema_version")),
        F.when(version != SCHEMA_VERSION, _finding("error", "invalid_contract", version)),
        F.when(~F.col("transcript_completeness").isin(*COMPLETENESS), _finding("error", "invalid_enum", "transcript_completeness")),
        F.when(F.col("transcript_completeness").isin(*COMPLETENESS[1:]), _finding("warning", "incomplete_transcript", F.col("transcript_completeness"))),
        F.when(F.col("messages").isNull(), _finding("error", "missing_required_field", "messages")),
    ]

    def of_message(m: Column) -> Column:
        empty = m["text"].isNull() & m["images"].isNull()
        return F.array_compact(
            F.array(
                F.when(F.coalesce(m["role"], F.lit("")) == "", _finding("error", "missing_required_field", "messages.role")),
                F.when((m["role"] != "") & ~m["role"].isin(*ROLES), _finding("error", "invalid_enum", "messages.role")),
                F.when(empty, _finding("error", "missing_required_field", "messages.text or images")),
                F.when(F.exists(m["images"], lambda i: F.coalesce(i["source"], F.lit("")) == ""), _finding("error", "missing_required_field", "messages.images.source")),
            )
        )

    in_messages = F.coalesce(F.flatten(F.transform("messages", of_message)), F.array().cast("array<struct<level:string,code:string,what:string>>"))
    every = F.concat(F.array_compact(F.array(*row_checks)), in_messages)
    return conversations.select("source_dir", "output_path", "row_number", F.explode(every).alias("f")).select("source_dir", "output_path", "row_number", "f.*")


def malformed(lines: DataFrame) -> DataFrame:
    """Findings of the lines that are no JSON object."""
    bad = F.trim("line").isNotNull() & (F.trim("line") != "") & (F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{"))
    return lines.where(bad).select("source_dir", "output_path", "row_number", F.lit("error").alias("level"), F.lit("malformed_row").alias("code"), F.lit("line").alias("what"))


def orphans(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files (source_dir, output_path) of the archive that no run names and whose name is not the canonical one of their source."""
    linked = sources.where("output_path is not null").select("output_path").distinct()
    canonical = F.concat(F.lit(CANONICAL[0]), F.col("source_dir"), F.lit(CANONICAL[1]))
    return files.join(linked, "output_path", "left_anti").where(F.element_at(F.split("output_path", "/"), -1) != canonical)


def rollup(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of each source: rows, rows with findings, warnings, errors, and the worst level."""
    per_row = found.groupBy("source_dir", "output_path", "row_number").agg(
        F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "error").alias("errors")
    )
    joined = rows.select("source_dir", "output_path", "row_number").join(per_row, ["source_dir", "output_path", "row_number"], "left")
    counts = joined.groupBy("source_dir").agg(
        F.count_distinct("output_path").alias("file_count"), F.count("*").alias("row_count"), F.count_if(F.coalesce("errors", F.lit(0)) > 0).alias("bad_row_count"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_count"), F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
    )
    return counts.withColumn("status", F.when(F.col("error_count") > 0, "error").when(F.col("warning_count") > 0, "warning").otherwise("success"))


def quarantine(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with errors, each with all its findings in order."""
    order = F.array_sort(F.collect_list(F.struct("code", "what", "level")))
    grouped = found.groupBy("output_path", "row_number").agg(order.alias("findings"), F.max(F.col("level") == "error").alias("_error")).where("_error").drop("_error")
    return lines.join(grouped, ["output_path", "row_number"])


def digest(stats: DataFrame, verified: DataFrame, anomalous: DataFrame, latest: DataFrame) -> DataFrame:
    """What needs attention in each source: (source) joined over statistics, verification, anomalies and the latest run."""
    parts = [
        stats.where("source <> '*'").select("source", "conversation_count", "message_count"),
        verified.select(F.col("source_dir").alias("source"), F.col("status").alias("verify_status"), "error_count", "warning_count"),
        anomalous.select("source", "suspicious_conversation_count", "high_unsupported_ratio"),
        latest.select("source", F.col("status").alias("run_status")),
    ]
    both = reduce(lambda a, b: a.join(b, "source", "full_outer"), parts)
    for c in ("conversation_count", "message_count", "error_count", "warning_count", "suspicious_conversation_count"):
        both = both.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    suspicious = (F.col("suspicious_conversation_count") > 0) | F.coalesce("high_unsupported_ratio", F.lit(False))
    attention = F.coalesce(F.col("run_status") != "complete", F.lit(False)) | F.coalesce(F.col("verify_status") != "success", F.lit(False)) | suspicious
    status = F.when((F.col("verify_status") == "error") | (F.col("run_status") == "failed"), "error").when(attention, "warning").otherwise("success")
    return both.withColumns({"attention_required": attention, "status": status})


def overview(digests: DataFrame, stats: DataFrame, orphaned: DataFrame) -> DataFrame:
    """The one row of totals over all sources of a digest; orphaned has a row (source_dir, output_path) for each orphan."""
    whole = stats.where("source = '*'").select("conversation_count", "message_count", "conversation_with_limitations_count", "complete_count", "partial_count", "unsupported_count")
    own = digests.agg(
        F.count("*").alias("source_count"), F.count_if((F.col("suspicious_conversation_count") > 0) | F.coalesce("high_unsupported_ratio", F.lit(False))).alias("suspicious_source_count"),
        F.coalesce(F.sum("suspicious_conversation_count"), F.lit(0)).alias("suspicious_conversation_count"), F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_count"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count"), F.count_if("attention_required").alias("attention_count"),
    )
    lost = orphaned.agg(F.count("*").alias("orphan_file_count"), F.count_distinct("source_dir").alias("sources_with_orphans_count")).withColumn("has_orphans", F.col("orphan_file_count") > 0)
    return own.join(F.broadcast(whole)).join(F.broadcast(lost))  # one row each


def migrated(conversations: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    """Rows with the contract of the current version; all else stays."""
    contract = F.when(F.col("contract").isNull(), F.from_json(F.lit("{}"), conversations.schema["contract"].dataType.simpleString())).otherwise(F.col("contract"))
    return conversations.withColumn("contract", contract.withField("schema_version", F.lit(version)))


def declared_and_actual(sources: DataFrame, conversations: DataFrame) -> DataFrame:
    """Sources of a run whose declared counts are not those of their file, or whose flags contradict their status."""
    actual = conversations.groupBy("output_path").agg(F.count("*").alias("actual_conversations"), F.sum(F.size("messages")).alias("actual_messages"))
    joined = sources.join(actual, "output_path", "left")
    expected = S.expected_status(F.coalesce("failed", F.lit(False)), F.coalesce("unsupported", F.lit(False)), F.coalesce("partial", F.lit(False)))
    codes = F.array_compact(
        F.array(
            F.when(F.col("output_path").isNotNull() & F.col("actual_conversations").isNull(), F.lit("missing_file")),
            F.when(F.col("written_conversation_count") != F.col("actual_conversations"), F.lit("conversation_count_mismatch")),
            F.when(F.col("status") != expected, F.lit("status_mismatch")),
            F.when((F.col("scanned_artifact_count") > 0) & (F.col("conversation_count") == 0), F.lit("drift_suspected")),
        )
    )
    return joined.select("run_id", "source", "output_path", F.explode(codes).alias("code"))
