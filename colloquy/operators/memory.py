"""Exports: subsets, memory records, and the watermark by which an export goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

MARKER = r"\[REDACTED(?:_API_KEY)?\]"


def after(conversations: DataFrame, moment: str) -> DataFrame:
    """Rows collected strictly after the moment, by instant and not by text."""
    return conversations.where(S.instant(F.col("collected_at")) > S.lenient_instant(F.lit(moment)))


def memory_records(conversations: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """One record for each conversation: a stable id, its transcript as text, counts and redaction marks."""
    own = fingerprint if fingerprint is not None else S.message_fingerprint(F.col("messages"))
    key = S.conversation_id(F.col("source"), F.col("source_session_id"), F.col("source_artifact_path"), F.col("collected_at"), own)
    text = S.transcript(F.col("messages"))
    return conversations.select(
        key.alias("conversation_id"), "source", "source_session_id", "collected_at", S.completeness(F.col("transcript_completeness")).alias("transcript_completeness"),
        F.size("messages").alias("message_count"), text.alias("transcript_text"), F.regexp_count(text, F.lit(MARKER)).alias("redaction_count"), "output_path", "row_number",
    )


def message_records(conversations: DataFrame, conversation_id: Column | None = None) -> DataFrame:
    """Messages with their fingerprint, the number of its occurrence in the conversation, and a stable id.

    The id is of the conversation and the message's own id, else of the
    conversation, the fingerprint and its occurrence.
    """
    key = conversation_id if conversation_id is not None else F.lit(None).cast("string")
    rows = conversations.select("output_path", "row_number", key.alias("conversation_id"), F.posexplode("messages").alias("place", "message"))
    rows = rows.select(
        "output_path", "row_number", "conversation_id", (F.col("place") + 1).alias("message_index"), F.col("message.role").alias("role"), F.col("message.text").alias("text"),
        S.identity(F.col("message.source_message_id")).alias("source_message_id"), F.sha2(F.concat_ws("\0", F.col("message.role"), F.coalesce("message.text", F.lit(""))), 256).alias("fingerprint"),
    )
    same = W.partitionBy("output_path", "row_number", "fingerprint").orderBy("message_index")
    rows = rows.withColumn("occurrence", F.row_number().over(same))
    own = F.to_json(F.struct("conversation_id", "source_message_id"))
    by_content = F.to_json(F.struct("conversation_id", F.col("fingerprint").alias("message_fingerprint"), F.col("occurrence").alias("message_occurrence")))
    return rows.withColumn("message_id", F.concat(F.lit("sha256:"), F.sha2(F.when(F.col("source_message_id").isNotNull(), own).otherwise(by_content), 256)))


def report(conversations: DataFrame) -> DataFrame:
    """Totals of an export."""
    return conversations.agg(
        F.count("*").alias("conversation_count"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("message_count"), F.count_distinct("source").alias("source_count"),
        F.min("collected_at").alias("earliest_collected_at"), F.max("collected_at").alias("latest_collected_at"),
    )


def redacted_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations without secrets in texts and metadata, and the number of redactions."""
    events = F.aggregate("messages", F.lit(0), lambda n, m: n + F.coalesce(S.redaction_events(m["text"]), F.lit(0)))
    meta, prov = S.redact_json(F.col("session_metadata")), S.redact_json(F.col("provenance"))
    rows = conversations.withColumns({"_events": events, "_meta": meta, "_prov": prov})
    clean = F.transform("messages", lambda m: m.withField("text", S.redacted(m["text"])))
    return rows.withColumns({
        "messages": clean, "session_metadata": F.col("_meta.value"), "provenance": F.col("_prov.value"),
        "redaction_event_count": F.col("_events") + F.col("_meta.events") + F.col("_prov.events"),
    }).drop("_events", "_meta", "_prov")
