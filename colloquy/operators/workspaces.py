"""Chat indexes of workspaces: their entries joined with session files, what is left over, and transcripts put together from prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Limitations of a row for what a workspace has beside its transcripts, in their order, those of rejected sessions, and those of a transcript from prompts.
NO_TRANSCRIPT, METADATA_ONLY, NEEDS_PROVIDER = "no_confirmed_gemini_code_assist_ide_transcript_store", "metadata_only_ide_state", "chat_session_provider_attribution_required"
REJECTED = {"foreign": "foreign_chat_session_rejected", "unknown": "unknown_chat_session_rejected", "gemini": "gemini_owned_chat_session_body_missing"}
FALLBACK = ("cursor_disk_kv_transcript_not_found", "assistant_body_unverified", "workspace_prompt_cache_not_explicitly_composer_scoped")


def _flag(name: str) -> Column:
    """The field is the JSON value true."""
    return F.coalesce((F.schema_of_variant(F.try_variant_get("e", f"$.{name}", "variant")) == "BOOLEAN") & F.try_variant_get("e", f"$.{name}", "boolean"), F.lit(False))


def index_entries(states: DataFrame) -> DataFrame:
    """(workspace, nth, session_id, is_empty, is_external, has_pending_edits, last_message_at) from (workspace, index): the entries of each index with a session id."""
    rows = states.select("workspace", F.posexplode(F.try_variant_get(F.try_parse_json("index"), "$.entries", "array<variant>")).alias("nth", "e"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("e", path, "variant")) == "STRING", S.identity(F.try_variant_get("e", path, "string")))
    moment = S.epoch_text(F.try_variant_get("e", "$.lastMessageDate", "string"))
    return rows.select("workspace", "nth", text("$.sessionId").alias("session_id"), _flag("isEmpty").alias("is_empty"), _flag("isExternal").alias("is_external"), _flag("hasPendingEdits").alias("has_pending_edits"), moment.alias("last_message_at")).where("session_id is not null")


def index_summary(states: DataFrame) -> DataFrame:
    """(workspace, version, session_count, empty_count, external_count, pending_edits_count, latest_message_at) of each workspace, one without entries too."""
    counts = index_entries(states).groupBy("workspace").agg(
        F.count("*").alias("session_count"), F.count_if("is_empty").alias("empty_count"), F.count_if("is_external").alias("external_count"), F.count_if("has_pending_edits").alias("pending_edits_count"), F.max("last_message_at").alias("latest_message_at"),
    )
    version = F.try_variant_get(F.try_parse_json("index"), "$.version", "bigint")
    rows = states.select("workspace", version.alias("version")).join(counts, "workspace", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("session_count", "empty_count", "external_count", "pending_edits_count")})


def indexed_sessions(states: DataFrame, files: DataFrame) -> DataFrame:
    """Session files (workspace, path, ...) that the index of their workspace names by their stem, with nth, session_id and the composed conversation_id.

    Files that no index names, and entries without a file, are left out.
    """
    entries = index_entries(states).groupBy("workspace", "session_id").agg(F.min("nth").alias("nth"))
    named = files.withColumn("session_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    return named.join(entries, ["workspace", "session_id"]).withColumn("conversation_id", F.concat_ws(":", F.lit("vscode"), "workspace", "session_id"))


def residue(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """(workspace, conversation_id, transcript_count, residue_count, limitations): one row for each workspace that has something left over, or no transcript.

    `sessions` are (workspace, nth, ownership, has_body): a session of the provider with a body is a transcript, any other is
    left over.  Limitations: of the workspace first, then of what is left over, each once, in the order of the index.
    """
    transcript = (F.col("ownership") == "gemini") & F.col("has_body")
    reason = F.when(~transcript, F.coalesce(*[F.when(F.col("ownership") == name, F.lit(code)) for name, code in REJECTED.items()]))
    found = sessions.groupBy("workspace").agg(F.count_if(transcript).alias("transcript_count"), F.count_if(~transcript).alias("residue_count"), F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("nth", reason.alias("code"))))).alias("_left"))
    rows = states.select("workspace").join(found, "workspace", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("transcript_count", "residue_count")})
    nothing = F.col("transcript_count") == 0
    own = F.array_compact(F.array(F.when(nothing, NO_TRANSCRIPT), F.lit(METADATA_ONLY), F.when(nothing & (F.col("residue_count") == 0), NEEDS_PROVIDER)))
    left = F.coalesce(F.transform("_left", lambda x: x["code"]), F.array().cast("array<string>"))
    kept = rows.where((F.col("residue_count") > 0) | nothing)
    return kept.select("workspace", F.concat_ws(":", F.lit("vscode"), "workspace", F.lit("residue")).alias("conversation_id"), "transcript_count", "residue_count", F.array_distinct(F.concat(own, left)).alias("limitations"))


def aligned(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, place, left, right): two lists of a row side by side, by place from 0; what only one of them has meets a null."""
    return rows.select(key, F.posexplode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).alias("place", "z")).select(key, "place", F.col("z.a").alias(left), F.col("z.b").alias(right))


def prompt_messages(rows: DataFrame, key: str) -> DataFrame:
    """(key, messages) from (key, prompts, times): one of the user for each prompt that is not blank, with the time of the generation at its place."""
    placed = F.transform("prompts", lambda p, i: F.struct(S.identity(p).alias("text"), F.get("times", i).alias("timestamp")))
    return rows.select(key, F.filter(placed, lambda m: m["text"].isNotNull()).alias("messages"))


def chosen_transcript(rows: DataFrame) -> DataFrame:
    """Of two reconstructions, (stored, stored_limitations) and (prompts), what a conversation is: messages, source_name, transcript_completeness, limitations.

    The stored one holds if it has any message; else the prompts do, as a partial transcript, with the limitations of a
    fallback first and those of the stored one after, each once.  A row with neither is left out.
    """
    none = F.array().cast("array<string>")
    has = F.coalesce(F.size("stored"), F.lit(0)) > 0
    other = F.coalesce(F.size("prompts"), F.lit(0)) > 0
    told = F.coalesce("stored_limitations", none)
    fallback = F.array_distinct(F.concat(F.array(*map(F.lit, FALLBACK)), told))
    rows = rows.where(has | other)
    return rows.withColumns({
        "messages": F.when(has, F.col("stored")).otherwise(F.col("prompts")), "source_name": F.when(has, "cursor_disk_kv").otherwise("workspace_prompt_cache"),
        "limitations": F.when(has, told).otherwise(fallback), "transcript_completeness": F.when(has & (F.size(told) == 0), "complete").otherwise("partial"),
    }).drop("stored", "stored_limitations", "prompts")
