"""The archive's row model: one conversation a row, and the closed sets of its values."""

from __future__ import annotations

#: The contract version and the domains of the archive format.
SCHEMA_VERSION = "2026-03-19"
PREVIOUS_SCHEMA_VERSION = "2026-03-18"
COMPLETENESS = ("complete", "partial", "unsupported")
ROLES = ("system", "developer", "user", "assistant")
STATUSES = ("complete", "partial", "unsupported", "failed")
EXCLUDED_ARTIFACTS = ("tool_calls", "mcp_invocation_noise", "internal_reasoning", "execution_artifacts")

MESSAGE = "struct<role:string,text:string,images:array<struct<source:string,mime_type:string>>,timestamp:string,source_message_id:string,provenance:struct<body_source:string,fallback:boolean>>"
CONTRACT = "struct<schema_version:string,archive_kind:string,focus:string,allowed_roles:array<string>,excluded_artifacts:array<string>>"

#: Free-form objects (session_metadata, provenance) are kept as their JSON text.
CONVERSATION = (
    f"source string, execution_context string, collected_at string, messages array<{MESSAGE}>, contract {CONTRACT}, "
    "transcript_completeness string, limitations array<string>, source_session_id string, source_artifact_path string, "
    "session_metadata string, provenance string, superseded_at string"
)
#: Where a row was read: file, and line number from 1.
LOCATION = "source_dir string, output_path string, row_number bigint"

RUN_SOURCE = (
    "struct<source:string,support_level:string,status:string,archive_root:string,output_path:string,input_roots:array<string>,"
    "scanned_artifact_count:bigint,conversation_count:bigint,skipped_conversation_count:bigint,written_conversation_count:bigint,"
    "upgraded_conversation_count:bigint,message_count:bigint,redaction_event_count:bigint,partial:boolean,unsupported:boolean,failed:boolean,"
    "failure_reason:string,support_limitation_summary:string,support_limitations:array<string>>"
)
RUN = (
    "run_id string, archive_root string, run_dir string, manifest_path string, started_at string, completed_at string, "
    "selected_sources array<string>, excluded_sources array<struct<source:string,support_level:string,reason:string>>, "
    f"sources array<{RUN_SOURCE}>"
)
