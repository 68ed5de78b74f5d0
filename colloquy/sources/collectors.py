"""Sources: transcripts of coding agents, read from their stores into conversations.

JSON lines are parsed by built-in VARIANT functions; each file is a conversation
and its lines are put in order by number.  Stores that Spark cannot read (SQLite,
protobuf) go through a small parser for each file in `mapInPandas`.  Parsing is
tolerant: lines and items that do not fit are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..model import CONTRACT, MESSAGE, SCHEMA_VERSION
from ..operators.attribution import near_in_time, unique_best, within_span
from ..operators.workspaces import chosen_transcript, index_summary, indexed_sessions, prompt_messages, residue
from .archive import numbered
from .sqlite_source import tables

#: Item types whose text is kept, and roles of the stores.
TEXT_ITEMS = ("input_text", "output_text", "text")
ROLLOUTS = ("sessions/*/*/*/rollout-*.jsonl", "sessions/rollout-*.jsonl", "sessions/*/rollout-*.jsonl", "archived_sessions/rollout-*.jsonl")
PROJECTS = ("projects/*/*.jsonl", "projects/*/*/subagents/*.jsonl")
WINDSURF = ("memories/*.md", "memories/*/*.md", "memories/*.txt", "rules/*.md", "*/rules/*.md")
IMAGE_FIELDS = ("source", "image_url", "url", "file_path", "path")


@dataclass(frozen=True)
class Source:
    key: str
    execution_context: str
    support_level: str
    collect: Callable[[SparkSession, str], DataFrame]
    #: Where its artifacts lie below the input folder.
    artifacts: tuple[str, ...] = ()


def _get(value: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value if isinstance(value, Column) else F.col(value), path, kind)


def json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, v): the JSON values of all lines that are JSON."""
    reader = spark.read.option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false")
    rows = reader.text(existing(spark, paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"), "value")
    return numbered(rows, "path", "line_no").select("path", F.col("line_no").cast("int").alias("line_no"), F.try_parse_json("value").alias("v")).where("v is not null")


def matching(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match a file, by Spark's file system."""
    jvm = spark.sparkContext._jvm
    found = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            found.append(pattern)
    return found


def candidates(spark: SparkSession, source: Source, root: str) -> int:
    """How many files below the folder are artifacts of the source, by Spark's file system."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}") for pattern in source.artifacts]
    return sum(len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ()) for path in paths)


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match a file; an error if none does."""
    found = matching(spark, patterns)
    if not found:
        raise FileNotFoundError(f"no file matches {', '.join(patterns)}")
    return found


def texts_of(content: Column, types: tuple[str, ...], clean: Callable[[Column], Column] = S.identity) -> Column:
    """Text of a message: itself, or the texts of its items of these types, by blank lines; null if there is none."""
    items = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    parts = F.transform(items, lambda i: clean(F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")).when(F.try_variant_get(i, "$.type", "string").isin(*types), F.try_variant_get(i, "$.text", "string"))))
    listed = F.nullif(F.array_join(F.array_compact(parts), "\n\n"), F.lit(""))
    return F.when(F.schema_of_variant(content) == "STRING", clean(F.try_variant_get(content, "$", "string"))).otherwise(listed)


def message(role: Column, text: Column, images: Column | None = None, timestamp: Column | None = None, id_: Column | None = None) -> Column:
    none = F.lit(None)
    fields = F.struct(role.alias("role"), text.alias("text"), (images if images is not None else none).alias("images"), (timestamp if timestamp is not None else none).alias("timestamp"), (id_ if id_ is not None else none).alias("source_message_id"), none.alias("provenance"))
    return fields.cast(MESSAGE)


def conversations(rows: DataFrame, key: str, context: str, session: Column, provenance: Column | None = None, completeness: Column | None = None, limitations: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Shape rows (path, messages, ...) as conversations, collected now."""
    contract = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("chat").alias("archive_kind"), F.lit(None).alias("focus"), F.lit(None).alias("allowed_roles"), F.lit(None).alias("excluded_artifacts"))
    return rows.select(
        F.lit(key).alias("source"), F.lit(context).alias("execution_context"), S.utc_text(F.current_timestamp()).alias("collected_at"), F.col("messages").cast(f"array<{MESSAGE}>").alias("messages"),
        contract.cast(CONTRACT).alias("contract"), (completeness if completeness is not None else F.lit(None)).cast("string").alias("transcript_completeness"), (limitations if limitations is not None else F.lit(None)).cast("array<string>").alias("limitations"),
        session.alias("source_session_id"), F.col("path").alias("source_artifact_path"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("session_metadata"),
        (provenance if provenance is not None else F.lit(None).cast("string")).alias("provenance"), F.lit(None).cast("string").alias("superseded_at"),
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def by_file(rows: DataFrame, msg: Column, *more: Column) -> DataFrame:
    """Messages of each file in order of lines (those that are null left out), and further aggregates; files without any are left out."""
    ordered = F.array_sort(F.collect_list(F.when(msg["text"].isNotNull() | msg["images"].isNotNull(), F.struct("line_no", msg.alias("m")))), lambda a, b: a["line_no"] - b["line_no"])
    return rows.groupBy("path").agg(F.transform(ordered, lambda x: x["m"]).alias("messages"), *more).where(F.size("messages") > 0)


def rollout_files(spark: SparkSession, root: str, originator: str | None = None) -> DataFrame:
    """(path, messages, meta): rollout files with messages of the three roles, and the last session record; optionally of one originator."""
    rows = json_lines(spark, [f"{root}/{p}" for p in ROLLOUTS])
    kind, payload = _get("v", "$.type"), _get("v", "$.payload", "variant")
    role = _get("v", "$.payload.role")
    text = texts_of(_get("v", "$.payload.content", "variant"), TEXT_ITEMS)
    said = (kind == "response_item") & (_get("v", "$.payload.type") == "message") & role.isin("assistant", "developer", "user")
    msg = F.when(said & text.isNotNull(), message(role, text, None, _get("v", "$.payload.timestamp"), _get("v", "$.payload.id")))
    meta = F.max_by(F.when(kind == "session_meta", F.struct(*[F.try_variant_get(payload, f"$.{c}", "string").alias(c) for c in ("id", "timestamp", "source", "originator", "cwd", "cli_version")])), F.when(kind == "session_meta", F.col("line_no")))
    found = by_file(rows, msg, meta.alias("meta"))
    return found if originator is None else found.where(F.col("meta.originator") == originator)


def rollouts(spark: SparkSession, root: str, key: str = "codex_cli", context: str = "cli", originator: str | None = None) -> DataFrame:
    """Conversations of rollout files."""
    found = rollout_files(spark, root, originator)
    archived = F.col("path").contains("/archived_sessions/")
    provenance = F.to_json(F.struct(F.col("meta.timestamp").alias("session_started_at"), "meta.source", "meta.originator", "meta.cwd", "meta.cli_version", F.when(archived, archived).alias("archived")))
    return conversations(found, key, context, F.coalesce(F.col("meta.id"), stem(F.col("path"))), provenance)


def raw_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, value): all lines, in no order."""
    return spark.read.text(existing(spark, patterns)).select(F.col("_metadata.file_path").alias("path"), "value")


IDE_MARKER = "<command-name>/ide</command-name>"


def without_wrapper(text: Column) -> Column:
    """Trimmed, null if empty or all inside a wrapper of a local command."""
    wrapped = [S.identity(text).startswith(f"<{w}>") & S.identity(text).endswith(f"</{w}>") for w in ("local-command-stdout", "local-command-caveat")]
    return F.when(wrapped[0] | wrapped[1], F.lit(None)).otherwise(S.identity(text))


def ide_marked(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(path) of the files with the editor command's marker in a line as it stands, or in the content of a local command."""
    content = _get("v", "$.message.content", "variant")
    items = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    inside = lambda i: (F.schema_of_variant(i) == "STRING") & F.try_variant_get(i, "$", "string").contains(IDE_MARKER)
    local = (_get("v", "$.type") == "system") & (_get("v", "$.subtype") == "local_command")
    told = rows.where(local & (inside(content) | F.exists(items, inside))).select("path")
    return told.unionByName(lines.where(F.col("value").contains(IDE_MARKER)).select("path")).distinct()


def claude(spark: SparkSession, root: str, key: str = "claude", context: str = "cli", sessions: DataFrame | None = None) -> DataFrame:
    """Project transcripts: user and assistant rows, images of users; subagents are sessions of their parent.

    With `sessions` (session_id), only transcripts of these sessions and those that
    hold the marker of the editor command are kept, without wrappers of local commands.
    """
    patterns = [f"{root}/{p}" for p in PROJECTS]
    rows = json_lines(spark, patterns)
    kind, content = _get("v", "$.type"), _get("v", "$.message.content", "variant")
    text = texts_of(content, ("text",), S.identity if sessions is None else without_wrapper)
    items = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    pictures = F.filter(
        F.transform(F.filter(items, lambda i: F.try_variant_get(i, "$.type", "string") == "image"), lambda i: F.struct(
            F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(i, f"$.{f}", "variant")) == "STRING", F.try_variant_get(i, f"$.{f}", "string")) for f in IMAGE_FIELDS]).alias("source"),
            F.coalesce(F.try_variant_get(i, "$.mime_type", "string"), F.try_variant_get(i, "$.media_type", "string")).alias("mime_type"),
        )), lambda x: x["source"].isNotNull(),
    )
    images = F.when((kind == "user") & (F.size(pictures) > 0), pictures)
    msg = F.when(kind.isin("user", "assistant"), message(kind, text, images, _get("v", "$.timestamp"), F.coalesce(_get("v", "$.uuid"), _get("v", "$.message.id"))))
    first = [F.min_by(_get("v", f"$.{c}"), F.when(_get("v", f"$.{c}").isNotNull(), F.col("line_no"))).alias(c) for c in ("sessionId", "timestamp", "cwd", "agentId")]
    found = by_file(rows, msg, *first)
    parts = F.split("path", "/")
    parent, own = F.element_at(parts, -3), stem(F.col("path"))
    child = F.when(F.col("sessionId") != parent, F.col("sessionId")).otherwise(own)
    session = F.when(F.element_at(parts, -2) == "subagents", F.concat(parent, F.lit("/subagents/"), child)).otherwise(F.coalesce("sessionId", own))
    if sessions is not None:
        asked = F.when(F.element_at(parts, -2) == "subagents", parent).otherwise(F.coalesce("sessionId", own))
        named = sessions.select(F.col("session_id").alias("_asked")).distinct().withColumn("_named", F.lit(True))
        marked = ide_marked(rows, raw_lines(spark, patterns)).withColumn("_marked", F.lit(True))
        found = found.withColumn("_asked", asked).join(named, "_asked", "left").join(marked, "path", "left").where(F.col("_named") | F.col("_marked"))
    provenance = F.to_json(F.struct(F.col("timestamp").alias("session_started_at"), "cwd", F.lit(key).alias("originator")))
    return conversations(found, key, context, session, provenance)


def ide_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session_id) of the history lines that start an editor session; none without a history."""
    if not matching(spark, [f"{root}/history.jsonl"]):
        return spark.createDataFrame([], "session_id string")
    rows = json_lines(spark, [f"{root}/history.jsonl"])
    return rows.where(F.trim(_get("v", "$.display")).startswith("/ide")).select(_get("v", "$.sessionId").alias("session_id")).where("session_id is not null")


@F.pandas_udf(T.StringType())
def nested_text(content: pd.Series) -> pd.Series:
    """All texts of a JSON value, at any depth of text, content and parts, by blank lines."""

    def walk(item: object) -> Iterator[str]:
        if isinstance(item, str):
            yield item.strip()
        elif isinstance(item, list):
            for x in item:
                yield from walk(x)
        elif isinstance(item, dict):
            if isinstance(item.get("text"), str):
                yield item["text"].strip()
            yield from walk(item.get("content"))
            if isinstance(item.get("parts"), list):
                yield from walk(item["parts"])

    def one(raw: str | None) -> str | None:
        try:
            return "\n\n".join(t for t in walk(json.loads(raw)) if t) or None
        except (TypeError, ValueError):
            return None

    return content.map(one)


def json_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, v) of files that hold one JSON value each."""
    rows = spark.read.option("wholetext", "true").text(existing(spark, patterns))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")).where("v is not null")


def _listed(rows: DataFrame, path: str, roles: dict[str, str], role_field: str, fields: tuple[str, str, str]) -> DataFrame:
    """(path, line_no, v, m): the messages of a list in a JSON file."""
    text_field, time_field, id_field = fields
    items = rows.select("path", "v", F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias("line_no", "item"))
    role = F.coalesce(*[F.when(_get("item", f"$.{role_field}") == a, F.lit(b)) for a, b in roles.items()])
    text = nested_text(F.to_json(_get("item", f"$.{text_field}", "variant")))
    return items.withColumn("m", F.when(role.isNotNull() & text.isNotNull(), message(role, text, None, _get("item", f"$.{time_field}"), _get("item", f"$.{id_field}"))))


def gemini(spark: SparkSession, root: str, repository: str | None = None) -> DataFrame:
    """Chat files of the projects, or of the one project named by the sha256 of its path."""
    project = spark.range(1).select(F.sha2(F.lit(repository), 256).alias("h")).first().h if repository else "*"
    rows = _listed(json_files(spark, [f"{root}/tmp/{project}/chats/session-*.json"]), "$.messages", {"user": "user", "gemini": "assistant"}, "type", ("content", "timestamp", "id"))
    found = by_file(rows, F.col("m"), F.any_value(_get("v", "$.sessionId")).alias("session"), F.any_value(_get("v", "$.startTime")).alias("started"))
    provenance = F.to_json(F.struct(F.col("started").alias("session_started_at"), F.lit("cli").alias("source"), F.lit("gemini_cli").alias("originator"), F.lit(repository).alias("cwd")))
    return conversations(found, "gemini", "cli", F.coalesce("session", stem(F.col("path"))), provenance)


def key_values(spark: SparkSession, patterns: list[str], table: str, keys: tuple[str, ...] | None = None, beginning: str | None = None) -> DataFrame:
    """(path, key, value): rows of a key/value table in SQLite files; a missing table gives none.

    Keys, or their beginning, that are asked for are looked up in the files.
    """
    rows = tables(spark, found_paths(spark, existing(spark, patterns)), table, "key string, value string")
    rows = rows if keys is None else rows.where(F.col("key").isin(*keys))
    return rows if beginning is None else rows.where(F.col("key").startswith(beginning))


def found_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files of the patterns, by Spark's file system, without repeats, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [(p := path(pattern)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or () for pattern in patterns]
    return sorted({s.getPath().toUri().toString() for some in found for s in some if s.isFile()})


#: Where the body of a bubble is looked for, in order.
BODY_PATHS = (
    "text", "markdown", "markdownText", "body.text", "body.markdown", "body.content", "body.value", "content.text", "content.markdown", "content.content", "content.value",
    "message.text", "message.markdown", "message.content", "message.value", "richText.text", "richText.markdown", "richText.content", "body", "content", "message",
)


def bubble_body(body: Column) -> Column:
    """(text, body_source) of the first place of a bubble that holds a text which is not blank; null without any."""
    held = lambda path: S.identity(F.when(F.schema_of_variant(_get(body, f"$.{path}", "variant")) == "STRING", _get(body, f"$.{path}")))
    return F.coalesce(*[F.when(held(path).isNotNull(), F.struct(held(path).alias("text"), F.lit(f"cursor_disk_kv.{path}").alias("body_source"))) for path in BODY_PATHS])


def cursor_editor(spark: SparkSession, root: str) -> DataFrame:
    """Editor chats: the headers of a composer in order, each joined with its bubble; bubbles without text are left out."""
    base = f"{root}/User/globalStorage/state.vscdb"
    of = lambda beginning: key_values(spark, [base], "cursorDiskKV", beginning=beginning).withColumn("v", F.try_parse_json("value")).where("v is not null")
    headers = of("composerData:").select("path", F.substring_index("key", ":", -1).alias("composer"), F.posexplode(F.try_variant_get("v", "$.fullConversationHeadersOnly", "array<variant>")).alias("line_no", "header"))
    headers = headers.select("path", "composer", "line_no", _get("header", "$.bubbleId").alias("bubble"), _get("header", "$.type", "int").alias("kind"))
    bubbles = of("bubbleId:").select("path", F.split("key", ":")[1].alias("composer"), F.split("key", ":")[2].alias("bubble"), F.col("v").alias("body"))
    joined = headers.join(bubbles, ["path", "composer", "bubble"], "left")
    joined = joined.withColumn("said", bubble_body(F.col("body")))
    text = F.col("said.text")
    role = F.when(F.col("kind") == 1, "user").when(F.col("kind") == 2, "assistant")
    msg = F.when(role.isNotNull() & text.isNotNull(), message(role, text, None, S.epoch_text(_get("body", "$.createdAt")), F.col("bubble")).withField("provenance", F.struct(F.col("said.body_source").alias("body_source"), F.lit(False).alias("fallback"))))
    ordered = F.array_sort(F.collect_list(F.when(msg["text"].isNotNull(), F.struct("line_no", msg.alias("m")))), lambda a, b: a["line_no"] - b["line_no"])
    stored = joined.groupBy("composer").agg(F.min("path").alias("path"), F.transform(ordered, lambda x: x["m"]).alias("stored"), F.count_if(F.col("body").isNull()).alias("missing"))
    stored = stored.withColumn("stored_limitations", F.when(F.col("missing") > 0, F.array(F.lit("bubbles without a body"))))
    if matching(spark, [f"{root}/{WORKSPACE_STATE}"]):
        asked = workspace_sessions(spark, root).groupBy("composer").agg(F.min_by(F.struct("workspace", "prompts", "times"), "workspace").alias("w")).select("composer", "w.*")
        said = prompt_messages(asked, "composer").select("composer", F.transform("messages", lambda m: message(F.lit("user"), m["text"], None, m["timestamp"])).alias("prompts"))
        both = stored.join(said.join(asked.select("composer", "workspace"), "composer"), "composer", "full_outer")
    else:
        both = stored.withColumns({"prompts": F.lit(None).cast(f"array<{MESSAGE}>"), "workspace": F.lit(None).cast("string")})
    chosen = chosen_transcript(both.withColumn("stored", F.col("stored").cast(f"array<{MESSAGE}>")))
    placed = chosen.withColumn("path", F.concat(F.when(F.col("source_name") == "cursor_disk_kv", F.col("path")).otherwise(F.col("workspace")), F.lit("#"), "composer"))
    whole = F.col("transcript_completeness") == "complete"
    provenance = F.to_json(F.struct(F.lit("ide").alias("source"), F.lit("cursor_editor").alias("originator"), "source_name"))
    return conversations(placed, "cursor_editor", "ide", F.col("composer"), provenance, F.when(~whole, F.col("transcript_completeness")), F.when(F.size("limitations") > 0, F.col("limitations")))


#: Where a chat session names its provider, and parts of the names of providers.
PROVIDER_PATHS = (
    "$.responderUsername", "$.provider", "$.providerId", "$.responder.provider", "$.responder.extensionId",
    "$.selectedModel.metadata.extension.value", "$.selectedModel.metadata.extension.id", "$.selectedModel.metadata.extensionId", "$.selectedModel.metadata.provider",
    "$.metadata.extension.value", "$.metadata.extension.id", "$.metadata.extensionId", "$.metadata.provider",
)
GEMINI_MARKERS = ("gemini", "google.geminicodeassist", "cloudcode.gemini")
FOREIGN_MARKERS = ("copilot", "claude", "cursor", "openai.chatgpt")


def provider_candidates(v: Column) -> Column:
    """The distinct names of providers in a chat session, in the order of the paths; values that are no text are left out."""
    named = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.array_distinct(F.array_compact(F.array(*[named(p) for p in PROVIDER_PATHS])))


def provider_class(candidates: Column) -> Column:
    """Struct (provider, candidate, reason): gemini if any name has one of its marks, else foreign, else unknown; case does not matter."""

    def first_with(marks: tuple[str, ...]) -> Column:
        return F.get(F.filter(candidates, lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(m) for m in marks])), F.lit(0))

    def is_(provider: str, candidate: Column, reason: str) -> Column:
        return F.struct(F.lit(provider).alias("provider"), candidate.alias("candidate"), F.lit(reason).alias("reason"))

    gemini, foreign, any_ = first_with(GEMINI_MARKERS), first_with(FOREIGN_MARKERS), F.get(candidates, F.lit(0))
    return (
        F.when(gemini.isNotNull(), is_("gemini", gemini, "explicit_gemini_provider_marker")).when(foreign.isNotNull(), is_("foreign", foreign, "explicit_foreign_provider_marker"))
        .when(any_.isNotNull(), is_("unknown", any_, "provider_candidate_unrecognized")).otherwise(is_("unknown", any_, "provider_candidate_missing"))
    )


def chat_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(path, ownership, messages, session) of every chat session file; messages are empty where none has a text.

    Each request gives a user message and its response an assistant message.
    """
    rows = json_files(spark, [f"{root}/User/workspaceStorage/*/chatSessions/*.json"]).withColumn("ownership", provider_class(provider_candidates(F.col("v")))["provider"])
    turns = rows.select("path", F.posexplode(F.try_variant_get("v", "$.requests", "array<variant>")).alias("n", "item"))
    sides = turns.select("path", F.explode(F.array(*[
        F.struct((F.col("n") * 2 + k).alias("line_no"), F.lit(role).alias("role"), F.to_json(F.try_variant_get("item", f"{p}.message", "variant")).alias("raw"), _get("item", f"{p}.timestamp").alias("at"), _get("item", f"{p}.{i}").alias("id"))
        for k, (role, p, i) in enumerate((("user", "$", "requestId"), ("assistant", "$.response", "responseId")))
    ])).alias("s")).select("path", "s.*")
    text = nested_text(F.col("raw"))
    said = by_file(sides.withColumn("m", F.when(text.isNotNull(), message(F.col("role"), text, None, S.epoch_text(F.col("at")), F.col("id")))), F.col("m"))
    found = rows.select("path", "ownership", _get("v", "$.sessionId").alias("session")).join(said, "path", "left")
    return found.withColumn("messages", F.coalesce("messages", F.array().cast(f"array<{MESSAGE}>")))


def code_assist(spark: SparkSession, root: str) -> DataFrame:
    """Chat sessions of the editor that name the provider; where workspaces have a state, those that its index names, and a row for what each has left over.

    A workspace whose state says nothing of the provider's views gives no rows, whatever its index names.
    """
    if matching(spark, [f"{root}/{WORKSPACE_STATE}"]):
        return workspace_rows(spark, root)
    found = chat_sessions(spark, root).where("ownership = 'gemini' and size(messages) > 0")
    return conversations(found, "gemini_code_assist_ide", "ide", F.coalesce("session", stem(F.col("path"))))


#: Where the state of a workspace lies, the key of its chat index, and the keys that tell of the provider's views.
WORKSPACE_STATE = "User/workspaceStorage/*/state.vscdb"
INDEX_KEY = "chat.ChatSessionStore.index"
VIEW_KEYS = (
    "workbench.view.extension.geminiChat.state", "workbench.view.extension.geminiOutline.state", "memento/webviewView.cloudcode.gemini.chatView", "workbench.view.extension.geminiChat.numberOfVisibleViews",
)


def workspace_rows(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts that the index of a workspace names, and one row without messages for what it has left over or if it has no transcript."""
    name = lambda path, n: F.element_at(F.split(path, "/"), n)
    stored = key_values(spark, [f"{root}/{WORKSPACE_STATE}"], "ItemTable", (INDEX_KEY, *VIEW_KEYS)).withColumn("workspace", name("path", -2))
    states = stored.groupBy("workspace").agg(F.min("path").alias("state_path"), F.max(F.when(F.col("key") == INDEX_KEY, F.col("value"))).alias("index"), F.count_if(F.col("key") != INDEX_KEY).alias("_views")).where("_views > 0")
    folders = matching(spark, [f"{root}/User/workspaceStorage/*/workspace.json"])
    if folders:
        folder = json_files(spark, folders).select(name("path", -2).alias("workspace"), F.coalesce(S.uri_path(F.when(_get("v", "$.folder").startswith("file:"), _get("v", "$.folder"))), _get("v", "$.folder")).alias("folder"))
        states = states.join(folder.groupBy("workspace").agg(F.min("folder").alias("folder")), "workspace", "left")
    else:
        states = states.withColumn("folder", F.lit(None).cast("string"))
    if not matching(spark, [f"{root}/User/workspaceStorage/*/chatSessions/*.json"]):
        files = spark.createDataFrame([], f"workspace string, path string, ownership string, messages array<{MESSAGE}>")
    else:
        files = chat_sessions(spark, root).withColumn("workspace", name("path", -3)).drop("session")
    sessions = indexed_sessions(states, files).withColumn("has_body", F.size("messages") > 0)
    # What the index says of a workspace goes with each of its rows.
    summary = index_summary(states).select("workspace", F.struct(F.col("version").alias("chat_session_index_version"), *[F.col(c).alias(f"chat_session_{c}") for c in ("session_count", "empty_count", "external_count", "pending_edits_count")], "latest_message_at").alias("_index"))
    owned = sessions.groupBy("workspace").agg(*[F.count_if(F.col("ownership") == o).alias(f"{o}_chat_session_count") for o in ("gemini", "foreign", "unknown")])
    facts = states.select("workspace", "state_path", "folder").join(summary, "workspace").join(owned, "workspace", "left")
    of_index = ("chat_session_index_version", *[f"chat_session_{c}" for c in ("session_count", "empty_count", "external_count", "pending_edits_count")], "latest_message_at")
    of_workspace = [F.col("workspace").alias("workspace_id"), F.col("folder").alias("workspace_folder"), *[F.col("_index")[c].alias(c) for c in of_index], *[f"{o}_chat_session_count" for o in ("gemini", "foreign", "unknown")]]
    provenance = lambda origin: F.to_json(F.struct(F.lit("vscode").alias("source"), F.lit("google.geminicodeassist").alias("originator"), F.col("folder").alias("cwd"), F.lit(origin).alias("conversation_origin")))

    def shaped(rows: DataFrame, origin: str, scope: str, *more: Column) -> DataFrame:
        described = rows.withColumn("_meta", F.to_json(F.struct(F.lit(scope).alias("scope"), *of_workspace, *more)))
        return conversations(described, "gemini_code_assist_ide", "ide", F.col("conversation_id"), provenance(origin), F.col("completeness"), F.col("limitations"), F.col("_meta"))

    told = sessions.where("ownership = 'gemini' and has_body").join(facts, "workspace").withColumns({"completeness": F.lit(None).cast("string"), "limitations": F.lit(None).cast("array<string>")})
    left = residue(states, sessions).join(facts, "workspace").withColumns({"path": F.col("state_path"), "messages": F.array().cast(f"array<{MESSAGE}>"), "completeness": F.lit("unsupported")})
    return shaped(told, "workspace_chat_session", "chat_session", F.col("session_id").alias("chat_session_id")).unionByName(shaped(left, "workspace_chat_session_residue", "workspace_state_residue", F.col("transcript_count").alias("transcript_chat_session_count"), F.col("residue_count").alias("metadata_only_chat_session_residue_count")))


def windsurf(spark: SparkSession, root: str) -> DataFrame:
    """Memories and rule files, each a conversation with one message; the front matter of rules goes to the metadata."""
    files = spark.read.option("wholetext", "true").text(existing(spark, [f"{root}/{p}" for p in WINDSURF]))
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = S.identity(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", ""))
    rule = F.col("path").contains("/rules/")
    rows = rows.withColumns({"messages": F.array(message(F.when(rule, "system").otherwise("assistant"), body)), "_body": body}).where("_body is not null")
    pairs = F.filter(F.split(front, "\n"), lambda x: x.contains(":") & ~F.trim(x).startswith("#"))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))
    metadata = F.to_json(F.struct(F.when(rule, "rule").otherwise("memory").alias("scope"), F.when(front != "", fields).alias("frontmatter")))
    return conversations(rows, "windsurf_editor", "ide", stem(F.col("path")), metadata=metadata)


LOG_KEYS = ("argv", "logsPath", "headless", "verbose", "status", "trace", "list-extensions", "show-versions")


def cursor_invocations(spark: SparkSession, root: str) -> DataFrame:
    """(path, payload, session, invoked): the first line of each command log that holds a known key, and the name and time of its log folder."""
    rows = json_lines(spark, [f"{root}/logs/*/cli.log"])
    known = F.coalesce(*[_get("v", f"$['{k}']", "variant") for k in LOG_KEYS]).isNotNull()
    found = rows.where(known).groupBy("path").agg(F.min_by(F.to_json("v"), "line_no").alias("payload"))
    folder = F.element_at(F.split("path", "/"), -2)
    named = F.nullif(F.regexp_extract(F.get_json_object("payload", "$.logsPath"), r"([^/]*)/*$", 1), F.lit(""))
    time = lambda slug: F.unix_seconds(F.when(slug.rlike(r"^\d{8}T\d{6}$"), S.lenient_instant(slug)))
    return found.withColumns({"session": F.coalesce(named, folder), "invoked": F.coalesce(time(named), time(folder))})


#: Seconds by which an invocation may lie outside a session that has a transcript, and from the last activity of one that has prompts only.
ATTRIBUTION_SLACK = 120
ACTIVITY_WINDOW = 600


def _items(value: Column, path: str, kind: str = "variant") -> Column:
    return F.coalesce(F.try_variant_get(value, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def workspace_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The chosen composer of each workspace that has prompts, with its prompts, times of generations, and span.

    Chosen is the last focused, else a selected, else the only composer.
    """
    keys = ("composer.composerData", "aiService.prompts", "aiService.generations")
    states = key_values(spark, [f"{root}/User/workspaceStorage/*/state.vscdb"], "ItemTable", keys)
    wide = states.groupBy(F.col("path").alias("workspace")).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in zip(keys, ("c", "p", "g"), strict=True)])
    wide = wide.select("workspace", *[F.try_parse_json(n).alias(n) for n in ("c", "p", "g")])
    time = lambda i, name: S.epoch_text(F.try_variant_get(i, f"$.{name}", "string"))
    composers = F.filter(F.transform(_items(F.col("c"), "$.allComposers"), lambda i: F.struct(
        F.try_variant_get(i, "$.composerId", "string").alias("id"), time(i, "createdAt").alias("created"), time(i, "lastUpdatedAt").alias("updated"),
    )), lambda x: x["id"].isNotNull())
    ids = F.array_distinct(F.transform("composers", lambda x: x["id"]))
    asked = F.filter(F.concat(_items(F.col("c"), "$.lastFocusedComposerIds", "string"), _items(F.col("c"), "$.selectedComposerIds", "string")), lambda w: F.array_contains("ids", w))
    prompts = F.array_compact(F.transform(_items(F.col("p"), "$"), lambda i: S.identity(F.try_variant_get(i, "$.text", "string"))))
    made = F.filter(_items(F.col("g"), "$"), lambda i: F.schema_of_variant(i).startswith("OBJECT") & F.coalesce(F.try_variant_get(i, "$.type", "string") == "composer", F.lit(True)))
    rows = wide.withColumns({"composers": composers, "prompts": prompts, "times": F.transform(made, lambda i: time(i, "unixMs"))}).withColumn("ids", ids)
    rows = rows.withColumn("composer", F.coalesce(F.get(asked, F.lit(0)), F.when(F.size("ids") == 1, F.get("ids", F.lit(0))))).where(F.col("composer").isNotNull() & (F.size("prompts") > 0))
    own = F.try_element_at(F.filter("composers", lambda x: x["id"] == F.col("composer")), F.lit(-1))
    rows = rows.withColumn("own", own).withColumn("active", F.coalesce(F.try_element_at(F.filter("times", lambda t: t.isNotNull()), F.lit(-1)), "own.updated", "own.created"))
    created, updated, active = (F.unix_seconds(S.lenient_instant(F.col(c))) for c in ("own.created", "own.updated", "active"))
    rows = rows.withColumns({"active_s": active, "start_s": F.coalesce(created, active, updated), "end_s": F.greatest(F.coalesce(created, active, updated), F.coalesce(active, updated, created))})
    return rows.select("workspace", "composer", "prompts", "times", "active", "active_s", "start_s", "end_s")


def composer_transcripts(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """(composer, said, users_missing, assistants_missing) of the sessions' composers: texts in order of headers, with the ordinal among the assistant's."""
    base = matching(spark, [f"{root}/User/globalStorage/state.vscdb"])
    if not base:
        return spark.createDataFrame([], "composer string, said array<struct<line_no:int,role:string,text:string,ordinal:int>>, users_missing bigint, assistants_missing bigint")
    of = lambda beginning: key_values(spark, base, "cursorDiskKV", beginning=beginning).withColumn("v", F.try_parse_json("value"))
    own = of("composerData:").withColumn("composer", F.substring_index("key", ":", -1)).join(sessions.select("composer").distinct(), "composer", "left_semi")
    headers = own.select("composer", F.posexplode(_items(F.col("v"), "$.fullConversationHeadersOnly")).alias("line_no", "header"))
    headers = headers.select("composer", "line_no", _get("header", "$.bubbleId").alias("bubble"), _get("header", "$.type", "int").alias("kind")).where("bubble is not null and kind in (1, 2)")
    bubbles = of("bubbleId:").select(F.split("key", ":")[1].alias("composer"), F.split("key", ":")[2].alias("bubble"), F.col("v").alias("body"))
    tool = F.to_json(_get("body", "$.toolFormerData", "variant"))
    joined = headers.join(bubbles, ["composer", "bubble"], "left").select("composer", "line_no", "kind", S.identity(_get("body", "$.text")).alias("text"), F.coalesce(tool.rlike(r"^[{\[]") & ~tool.isin("{}", "[]"), F.lit(False)).alias("tool"))
    told = F.col("text").isNotNull()
    before = W.partitionBy("composer").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    ranked = joined.withColumn("ordinal", F.count_if((F.col("kind") == 2) & told).over(before).cast("int"))
    item = F.when(told, F.struct("line_no", F.when(F.col("kind") == 1, "user").otherwise("assistant").alias("role"), "text", "ordinal"))
    return ranked.groupBy("composer").agg(
        F.array_sort(F.collect_list(item)).alias("said"), F.count_if((F.col("kind") == 1) & ~told).alias("users_missing"), F.count_if((F.col("kind") == 2) & ~told & ~F.col("tool")).alias("assistants_missing")
    )


def cursor_attributed(spark: SparkSession, root: str, calls: DataFrame) -> DataFrame:
    """(path, strategy, workspace, composer, prompts, active, messages, users_missing, assistants_missing) of the invocations that one session fits best.

    A session with a transcript that says all its prompts comes first, by its
    span; else a session gives its prompts as evidence only, by its last activity.
    """
    sessions = workspace_sessions(spark, root)
    rows = sessions.join(composer_transcripts(spark, root, sessions), "composer", "left")
    users = F.transform(F.filter("said", lambda m: m["role"] == "user"), lambda m: m["text"])
    said = F.transform("said", lambda m: message(m["role"], m["text"], None, F.when(m["role"] == "assistant", F.get("times", m["ordinal"] - 1))))
    rows = rows.withColumns({"messages": said, "overlaps": F.coalesce((F.size("said") > 0) & (F.size(F.array_except("prompts", users)) == 0), F.lit(False))})
    timed = calls.select("path", "invoked").where("invoked is not null")
    spans = rows.where("overlaps and start_s is not null").select("workspace", "start_s", "end_s", "active_s")
    pairs = within_span(timed, spans, [], "invoked", "start_s", "end_s", ATTRIBUTION_SLACK)
    t = F.col("invoked")
    score = F.struct((~t.between(F.col("start_s"), F.col("end_s"))).cast("int"), F.abs(t - F.col("start_s")), F.abs(F.coalesce("active_s", "end_s") - t))
    whole = unique_best(pairs, "path", score).select("path", "workspace", F.lit("prompt_overlap_plus_time_window").alias("strategy"))
    active = rows.where("active_s is not null").select("workspace", "active_s")
    close = near_in_time(timed.join(whole, "path", "left_anti"), active, [], "invoked", "active_s", ACTIVITY_WINDOW)
    hints = unique_best(close, "path", F.col("distance")).select("path", "workspace", F.lit("time_proximity_metadata_only").alias("strategy"))
    return whole.unionByName(hints).join(rows.select("workspace", "composer", "prompts", "active", "messages", "users_missing", "assistants_missing"), "workspace")


def cursor_cli(spark: SparkSession, root: str) -> DataFrame:
    """Invocations of the command line: with the messages of the editor session that fits, or its prompts as evidence, or without any."""
    calls = cursor_invocations(spark, root)
    kinds = f"path string, workspace string, strategy string, composer string, prompts array<string>, active string, messages array<{MESSAGE}>, users_missing bigint, assistants_missing bigint"
    stored = matching(spark, [f"{root}/User/workspaceStorage/*/state.vscdb"])
    rows = calls.join(cursor_attributed(spark, root, calls) if stored else spark.createDataFrame([], kinds), "path", "left")
    whole = F.coalesce(F.col("strategy") == "prompt_overlap_plus_time_window", F.lit(False))
    lacks = F.array_compact(F.array(F.when(F.col("users_missing") > 0, "user_body_missing_from_cursor_disk_kv"), F.when(F.col("assistants_missing") > 0, "assistant_body_missing_from_cursor_disk_kv")))
    complete = (F.size(lacks) == 0) & F.exists("messages", lambda m: m["role"] == "assistant")
    unconfirmed = lambda other: F.array(F.lit("cursor_cli_transcript_not_confirmed"), F.lit(other))
    evidence = F.to_json(F.struct(
        F.col("strategy").alias("match_strategy"), F.element_at(F.split("workspace", "/"), -2).alias("workspace_id"), F.col("composer").alias("composer_id"), F.size("prompts").alias("prompt_count"),
        F.col("prompts").alias("partial_prompt_texts"), F.col("workspace").alias("source_artifact_path"), F.col("active").alias("activity_at"),
    ))
    name = F.when(whole, "transcript_attribution").otherwise("workspace_prompt_evidence")
    payload = F.when(F.col("strategy").isNull(), F.col("payload")).otherwise(F.concat(F.regexp_replace("payload", r"\}$", ""), F.lit(',"'), name, F.lit('":'), evidence, F.lit("}")))
    rows = rows.withColumns({
        "payload": payload, "messages": F.when(whole, F.col("messages")).otherwise(F.array().cast(f"array<{MESSAGE}>")),
        "completeness": F.when(whole, F.when(complete, "complete").otherwise("partial")).otherwise(F.when(F.col("strategy").isNotNull(), "partial").otherwise("unsupported")),
        "lacks": F.when(whole, lacks).when(F.col("strategy").isNotNull(), unconfirmed("workspace_prompt_cache_only")).otherwise(unconfirmed("metadata_only_cli_invocation")),
    })
    provenance = F.to_json(F.struct(S.utc_text(F.timestamp_seconds("invoked")).alias("session_started_at"), F.lit("cli").alias("source"), F.lit("cursor_cli").alias("originator")))
    return conversations(rows, "cursor", "cli", F.col("session"), provenance, metadata=F.col("payload"), completeness=F.col("completeness"), limitations=F.col("lacks"))


def _of(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A collector of a module beside this one, which is loaded with its first use since it needs this one."""

    def collect(spark: SparkSession, root: str) -> DataFrame:
        return getattr(import_module(f".{module}", __package__), name)(spark, root)

    return collect


SOURCES = {
    s.key: s
    for s in (
        Source("codex_cli", "cli", "complete", rollouts, ROLLOUTS),
        Source("codex_ide_extension", "ide", "complete", lambda spark, root: rollouts(spark, root, "codex_ide_extension", "ide", "codex_vscode"), ROLLOUTS),
        Source("codex_app", "app", "complete", _of("desktop", "codex_app"), ROLLOUTS),
        Source("claude", "cli", "complete", claude, PROJECTS),
        Source("claude_code_ide", "ide", "partial", lambda spark, root: claude(spark, root, "claude_code_ide", "ide", ide_sessions(spark, root)), PROJECTS),
        Source("gemini", "cli", "complete", gemini, ("tmp/*/chats/session-*.json",)),
        Source("gemini_code_assist_ide", "ide", "partial", code_assist, ("User/workspaceStorage/*/chatSessions/*.json",)),
        Source("cursor", "cli", "partial", cursor_cli, ("logs/*/cli.log",)),
        Source("cursor_editor", "ide", "partial", cursor_editor, ("User/globalStorage/state.vscdb",)),
        Source("antigravity_editor_view", "ide", "partial", _of("blobs", "antigravity"), ("conversations/*.pb",)),
        Source("windsurf_editor", "ide", "partial", windsurf, WINDSURF),
    )
}


def selected(sources: list[str] | None = None, least_level: str = "scaffold", excluded: tuple[str, ...] = ()) -> list[Source]:
    """Sources by name or by support level, without those excluded; unknown names are an error."""
    levels = ("scaffold", "partial", "complete")
    unknown = {*(sources or ()), *excluded} - SOURCES.keys()
    if unknown:
        raise KeyError(f"unknown sources: {', '.join(sorted(unknown))}")
    return [s for s in SOURCES.values() if (sources is None or s.key in sources) and s.key not in excluded and levels.index(s.support_level) >= levels.index(least_level)]
