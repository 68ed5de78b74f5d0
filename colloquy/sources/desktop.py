"""The desktop app's transcripts: rollout files joined with the threads and automation runs of its databases.

Rollouts come first; what they lack of an automation's first question or last answer is taken
from the run's archived texts or the thread, and marked as such.  A run belongs to a rollout
by its thread, else by folder and title, else by folder and first question, where these name one run only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import MESSAGE
from ..operators.attribution import by_fallback_keys
from ..operators.checks import file_path
from .collectors import conversations, found_paths, matching, message, rollout_files
from .sqlite_source import tables

#: Where the databases and definitions lie below an input folder, their columns, and the limitations of repaired rows.
STATE = ("state_5.sqlite", "*/state_5.sqlite")
AUTOMATION = ("sqlite/codex-dev.db", "*/sqlite/codex-dev.db")
DEFINITIONS = ("automations/*/automation.toml", "*/automations/*/automation.toml")
THREAD = ("id", "rollout_path", "cwd", "title", "first_user_message", "archived", "cli_version")
RUN = ("thread_id", "automation_id", "status", "thread_title", "source_cwd", "inbox_title", "inbox_summary", "archived_user_message", "archived_assistant_message", "archived_reason")
DEFINITION = ("id", "name", "prompt", "status", "rrule", "model", "reasoning_effort")
USER_SNAPSHOT = "automation_origin_user_message_reconstructed_from_archived_snapshot"
ASSISTANT_SNAPSHOT = "automation_origin_assistant_message_reconstructed_from_archived_snapshot"
USER_THREAD = "user_message_reconstructed_from_thread_metadata"
NO_USER, NO_ASSISTANT = "automation_origin_user_message_missing", "automation_origin_assistant_message_missing"


def _table(spark: SparkSession, root: str, patterns: tuple[str, ...], table: str, columns: tuple[str, ...], key: str) -> DataFrame:
    """Trimmed rows of a table of the databases that are there; the first row of each key, by file."""
    found = matching(spark, [f"{root}/{p}" for p in patterns])
    ddl = ", ".join(f"{c} string" for c in columns)
    if not found:
        return spark.createDataFrame([], ddl)
    rows = tables(spark, found_paths(spark, found), table, ddl).select("path", F.monotonically_increasing_id().alias("_nth"), *[S.identity(F.col(c)).alias(c) for c in columns]).where(f"{key} is not null")
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in columns if c != key]), F.struct("path", "_nth")).alias("r"))
    return first.select(key, "r.*")


def _definitions(spark: SparkSession, root: str) -> DataFrame:
    """(automation_id, name, schedule, model, reasoning_effort, definition_path): of the database, else of a definition file's simple lines."""
    stored = _table(spark, root, AUTOMATION, "automations", DEFINITION, "id").select(F.col("id").alias("automation_id"), "name", F.col("rrule").alias("schedule"), "model", "reasoning_effort")
    found = matching(spark, [f"{root}/{p}" for p in DEFINITIONS])
    names = ("name", "schedule", "model", "reasoning_effort")
    if not found:
        return stored.withColumn("definition_path", F.lit(None).cast("string"))
    path = F.col("_metadata.file_path")
    texts = spark.read.text(found, wholetext=True).select(F.element_at(F.split(path, "/"), -2).alias("automation_id"), file_path(path).alias("definition_path"), "value")
    line = lambda name: S.identity(F.regexp_extract("value", rf'(?m)^\s*{"rrule" if name == "schedule" else name}\s*=\s*["\'](.*)["\']\s*(?:#.*)?$', 1))
    files = texts.groupBy("automation_id").agg(F.min_by(F.struct("definition_path", *[line(n).alias(n) for n in names]), "definition_path").alias("f"))
    both = stored.join(files, "automation_id", "full_outer")
    return both.select("automation_id", *[F.coalesce(n, f"f.{n}").alias(n) for n in names], "f.definition_path")


def attributed(rows: DataFrame, threads: DataFrame, runs: DataFrame) -> DataFrame:
    """Rollouts (path, session, cwd, first_user) with `thread` and `run`, structs that are null where none belongs to them."""
    thread = F.struct(*[F.col(c) for c in THREAD])
    by_id = threads.select(F.col("id").alias("session"), thread.alias("_by_id"))
    by_path = threads.where("rollout_path is not null").withColumn("path", file_path(F.col("rollout_path"))).groupBy("path").agg(F.min_by(thread, "id").alias("_by_path"))
    named = rows.join(by_id, "session", "left").join(by_path, "path", "left").withColumn("thread", F.coalesce("_by_id", "_by_path")).drop("_by_id", "_by_path")

    key = lambda *parts: F.when(parts[0].isNotNull() & parts[1].isNotNull(), F.concat_ws("\0", *parts))
    cwd = F.coalesce("cwd", "thread.cwd")
    asked = named.withColumns({
        "by_thread": F.coalesce("session", "thread.id"), "by_title": key(cwd, F.col("thread.title")), "by_text": key(cwd, F.coalesce("first_user", "thread.first_user_message")),
    })
    # A run has one or two titles; each is a fact of its own, and facts that name several threads name none.
    none = F.lit(None).cast("string")
    titles = runs.select("thread_id", "source_cwd", F.explode(F.array_distinct(F.array_compact(F.array("thread_title", "inbox_title")))).alias("title"))
    facts = runs.select(F.col("thread_id").alias("by_thread"), none.alias("by_title"), key(F.col("source_cwd"), F.col("archived_user_message")).alias("by_text"), F.col("thread_id").alias("_run"))
    facts = facts.unionByName(titles.select(none.alias("by_thread"), key(F.col("source_cwd"), F.col("title")).alias("by_title"), none.alias("by_text"), F.col("thread_id").alias("_run")))
    found = by_fallback_keys(asked, facts, ["by_thread", "by_title", "by_text"], "_run")
    own = runs.select(F.col("thread_id").alias("_run"), F.struct(*RUN).alias("run"))
    return found.join(own, "_run", "left").drop("_run", "by_thread", "by_title", "by_text")


def _said(role: str, text: Column, id_: str, body: str, timestamp: Column | None = None) -> Column:
    made = message(F.lit(role), text, None, timestamp, F.lit(id_))
    return made.withField("provenance", F.struct(F.lit(body).alias("body_source"), F.lit(True).alias("fallback")).cast("struct<body_source:string,fallback:boolean>"))


def repaired(rows: DataFrame) -> DataFrame:
    """Messages, completeness and limitations of rollouts with their thread and run; rows that are no automation's stay as they are."""
    automatic = F.col("run").isNotNull()
    archived = automatic & (F.col("archived") | F.coalesce(F.col("thread.archived").isin("1", "true", "True"), F.lit(False)))
    has = lambda messages, role: F.exists(messages, lambda m: m["role"] == role)
    marked = F.transform("messages", lambda m: m.withField("provenance", F.struct(F.lit("rollout.message").alias("body_source"), F.lit(False).alias("fallback")).cast("struct<body_source:string,fallback:boolean>")))
    rows = rows.withColumn("messages", F.when(archived, marked).otherwise(F.col("messages")))
    lacks = automatic & ~has("messages", "user")
    snapshot, first = F.col("run.archived_user_message"), F.col("thread.first_user_message")
    question = F.when(lacks & snapshot.isNotNull(), _said("user", snapshot, "automation-archived-user", "automation_runs.archived_user_message", F.col("started"))).when(lacks & first.isNotNull(), _said("user", first, "thread-first-user-message", "threads.first_user_message", F.col("started")))
    answer = F.when(automatic & ~has("messages", "assistant") & F.col("run.archived_assistant_message").isNotNull(), _said("assistant", F.col("run.archived_assistant_message"), "automation-archived-assistant", "automation_runs.archived_assistant_message"))
    # The question goes after the developer's messages at the beginning.
    leading = F.coalesce(F.array_min(F.transform(F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("i"), m["role"].alias("r"))), lambda x: x["r"] != "developer"), lambda x: x["i"])), F.size("messages"))
    rows = rows.withColumns({"_question": question, "_answer": answer, "_at": leading})
    start, rest = F.slice("messages", F.lit(1), F.col("_at")), F.slice("messages", F.col("_at") + 1, F.size("messages"))
    whole = F.concat(start, F.array_compact(F.array(F.col("_question").cast(MESSAGE))), rest, F.array_compact(F.array(F.col("_answer").cast(MESSAGE))))
    rows = rows.withColumn("messages", whole)
    told = F.array_compact(F.array(
        F.when(F.col("_question.source_message_id") == "automation-archived-user", USER_SNAPSHOT), F.when(F.col("_question.source_message_id") == "thread-first-user-message", USER_THREAD), F.when(F.col("_answer").isNotNull(), ASSISTANT_SNAPSHOT),
        F.when(automatic & ~has("messages", "user"), NO_USER), F.when(automatic & ~has("messages", "assistant"), NO_ASSISTANT),
    ))
    return rows.withColumn("limitations", F.when(F.size(told) > 0, told)).withColumn("completeness", F.when(F.col("limitations").isNotNull(), "partial")).drop("_question", "_answer", "_at")


def codex_app(spark: SparkSession, root: str) -> DataFrame:
    """Desktop conversations: rollouts of the app, repaired, with where they come from."""
    rows = rollout_files(spark, root, "Codex Desktop").select(
        file_path(F.col("path")).alias("path"), "messages", F.col("meta.id").alias("session"), "meta.cwd", F.col("meta.timestamp").alias("started"), "meta.source", "meta.originator", "meta.cli_version", F.col("path").contains("/archived_sessions/").alias("archived"),
        F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["text"].alias("first_user"),
    )
    threads, runs = _table(spark, root, STATE, "threads", THREAD, "id"), _table(spark, root, AUTOMATION, "automation_runs", RUN, "thread_id").where("automation_id is not null")
    found = repaired(attributed(rows, threads, runs)).where(F.size("messages") > 0).withColumn("automation_id", F.col("run.automation_id")).join(_definitions(spark, root).withColumnsRenamed({n: f"defined_{n}" for n in ("name", "schedule", "model", "reasoning_effort")}), "automation_id", "left")
    t, r = F.col("thread"), F.col("run")
    titles = ((r["thread_title"], "automation_runs.thread_title"), (r["inbox_title"], "automation_runs.inbox_title"), (t["title"], "state_5.sqlite threads.title"))
    title = F.coalesce(*[v for v, _ in titles])
    origin = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, name in titles])
    automation = F.struct(
        r["automation_id"].alias("automation_id"), F.col("defined_name").alias("automation_name"), r["status"].alias("status"), F.col("defined_schedule").alias("schedule"), r["source_cwd"].alias("source_cwd"), F.col("defined_model").alias("model"),
        F.col("defined_reasoning_effort").alias("reasoning_effort"), "definition_path", r["thread_title"].alias("thread_title"), t["title"].alias("thread_record_title"), r["inbox_title"].alias("inbox_title"), r["inbox_summary"].alias("inbox_summary"),
        title.alias("resolved_title"), origin.alias("resolved_title_source"), r["inbox_summary"].alias("resolved_summary"), F.when(r["inbox_summary"].isNotNull(), "automation_runs.inbox_summary").alias("resolved_summary_source"),
    )
    put_away = F.col("archived") | F.coalesce(t["archived"].isin("1", "true", "True"), F.lit(False))
    provenance = F.to_json(F.struct(
        F.col("started").alias("session_started_at"), "source", "originator", F.coalesce("cwd", r["source_cwd"], t["cwd"]).alias("cwd"), F.coalesce("cli_version", t["cli_version"]).alias("cli_version"), F.when(put_away, put_away).alias("archived"),
        r["archived_reason"].alias("archived_reason"), F.when(r.isNotNull(), "automation").otherwise("interactive").alias("conversation_origin"), F.when(r.isNotNull(), automation).alias("automation"),
    ))
    session = F.coalesce("session", t["id"], F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    return conversations(found, "codex_app", "app", session, provenance, F.col("completeness"), F.col("limitations"))
