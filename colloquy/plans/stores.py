"""Registered queries of chat indexes, side artifacts, transcripts put together from prompts, and orders of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import artifacts as R
from ..operators import identity as I
from ..operators import workspaces as K
from . import views
from .maintenance import _MERGED
from .queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

#: Nine workspaces, whose indexes name the conversations whose number they are the remainder of; one of eight entries has no id, and two of three named sessions have a file.
_INDEX_SQL = """
with c as (select distinct conv_id from conversations), w as (select 'w' || i as workspace, i from range(10) r(i)),
e as (select 'w' || (conv_id % 9) as workspace, row_number() over (partition by conv_id % 9 order by conv_id) - 1 as nth, conv_id, case when conv_id % 8 <> 7 then 's' || conv_id end as session_id from c),
x as (select * from e where session_id is not null),
s as (select *, case conv_id % 5 when 0 then 'foreign' when 1 then 'unknown' else 'gemini' end as ownership, conv_id % 7 <> 0 as has_body from x where conv_id % 3 <> 2)
"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.turns(spark, sf_dir).select("conv_id").distinct()
    n = F.col("conv_id")
    moment = F.concat(F.lit("2024-01-"), F.lpad((1 + n % 28).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    entry = F.struct(n.alias("nth"), F.when(n % 8 != 7, F.concat(F.lit("s"), n)).alias("sessionId"), (n % 4 == 0).alias("isEmpty"), (n % 6 == 0).alias("isExternal"), (n % 10 == 0).alias("hasPendingEdits"), moment.alias("lastMessageDate"))
    listed = ids.groupBy((n % 9).alias("i")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    every = spark.range(10).select(F.col("id").alias("i")).join(listed, "i", "left").select(F.concat(F.lit("w"), "i").alias("workspace"), "i", F.to_json(F.struct(F.when(F.col("entries").isNotNull(), F.col("i")).alias("version"), "entries")).alias("index"))
    return every.select("workspace", "index")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files of two of three conversations, those too that no index names."""
    n = F.col("conv_id")
    owner = F.when(n % 5 == 0, "foreign").when(n % 5 == 1, "unknown").otherwise("gemini")
    return views.turns(spark, sf_dir).select("conv_id").distinct().where(n % 3 != 2).select(F.concat(F.lit("w"), n % 9).alias("workspace"), F.concat(F.lit("/w/chatSessions/s"), n, F.lit(".json")).alias("path"), owner.alias("ownership"), (n % 7 != 0).alias("has_body"))


@query(_INDEX_SQL + "select workspace, nth, session_id, 'vscode:' || workspace || ':' || session_id as conversation_id, ownership from s")
def index_sessions(spark, sf_dir):
    return K.indexed_sessions(_states(spark, sf_dir), _files(spark, sf_dir)).select("workspace", "nth", "session_id", "conversation_id", "ownership")


@query(
    _INDEX_SQL + """select w.workspace, case when i < 9 then i else -1 end as version, count(x.conv_id) as session_count, count(*) filter (conv_id % 4 = 0) as empty_count, count(*) filter (conv_id % 6 = 0) as external_count,
  count(*) filter (conv_id % 10 = 0) as pending_edits_count, max('2024-01-' || lpad(cast(1 + conv_id % 28 as varchar), 2, '0') || 'T00:00:00Z') as latest_message_at from w left join x using (workspace) group by 1, 2"""
)
def index_summaries(spark, sf_dir):
    """An index that is not there has version -1."""
    return K.index_summary(_states(spark, sf_dir)).withColumn("version", F.coalesce("version", F.lit(-1)))


@query(
    _INDEX_SQL + """, k as (select w.workspace, count(*) filter (ownership = 'gemini' and has_body) as transcript_count, count(*) filter (not (ownership = 'gemini' and has_body)) as residue_count,
  min(nth) filter (ownership = 'foreign') as f, min(nth) filter (ownership = 'unknown') as u, min(nth) filter (ownership = 'gemini' and not has_body) as g from w left join s using (workspace) group by 1),
l as (select workspace, string_agg(code, '|' order by spot) as codes from (select workspace, f as spot, 'foreign_chat_session_rejected' as code from k where f is not null union all select workspace, u, 'unknown_chat_session_rejected' from k where u is not null
  union all select workspace, g, 'gemini_owned_chat_session_body_missing' from k where g is not null) group by 1)
select workspace, 'vscode:' || workspace || ':residue' as conversation_id, transcript_count, residue_count, concat_ws('|', case when transcript_count = 0 then 'no_confirmed_gemini_code_assist_ide_transcript_store' end, 'metadata_only_ide_state',
  case when transcript_count = 0 and residue_count = 0 then 'chat_session_provider_attribution_required' end, codes) as limitations from k left join l using (workspace) where residue_count > 0 or transcript_count = 0"""
)
def workspace_residue(spark, sf_dir):
    states = _states(spark, sf_dir)
    sessions = K.indexed_sessions(states, _files(spark, sf_dir))
    return K.residue(states, sessions).withColumn("limitations", F.array_join("limitations", "|"))


_SIDES = """with u as (select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as place, text from conversations where role = 'user'),
a as (select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as place, text from conversations where role = 'assistant'), c as (select distinct conv_id from conversations)
"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, prompts, replies): the texts of a conversation's user and of its assistant, in order."""
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return views.turns(spark, sf_dir).groupBy("conv_id").agg(said("user").alias("prompts"), said("assistant").alias("replies"))


@query(_SIDES + "select coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.place, a.place) as place, sha256(u.text) as prompt, sha256(a.text) as reply from u full join a on u.conv_id = a.conv_id and u.place = a.place")
def prompt_alignment(spark, sf_dir):
    rows = K.aligned(_sides(spark, sf_dir), "conv_id", "prompts", "replies")
    return rows.select("conv_id", F.col("place").cast("bigint").alias("place"), F.sha2("prompts", 256).alias("prompt"), F.sha2("replies", 256).alias("reply"))


@query(
    _SIDES + """, t as (select c.conv_id, count(a.text) filter (c.conv_id % 3 = 0) as stored, (select count(*) from u where u.conv_id = c.conv_id and trim(u.text) <> '') as prompts from c left join a using (conv_id) group by 1)
select conv_id, case when stored > 0 then stored else prompts end as message_count, case when stored > 0 then 'cursor_disk_kv' else 'workspace_prompt_cache' end as source_name, case when stored > 0 and conv_id % 2 = 0 then 'complete' else 'partial' end as transcript_completeness,
  case when stored > 0 then case when conv_id % 2 = 0 then '' else 'bubbles without a body' end else concat_ws('|', 'cursor_disk_kv_transcript_not_found', 'assistant_body_unverified', 'workspace_prompt_cache_not_explicitly_composer_scoped', case when conv_id % 2 = 1 then 'bubbles without a body' end) end as limitations
from t where stored > 0 or prompts > 0"""
)
def transcript_choice(spark, sf_dir):
    """Stored transcripts of one conversation in three, and prompts of all; those of odd number lack bodies."""
    rows = _sides(spark, sf_dir).withColumn("times", F.array().cast("array<string>"))
    stored = F.when(F.col("conv_id") % 3 == 0, F.transform("replies", lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("timestamp"))))
    limits = F.when(F.col("conv_id") % 2 == 1, F.array(F.lit("bubbles without a body"))).otherwise(F.array().cast("array<string>"))
    both = rows.select("conv_id", stored.alias("stored"), limits.alias("stored_limitations")).join(K.prompt_messages(rows, "conv_id").withColumnRenamed("messages", "prompts"), "conv_id")
    return K.chosen_transcript(both).select("conv_id", F.size("messages").alias("message_count"), "source_name", "transcript_completeness", F.array_join("limitations", "|").alias("limitations"))


_UUID_SQL = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


def _uuid(text):
    h = F.md5(text)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


@query(
    f"""with u as (select conv_id, {_UUID_SQL.format("cast(conv_id as varchar)")} as id from (select distinct conv_id from conversations)),
f as (select user_id, min('brain/' || event_type || '/' || upper({_UUID_SQL.format("cast(user_id as varchar)")}) || case when event_id % 2 = 0 then '.pb' else '' end) as path from events where event_type <> 'view' group by 1)
select u.conv_id, f.path as artifact from u left join f on u.conv_id = f.user_id"""
)
def artifact_by_uuid(spark, sf_dir):
    """Conversations and the files of events, named by the UUID of their user in capitals."""
    rows = views.turns(spark, sf_dir).select("conv_id").distinct().withColumn("id", _uuid(F.col("conv_id").cast("string")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'view'")
    name = F.concat(F.upper(_uuid(F.col("user_id").cast("string"))), F.when(F.col("event_id") % 2 == 0, ".pb").otherwise(""))
    return R.first_by_uuid(rows, events.select(F.concat_ws("/", F.lit("brain"), "event_type", name).alias("path")), "id", "artifact").select("conv_id", "artifact")


@query(
    """with p as (select regexp_extract(url, '://([^?#]*)', 1) as path, length(html) as size from pages), q as (select string_split(path, '/') as parts, size from p),
d as (select array_to_string(parts[1:i], '/') as folder, size from q, range(1, 5) r(i) where i < len(parts))
select folder, count(*) as file_count, cast(sum(size) as bigint) as byte_count from d group by 1"""
)
def tree_totals(spark, sf_dir):
    """Pages as files in the folders of their address, to a depth of four."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return R.tree_totals(pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.length("html").alias("size")), 4)


@query(
    _MERGED.replace("or a.x = b.x", "") + """, n as (select component, count(*) as c, arg_max(struct_pack(d := collected_at, s := source, a := coalesce(source_session_id, ''), b := coalesce(source_artifact_path, ''), o := output_path, r := row_number), sel) as best from m group by 1 having count(*) > 1),
p as (select component, row_number() over (order by best desc) as group_place from n)
select m.source, m.row_number, group_place, row_number() over (partition by component order by sel desc) as member_place from m join p using (component)"""
)
def identity_members(spark, sf_dir):
    return I.audit_members(A.active(views.archive(spark, sf_dir))).select("source", "row_number", "group_place", "member_place")
