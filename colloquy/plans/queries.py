"""Registered queries of the archive operators over the driver's tables, each with its SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import attribution as T
from ..operators import identity as I
from ..operators import memory as M
from ..operators import runs as R
from ..operators import verify as V
from ..sources.archive import file_changes
from . import views
from .views import BASE_SQL, RUNS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active(views.archive(spark, sf_dir))


FLAT_SQL = """case when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 120 then trim(regexp_replace(text, '\\s+', ' ', 'g'))
  else substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 117) || '...' end"""


@query(
    BASE_SQL + "select source, source_session_id, transcript_completeness, collected_at, message_count, limitation_count, "
    "case limitation_count when 0 then '' when 1 then 'no tools' else 'no images|no tools' end as limitations, has_provenance, source_artifact_path, execution_context, output_path, row_number from base"
)
def archive_list(spark, sf_dir):
    return A.list_conversations(_active(spark, sf_dir)).withColumn("limitations", F.array_join("limitations", "|"))


@query(BASE_SQL + "select source, source_session_id, collected_at, message_count, row_number from base where source = 'src1' and transcript_completeness = 'partial'")
def archive_list_filtered(spark, sf_dir):
    return A.list_conversations(_active(spark, sf_dir), source="src1", completeness="partial").select("source", "source_session_id", "collected_at", "message_count", "row_number")


@query(
    BASE_SQL + f"""select b.source, b.row_number, h.matched_message_count, h.preview from base b join (
  select conv_id, count(*) as matched_message_count, arg_min({FLAT_SQL}, message_index) as preview from msg where contains(lower(text), 'tion') group by conv_id) h using (conv_id)"""
)
def archive_find(spark, sf_dir):
    return A.find(_active(spark, sf_dir), "TION").select("source", "row_number", F.col("matched_message_count"), "preview")


@query(BASE_SQL + "select b.source, b.row_number, m.message_index, m.role, m.text from base b join msg m using (conv_id)")
def archive_messages(spark, sf_dir):
    return A.messages(_active(spark, sf_dir)).select("source", "row_number", "message_index", "role", "text")


_COUNTS_SQL = """count(distinct output_path) as file_count, count(*) as conversation_count, cast(coalesce(sum(message_count), 0) as bigint) as message_count,
  count(*) filter (transcript_completeness = 'complete') as complete_count, count(*) filter (transcript_completeness = 'partial') as partial_count,
  count(*) filter (transcript_completeness = 'unsupported') as unsupported_count, min(collected_at) as earliest_collected_at, max(collected_at) as latest_collected_at,
  count(*) filter (limitation_count > 0) as conversation_with_limitations_count"""


@query(BASE_SQL + f"select source, {_COUNTS_SQL} from base group by source union all select '*' as source, {_COUNTS_SQL} from base")
def archive_stats(spark, sf_dir):
    return A.stats(_active(spark, sf_dir))


@query(
    BASE_SQL + """, c as (select source, count(*) as n, sum(message_count) as m from base group by source union all select '*', count(*), sum(message_count) from base),
r as (select coalesce(b.source, '*') as source, count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'assistant') as assistant_messages,
  count(*) filter (role = 'system') as system_messages from base b join msg using (conv_id) group by grouping sets ((b.source), ()))
select r.source, user_messages, assistant_messages, system_messages, user_messages / m as user_ratio from r join c on r.source = c.source"""
)
def archive_profile(spark, sf_dir):
    return A.profile(_active(spark, sf_dir)).select("source", "user_messages", "assistant_messages", "system_messages", "user_ratio")


@query(BASE_SQL + "select source, unnest(case limitation_count when 1 then ['no tools'] when 2 then ['no images', 'no tools'] else [] end) as limitation, count(*) as raw_count from base group by 1, 2")
def limitation_counts(spark, sf_dir):
    return A.limitation_counts(_active(spark, sf_dir))


@query(BASE_SQL + "select unnest(case limitation_count when 1 then ['no tools'] when 2 then ['no images', 'no tools'] else [] end) as limitation, count(*) as raw_count from base group by 1 order by 2 desc, 1 limit 5")
def top_limitations(spark, sf_dir):
    return A.top_limitations(_active(spark, sf_dir))


_LOW, _MANY, _UNS = "message_count <= 3", "limitation_count >= 2", "transcript_completeness = 'unsupported'"


@query(
    BASE_SQL + f"""select source, row_number, concat_ws('|', case when {_LOW} then 'low_message_count' end, case when {_MANY} then 'excessive_limitations' end,
  case when {_UNS} then 'unsupported_transcript' end) as reasons from base where {_LOW} or {_MANY} or {_UNS}"""
)
def archive_anomalies(spark, sf_dir):
    return A.anomalies(_active(spark, sf_dir), low_messages=3).select("source", "row_number", F.array_join("reasons", "|").alias("reasons"))


@query(
    BASE_SQL + f"""select source, count(distinct output_path) as file_count, count(*) as conversation_count, cast(sum(message_count) as bigint) as message_count,
  count(*) filter ({_LOW}) as low_message_count, count(*) filter ({_MANY}) as excessive_limitations, count(*) filter ({_UNS}) as unsupported_transcript,
  count(*) filter ({_LOW} or {_MANY} or {_UNS}) as suspicious_conversation_count, count(*) filter ({_UNS}) / count(*) as unsupported_ratio,
  count(*) filter ({_UNS}) >= 2 and count(*) filter ({_UNS}) / count(*) >= 0.5 as high_unsupported_ratio from base group by source"""
)
def source_anomalies(spark, sf_dir):
    return A.source_anomalies(_active(spark, sf_dir), low_messages=3)


@query(
    BASE_SQL + f"""select source, row_number, 'low_message_count' as code, cast(null as varchar) as suppressed_by from base where {_LOW}
union all select source, row_number, 'excessive_limitations', case source when 'src2' then 'p4' end from base where {_MANY}
union all select source, row_number, 'unsupported_transcript', case source when 'src1' then 'p2' end from base where {_UNS}"""
)
def suppressed_anomalies(spark, sf_dir):
    return A.suppressed_reasons(A.anomalies(_active(spark, sf_dir), low_messages=3), views.policy(spark)).select("source", "row_number", "code", "suppressed_by")


@query(
    BASE_SQL + """select source, conv_id as row_number, 'invalid_contract' as code, cast(null as varchar) as suppressed_by from allrows where conv_id % 11 = 0
union all select source, conv_id, 'incomplete_transcript', case source when 'src1' then 'p1' end from allrows where transcript_completeness <> 'complete'"""
)
def suppressed_findings(spark, sf_dir):
    found = V.findings(views.archive(spark, sf_dir)).select(F.col("source_dir").alias("source"), "row_number", F.lit("verify").alias("report"), "code", "level")
    return A.with_suppression(found, views.policy(spark)).select("source", "row_number", "code", "suppressed_by")


@query(
    BASE_SQL + """, l as (select source, unnest(case limitation_count when 1 then ['no tools'] when 2 then ['no images', 'no tools'] else [] end) as limitation, count(*) as raw_count from base group by 1, 2)
select source, limitation, raw_count, case when source = 'src2' or (source = 'src0' and limitation = 'no tools') then raw_count else 0 end as suppressed_count from l"""
)
def limitation_counts_raw_vs_suppressed(spark, sf_dir):
    return A.limitation_counts(_active(spark, sf_dir), views.policy(spark))


_COMPONENTS_SQL = """, recursive_edges as (
  select a.row_number as a, b.row_number as b from base a join base b on a.source = b.source and (a.source_session_id = b.source_session_id or a.source_artifact_path = b.source_artifact_path)),
reach(a, b) as (select row_number, row_number from base union select r.a, e.b from reach r join recursive_edges e on r.b = e.a),
comp as (select a as row_number, min(b) as component from reach group by a)
"""


@query(
    BASE_SQL.replace("with msg", "with recursive msg") + _COMPONENTS_SQL + """select source, count(*) as conversation_count, count(distinct source_session_id) as sessions, count(distinct source_artifact_path) as artifacts,
  arg_max(row_number, {'c': case transcript_completeness when 'complete' then 2 when 'partial' then 1 else 0 end, 't': text_messages, 'm': message_count, 's': text_size, 'p': has_provenance, 'l': -limitation_count, 'd': collected_at, 'o': output_path, 'r': row_number}) as preferred_row_number
from base join comp using (row_number) group by source, component having count(*) > 1"""
)
def identity_audit(spark, sf_dir):
    found = I.identity_audit(_active(spark, sf_dir), F.sha2(S.transcript(F.col("messages")), 256))
    return found.select("source", "conversation_count", F.size("source_session_ids").alias("sessions"), F.size("source_artifact_paths").alias("artifacts"), "preferred_row_number")


@query()
def identity_reasons(spark, sf_dir):
    found = I.identity_audit(_active(spark, sf_dir), F.sha2(S.transcript(F.col("messages")), 256))
    return found.select("source", "preferred_row_number", "message_variants", F.array_join("identity_shapes", "|").alias("identity_shapes"), F.array_join("reasons", "|").alias("reasons"))


@query(
    BASE_SQL + """select source, row_number, group_size from (select source, row_number, count(*) over (partition by source, k) as group_size,
  row_number() over (partition by source, k order by case transcript_completeness when 'complete' then 2 when 'partial' then 1 else 0 end desc, text_messages desc, message_count desc,
    text_size desc, has_provenance desc, -limitation_count desc, collected_at desc, output_path desc, row_number desc) as rank
  from (select *, coalesce('session:' || source_session_id, 'artifact:' || source_artifact_path, 'exact:' || transcript) as k from base)) where rank = 1"""
)
def compacted_archive(spark, sf_dir):
    return I.compacted(_active(spark, sf_dir), S.transcript(F.col("messages"))).select("source", "row_number", "group_size")


@query()
def incremental_merge(spark, sf_dir):
    rows = _active(spark, sf_dir)
    return I.incremental_merge(rows.where("row_number % 2 = 0"), rows.where("row_number % 2 = 1"), F.sha2(S.transcript(F.col("messages")), 256))


@query(
    BASE_SQL + """select source as source_dir, row_number, 'invalid_contract' as code, 'error' as level from allrows where conv_id % 11 = 0
union all select source, row_number, 'incomplete_transcript', 'warning' from allrows where transcript_completeness <> 'complete'"""
)
def verify_findings(spark, sf_dir):
    return V.findings(views.archive(spark, sf_dir)).select("source_dir", "row_number", "code", "level")


@query(
    BASE_SQL + """select source as source_dir, count(distinct output_path) as file_count, count(*) as row_count, count(*) filter (conv_id % 11 = 0) as bad_row_count,
  count(*) filter (transcript_completeness <> 'complete') as warning_count, count(*) filter (conv_id % 11 = 0) as error_count,
  case when count(*) filter (conv_id % 11 = 0) > 0 then 'error' when count(*) filter (transcript_completeness <> 'complete') > 0 then 'warning' else 'success' end as status
from allrows group by source"""
)
def verify_rollup(spark, sf_dir):
    rows = views.archive(spark, sf_dir)
    return V.rollup(rows, V.findings(rows))


@query(BASE_SQL + "select row_number, message_count, sha256(transcript) as transcript_sha256, transcript_completeness from base")
def memory_records(spark, sf_dir):
    return M.memory_records(_active(spark, sf_dir)).select("row_number", "message_count", F.sha2("transcript_text", 256).alias("transcript_sha256"), "transcript_completeness")


@query(BASE_SQL + "select conv_id as row_number, message_index, row_number() over (partition by conv_id, role, text order by message_index) as occurrence from msg join base using (conv_id)")
def message_occurrences(spark, sf_dir):
    return M.message_records(_active(spark, sf_dir)).select("row_number", "message_index", "occurrence")


@query(BASE_SQL + "select row_number, collected_at from base where collected_at > '2024-01-15T00:00:00Z'")
def watermark_export(spark, sf_dir):
    return M.after(_active(spark, sf_dir), "2024-01-15T00:00:00Z").select("row_number", "collected_at")


def _redaction_sql() -> str:
    text = "text"
    for pattern, by in S.REDACTIONS:
        flags = "gi" if pattern.startswith("(?iU)") else "g"
        bare = pattern.replace("(?iU)", "").replace("(?U)", "").replace("'", "''")
        text = f"regexp_replace({text}, '{bare}', '{by.replace('$', chr(92))}', '{flags}')"
    return text


@query(f"select doc_id, sha256({_redaction_sql()}) as redacted_sha256 from documents")
def redacted_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(S.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query(f"select doc_id, {FLAT_SQL} as preview from documents")
def document_previews(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query(
    BASE_SQL + "select row_number from base order by sha256('seed-1' || chr(0) || source || ':' || row_number), row_number limit 20"
)
def archive_sample(spark, sf_dir):
    return A.sample(_active(spark, sf_dir), 20, "seed-1", F.concat("source", F.lit(":"), F.col("row_number").cast("string"))).select("row_number")


@query("with" + RUNS_SQL + "select run_id, count(*) as source_count, cast(sum(conversation_count) as bigint) as conversation_count, cast(sum(message_count) as bigint) as message_count, count(*) filter (status = 'failed') as failed_source_count, count(*) filter (status in ('partial', 'unsupported')) as degraded_source_count from runs group by run_id")
def run_totals(spark, sf_dir):
    return R.totals(views.run_sources(spark, sf_dir))


_ORDER = "case {} when 'failed' then 0 when 'unsupported' then 1 when 'partial' then 2 else 3 end"
_CHANGE = f"case when a.status is null or b.status is null or a.status = b.status then null when {_ORDER.format('b.status')} > {_ORDER.format('a.status')} then 'improved' else 'regressed' end"


@query(
    "with" + RUNS_SQL + f""", ids as (select max(run_id) as after, min(run_id) as before from (select distinct run_id from runs order by 1 desc limit 2)),
a as (select * from runs where run_id = (select before from ids)), b as (select * from runs where run_id = (select after from ids))
select coalesce(a.source, b.source) as source, a.status as from_status, b.status as to_status, coalesce(b.conversation_count, 0) - coalesce(a.conversation_count, 0) as delta_conversation_count,
  case when a.source is null then 'added' when b.source is null then 'removed' else 'both' end as presence, {_CHANGE} as change from a full join b on a.source = b.source"""
)
def run_diff(spark, sf_dir):
    rows = views.run_sources(spark, sf_dir)
    after, before = R.latest_runs(rows, 2)
    return R.diff(rows, before, after).select("source", "from_status", "to_status", "delta_conversation_count", "presence", "change")


_TREND_SQL = "with" + RUNS_SQL + f""", b as (select *, lag(status) over (partition by source order by run_id) as previous_status,
  count(*) filter (status = 'failed') over (partition by source order by run_id) / count(*) over (partition by source order by run_id) as failed_ratio from runs),
t as (select b.*, case when previous_status <> status then previous_status || '_to_' || status end as transition,
  case when previous_status is null or previous_status = status then null when {_ORDER.format('status')} > {_ORDER.format('previous_status')} then 'improved' else 'regressed' end as category from b)
"""


@query(_TREND_SQL + "select source, run_id, status, previous_status, transition, category, failed_ratio from t")
def run_trend(spark, sf_dir):
    return R.trend(views.run_sources(spark, sf_dir)).select("source", "run_id", "status", "previous_status", "transition", "category", "failed_ratio")


@query(
    _TREND_SQL + """select source, min(run_id) as first_run_id, max(run_id) as latest_run_id, arg_max(status, run_id) as latest_status, count(*) filter (status = 'complete') as complete_count,
  count(*) filter (status = 'partial') as partial_count, count(*) filter (status = 'unsupported') as unsupported_count, count(*) filter (status = 'failed') as failed_count,
  count(*) filter (category = 'improved') as improved, count(*) filter (category = 'regressed') as regressed, count(*) filter (category = 'changed') as changed,
  count(*) filter (previous_status in ('partial', 'unsupported') and status = 'complete') as recovered from t group by source"""
)
def run_trend_summary(spark, sf_dir):
    return R.trend_summary(R.trend(views.run_sources(spark, sf_dir)))


@query("with" + RUNS_SQL + "select source, case when status <> 'complete' then 'failed_or_degraded' else 'included' end as reason from runs where run_id = (select max(run_id) from runs) and (status <> 'complete' or source = 'click') and source <> 'error'")
def rerun_plan(spark, sf_dir):
    rows = views.run_sources(spark, sf_dir)
    return R.rerun_plan(rows, R.latest_runs(rows)[0], include=("click",), exclude=("error",))


@query("with" + RUNS_SQL + "select run_id, row_number() over (order by run_id desc) as recency, row_number() over (order by run_id desc) > 3 as pruned from (select distinct run_id from runs)")
def prune_plan(spark, sf_dir):
    rows = views.run_sources(spark, sf_dir).select("run_id", F.lit(None).cast("string").alias("completed_at"), F.lit(None).cast("string").alias("started_at")).distinct()
    return R.prune_plan(rows, keep_last=3).select("run_id", "recency", "pruned")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))


_EVENTS_SQL = "with e as (select *, cast(floor(epoch(ts)) as bigint) as s from events)"


@query(
    _EVENTS_SQL + """, p as (select a.event_id, b.event_id as match_id, abs(a.s - b.s) as distance from e a join e b on a.user_id = b.user_id and abs(a.s - b.s) <= 600 where a.event_type = 'click' and b.event_type = 'view'),
r as (select *, rank() over (partition by event_id order by distance) as rank from p)
select event_id, min(match_id) as match_id, min(distance) as distance from r where rank = 1 group by event_id having count(*) = 1"""
)
def nearest_activity(spark, sf_dir):
    e = _events(spark, sf_dir)
    pairs = T.near_in_time(
        e.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("clicked")), e.where("event_type = 'view'").select(F.col("event_id").alias("match_id"), "user_id", F.col("s").alias("viewed")), ["user_id"], "clicked", "viewed", 600
    )
    return T.unique_best(pairs.select("event_id", "match_id", "distance"), "event_id", F.col("distance"))


@query(
    _EVENTS_SQL + """, spans as (select event_id as span_id, user_id, s as start_s, s + 60 + event_id % 900 as end_s from e where event_type = 'view'),
p as (select c.event_id, v.span_id, case when c.s between v.start_s and v.end_s then 0 else 1 end as outside, abs(c.s - v.start_s) as distance
  from e c join spans v on c.user_id = v.user_id and c.s between v.start_s - 120 and v.end_s + 120 where c.event_type = 'click'),
r as (select *, rank() over (partition by event_id order by outside, distance) as rank from p)
select event_id, min(span_id) as span_id from r where rank = 1 group by event_id having count(*) = 1"""
)
def attributed_sessions(spark, sf_dir):
    e = _events(spark, sf_dir)
    spans = e.where("event_type = 'view'").select(F.col("event_id").alias("span_id"), "user_id", F.col("s").alias("start_s"), (F.col("s") + 60 + F.col("event_id") % 900).alias("end_s"))
    points = e.where("event_type = 'click'").select("event_id", "user_id", "s")
    return T.attributed(points, spans, ["user_id"], "event_id", "s", "start_s", "end_s").select("event_id", "span_id")


@query(
    BASE_SQL + """, s1 as (select source_session_id, min(source) as v from base where source_session_id is not null group by 1 having min(source) = max(source)),
a1 as (select source_artifact_path, min(execution_context) as v0, min(source) as v from base where source_artifact_path is not null group by 1 having min(source) = max(source))
select row_number, coalesce(s1.v, a1.v) as owner from allrows left join s1 using (source_session_id) left join a1 using (source_artifact_path)"""
)
def fallback_owner(spark, sf_dir):
    facts = _active(spark, sf_dir).select("source_session_id", "source_artifact_path", F.col("source").alias("owner"))
    return T.by_fallback_keys(views.archive(spark, sf_dir).select("row_number", "source_session_id", "source_artifact_path"), facts, ["source_session_id", "source_artifact_path"], "owner").select("row_number", "owner")


@query(
    """with s as (select o_custkey as k, count(*) as n from orders where o_orderdate < timestamp '2000-01-01' group by 1), f as (select o_custkey as k, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' group by 1)
select 'c' || coalesce(s.k, f.k) as output_path, case when s.k is null then 'added' when f.k is null then 'removed' else 'updated' end as change from s full join f on s.k = f.k where s.n is null or f.n is null or s.n <> f.n"""
)
def index_file_changes(spark, sf_dir):
    """Two listings by date, of all orders up to 1999 and of all from 1996 on; together they hold every order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def listing(condition: str) -> DataFrame:
        return orders.where(condition).groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("output_path")).agg(F.count("*").alias("size_bytes")).withColumn("modified", F.lit(0))

    return file_changes(listing("o_orderdate < timestamp '2000-01-01'"), listing("o_orderdate >= timestamp '1996-01-01'"))


@query()
def archive_digest(spark, sf_dir):
    rows = _active(spark, sf_dir)
    latest = views.run_sources(spark, sf_dir).groupBy(F.expr("concat('src', length(source) % 3)").alias("source")).agg(F.max_by("status", F.struct("run_id", "source")).alias("status"))
    every = views.archive(spark, sf_dir)
    return V.digest(A.stats(rows), V.rollup(every, V.findings(every)), A.source_anomalies(rows, low_messages=3), latest)


_QUOTED = "coalesce(cast(to_json({0}) as varchar), 'null')"


@query(
    BASE_SQL + f""", f as (select conv_id, sha256('[' || string_agg('{{"role":' || {_QUOTED.format("role")} || ',"text":' || {_QUOTED.format("text")} || '}}', ',' order by message_index) || ']') as fingerprint from msg group by 1)
select row_number, fingerprint, 'sha256:' || sha256(case when source_session_id is not null then '{{"identity_basis":"source_session_id","source":"' || source || '","source_session_id":"' || source_session_id || '"}}'
    when source_artifact_path is not null then '{{"identity_basis":"source_artifact_path","source":"' || source || '","source_artifact_path":"' || source_artifact_path || '"}}'
    else '{{"collected_at":"' || collected_at || '","identity_basis":"content_fingerprint","message_fingerprint":"' || fingerprint || '","source":"' || source || '"}}' end) as conversation_id,
  'sha256:' || sha256('{{"message_fingerprint":"' || fingerprint || '","source":"' || source || '","source_artifact_path":' || {_QUOTED.format("source_artifact_path")} || ',"source_session_id":' || {_QUOTED.format("source_session_id")} || '}}') as dedupe_key
from base join f using (conv_id)"""
)
def conversation_digests(spark, sf_dir):
    rows = _active(spark, sf_dir)
    own = S.message_fingerprint(F.col("messages"))
    keyed = M.memory_records(rows, own).join(rows.select("row_number", own.alias("fingerprint"), S.dedupe_key(F.col("source"), F.col("source_session_id"), F.col("source_artifact_path"), own).alias("dedupe_key")), "row_number")
    return keyed.select("row_number", "conversation_id", "fingerprint", "dedupe_key")
