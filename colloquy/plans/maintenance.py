"""Registered queries of lookups, maintenance, imports and attribution, and of an archive that is written to disk and read back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import attribution as T
from ..operators import identity as I
from ..operators import memory as M
from ..operators import runs as R
from ..operators import verify as V
from ..session import checkpointed
from ..sources import archive as files
from . import views
from .queries import QUERIES, SQL, query
from .views import BASE_SQL, RUNS_SQL
from .writing import scratch

__all__ = ["QUERIES", "SQL"]


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active(views.archive(spark, sf_dir))


@query(BASE_SQL + "select source, row_number, message_count from base where source = 'src1' and source_session_id = 's2'")
def archive_show(spark, sf_dir):
    return A.summaries(A.show(_active(spark, sf_dir), "src1", "s2")).select("source", "row_number", "message_count")


@query(BASE_SQL + "select b.output_path, b.row_number, m.message_index from base b join msg m using (conv_id) where length(m.text) % 7 = 0 order by 1, 2, 3 limit 1")
def invalid_role_guard(spark, sf_dir):
    odd = F.transform("messages", lambda m: m.withField("role", F.when(F.length(m["text"]) % 7 == 0, "tool").otherwise(m["role"])))
    return A.first_invalid_role(_active(spark, sf_dir).withColumn("messages", odd)).select("output_path", "row_number", "message_index")


_ON_DISK = BASE_SQL + "select source, conv_id as row_id, message_count, transcript_completeness, limitation_count, sha256(transcript) as transcript_sha256 from {}"


@contextmanager
def stored(spark: SparkSession, sf_dir: str):
    """Root of an archive in the shared folder, with all conversations; the session id of each begins with its number."""
    with scratch(spark) as root:
        files.write_archive(views.archive(spark, sf_dir).withColumn("source_session_id", F.concat(F.col("row_number"), F.lit("/"), F.coalesce("source_session_id", F.lit("")))), root)
        yield root


@query(_ON_DISK.format("base"))
def archive_scan(spark, sf_dir):
    with stored(spark, sf_dir) as root:
        rows = files.read_archive(spark, root)
        limited = F.size(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitation_count")
        row_id = F.split("source_session_id", "/")[0].cast("bigint").alias("row_id")
        return checkpointed(rows.select("source", row_id, F.size("messages").alias("message_count"), S.completeness(F.col("transcript_completeness")).alias("transcript_completeness"), limited, F.sha2(S.transcript(F.col("messages")), 256).alias("transcript_sha256")))


@query(BASE_SQL + "select source as source_dir, count(*) as row_count, 0 as invalid_count from allrows group by 1")
def archive_scan_validated(spark, sf_dir):
    with stored(spark, sf_dir) as root:
        lines = files.read_lines(spark, root)
        bad = files.invalid_rows(lines).groupBy("source_dir").agg(F.count("*").alias("invalid_count"))
        return checkpointed(lines.groupBy("source_dir").agg(F.count("*").alias("row_count")).join(bad, "source_dir", "left").withColumn("invalid_count", F.coalesce("invalid_count", F.lit(0))))


@query(BASE_SQL + "select distinct source as source_dir, output_path from allrows where output_path not like '%/f1' and output_path not like '%/f3'")
def orphan_files(spark, sf_dir):
    """Files f1 are named by a run, files f3 have the canonical name."""
    own = views.archive(spark, sf_dir).select("source_dir", "output_path").distinct()
    named = F.when(F.col("output_path").endswith("/f3"), F.concat("source_dir", F.lit(f"/{V.CANONICAL[0]}"), "source_dir", F.lit(V.CANONICAL[1]))).otherwise(F.col("output_path"))
    return V.orphans(own.withColumn("output_path", named), own.where(F.col("output_path").endswith("/f1")))


@query(
    BASE_SQL + """select conv_id as row_number, case when transcript_completeness = 'complete' then 'invalid_contract' else 'incomplete_transcript|invalid_contract' end as codes from allrows where conv_id % 11 = 0"""
)
def quarantine_rows(spark, sf_dir):
    rows = views.archive(spark, sf_dir)
    found = V.quarantine(rows.select("output_path", "row_number", S.conversation_json("source", "collected_at").alias("line")), V.findings(rows))
    return found.select("row_number", F.array_join(F.transform("findings", lambda f: f["code"]), "|").alias("codes"))


@query(
    BASE_SQL + """, f as (select source, output_path, count(*) as n from allrows group by 1, 2)
select source, output_path, 'conversation_count_mismatch' as code from f where output_path like '%/f1'
union all select source, output_path, 'status_mismatch' from f where output_path like '%/f2'
union all select source, output_path, 'drift_suspected' from f where output_path like '%/f3'
union all select distinct source, source || '/gone', 'missing_file' from f"""
)
def validate_counts(spark, sf_dir):
    """A run that declares one row too many in files f1, a failure as complete in f2, no rows of a scan in f3, and files that are not there."""
    rows = views.archive(spark, sf_dir)
    own = rows.groupBy("source", "output_path").agg(F.count("*").alias("n"))
    gone = rows.select("source").distinct().select("source", F.concat("source", F.lit("/gone")).alias("output_path"), F.lit(0).cast("bigint").alias("n"))
    at = F.element_at(F.split("output_path", "/"), -1)
    declared = own.unionByName(gone).select(
        F.lit("r1").alias("run_id"), "source", "output_path", (F.col("n") + (at == "f1").cast("int")).alias("written_conversation_count"), F.lit("complete").alias("status"),
        (at == "f2").alias("failed"), F.lit(False).alias("unsupported"), F.lit(False).alias("partial"), F.when(at == "gone", 0).otherwise(1).alias("scanned_artifact_count"), F.when(at == "f3", 0).otherwise(F.col("n")).alias("conversation_count"),
    )
    return V.declared_and_actual(declared, rows).select("source", "output_path", "code")


_RICH = "{'c': case transcript_completeness when 'complete' then 2 when 'partial' then 1 else 0 end, 't': text_messages, 'm': message_count, 's': text_size, 'p': has_provenance, 'l': -limitation_count}"
_SELECT = _RICH[:-1] + ", 'd': collected_at, 'o': output_path, 'r': row_number}"


@query(
    BASE_SQL + f""", k as (select *, {_RICH} as rich, {_SELECT} as sel, coalesce('session:' || source_session_id, 'artifact:' || source_artifact_path, 'exact:' || transcript) as k, row_number % 2 = 1 as new from base),
g as (select source, k, count(*) filter (new) as n, count(*) filter (not new) as old, arg_max(transcript, sel) as best, arg_max(transcript, sel) filter (not new) as before from k group by 1, 2 having count(*) filter (new) > 0),
c as (select source, count(*) filter (old = 0) as imported, count(*) filter (old > 0 and best <> before) as upgraded, cast(sum(n) as bigint) as n from g group by 1)
select source, imported, n - imported - upgraded as skipped, upgraded from c"""
)
def import_change_counts(spark, sf_dir):
    return I.import_changes(*_halves(spark, sf_dir), S.transcript(F.col("messages")))


_MERGED = (
    BASE_SQL.replace("with msg", "with recursive msg") + f""", k as (select *, {_RICH} as rich, {_SELECT} as sel, row_number % 2 = 1 as new,
    case when source_session_id is null and source_artifact_path is null then 'exact:' || transcript end as x from base),
e as (select a.row_number as a, b.row_number as b from k a join k b on a.source = b.source and (a.source_session_id = b.source_session_id or a.source_artifact_path = b.source_artifact_path or a.x = b.x)),
reach(a, b) as (select row_number, row_number from k union select r.a, e.b from reach r join e on r.b = e.a),
m as (select k.*, c.component from k join (select a, min(b) as component from reach group by a) c on c.a = k.row_number),
g as (select component, max(sel) filter (new) as winner, max(rich) filter (new) as new_rich, max(rich) filter (not new) as old_rich from m group by 1),
d as (select m.source, m.row_number, m.new, m.sel, g.winner, g.winner is not null and (g.old_rich is null or g.new_rich > g.old_rich) as won, g.old_rich is null as fresh from m join g using (component))
"""
)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing and incoming rows: conversations of even and of odd number; together all rows."""
    rows = _active(spark, sf_dir)
    return rows.where("row_number % 2 = 0"), rows.where("row_number % 2 = 1")


@query(_MERGED + "select source, row_number, case when fresh then 'insert' else 'upgrade' end as decision from d where new and won and sel = winner")
def incremental_upsert_selected(spark, sf_dir):
    found = I.incremental_merge(*_halves(spark, sf_dir), F.sha2(S.transcript(F.col("messages")), 256))
    return found.where("decision in ('insert', 'upgrade')").select("source", "row_number", "decision")


@query(_MERGED + "select source, row_number, case when not new and won then '2024-03-01T00:00:00Z' end as superseded_at from d where not new or (won and sel = winner)")
def incremental_upsert_superseded(spark, sf_dir):
    return I.merged(*_halves(spark, sf_dir), F.sha2(S.transcript(F.col("messages")), 256), "2024-03-01T00:00:00Z").select("source", "row_number", "superseded_at")


SQL["incremental_merge"] = _MERGED + """select source, (select output_path from base b where b.row_number = d.row_number) as output_path, row_number, new as is_incoming,
  case when new and won and sel = winner then case when fresh then 'insert' else 'upgrade' end when new then 'skip' when won then 'supersede' else 'keep' end as decision from d"""


@query("with" + RUNS_SQL + """, ids as (select run_id, row_number() over (order by run_id desc) as k from (select distinct run_id from runs)),
a as (select source from runs join ids using (run_id) where k = 2 and status <> 'failed'), b as (select source from runs join ids using (run_id) where k = 1 and status <> 'failed')
select 'added' as change, source from (select * from b except select * from a) union all select 'removed', source from (select * from a except select * from b)""")
def selection_set_diff(spark, sf_dir):
    rows = views.run_sources(spark, sf_dir)
    after, before = R.latest_runs(rows, 2)
    return R.selection_diff(rows.where("status <> 'failed'"), before, after)


@query(
    """with u as (select conv_id, list(distinct text) as own from conversations where role = 'user' and turn < 2 group by 1), w as (select conv_id, list(distinct text) as own from conversations where role = 'user' group by 1)
select u.conv_id as left_id, w.conv_id as right_id, len(u.own) as shared from u join w on list_has_all(w.own, u.own)"""
)
def prompt_overlap(spark, sf_dir):
    prompts = views.turns(spark, sf_dir).where("role = 'user'").withColumnRenamed("conv_id", "id")
    some, every = (d.groupBy("id").agg(F.collect_list("text").alias("prompts")) for d in (prompts.where("turn < 2"), prompts))
    return T.overlapping_prompts(some, every)


@query(
    """select a.conv_id, a.turn, b.text is not null as has_body, case when b.text is not null then cast(count(b.text) over (partition by a.conv_id order by a.turn rows unbounded preceding) as bigint) else 0 end as position
from conversations a left join (select conv_id, turn, text from conversations where length(text) % 3 <> 0) b using (conv_id, turn)"""
)
def ordered_bubble_join(spark, sf_dir):
    turns = views.turns(spark, sf_dir)
    bodies = turns.where(F.length("text") % 3 != 0).select("conv_id", "turn", "text")
    return T.in_header_order(turns.select("conv_id", "turn"), bodies, ["conv_id", "turn"], "turn").select("conv_id", "turn", F.col("text").isNotNull().alias("has_body"), F.coalesce("position", F.lit(0)).alias("position"))


@query("select doc_id from labels where doc_id not in (select doc_id from documents where source is not null and doc_id is not null and length(text) > 1000)")
def anti_join_metadata(spark, sf_dir):
    long = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null and length(text) > 1000")
    return T.without_rows(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), long, ["doc_id"])


@query(BASE_SQL + "select row_number from base where row_number in (select distinct conv_id from conversations where role = 'user' and length(text) > 40)")
def semi_join_history(spark, sf_dir):
    history = views.turns(spark, sf_dir).where("role = 'user' and length(text) > 40").select(F.col("conv_id").alias("row_number"))
    return _active(spark, sf_dir).join(history, "row_number", "left_semi").select("row_number")


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def timestamp_normalize(spark, sf_dir):
    """Milliseconds since 1970, as stores keep them, as ISO text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return events.select("event_id", S.epoch_text(millis).alias("at"))


@query(
    BASE_SQL + """, o as (select conv_id, message_index, sha256(role || chr(0) || text) as f, row_number() over (partition by conv_id, role, text order by message_index) as n from msg join base using (conv_id))
select conv_id as row_number, message_index, 'sha256:' || sha256('{"conversation_id":"c' || conv_id || '","message_fingerprint":"' || f || '","message_occurrence":' || n || '}') as message_id from o"""
)
def memory_message_id(spark, sf_dir):
    rows = M.message_records(_active(spark, sf_dir), F.concat(F.lit("c"), F.col("row_number").cast("string")))
    return rows.select("row_number", "message_index", "message_id")


@query("select event_id, json_extract_string(props, '$.k') as k from events where props is not null and json_valid(props)")
def json_field_extraction(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.try_parse_json("props")).where("v is not null")
    return events.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"))


@query(
    BASE_SQL + f"""select (select count(*) from (select distinct source from allrows)) as source_count, (select count(*) from base) as conversation_count, (select cast(sum(message_count) as bigint) from base) as message_count,
  (select count(*) from base where limitation_count > 0) as conversation_with_limitations_count, (select count(*) from base where message_count <= 3 or limitation_count >= 2 or transcript_completeness = 'unsupported') as suspicious_conversation_count,
  (select count(*) from allrows where transcript_completeness <> 'complete') as warning_count, (select count(*) from allrows where conv_id % 11 = 0) as error_count,
  (select count(distinct output_path) from allrows where output_path not like '%/f1') as orphan_file_count, (select count(distinct source) from allrows where output_path not like '%/f1') as sources_with_orphans_count"""
)
def digest_overview(spark, sf_dir):
    every = views.archive(spark, sf_dir)
    rows = A.active(every)
    totals = A.stats(rows)
    none = spark.createDataFrame([], "source string, status string")
    digests = V.digest(totals, V.rollup(every, V.findings(every)), A.source_anomalies(rows, low_messages=3), none)
    own = every.select("source_dir", "output_path").distinct()
    found = V.overview(digests, totals, V.orphans(own, own.where(F.col("output_path").endswith("/f1"))))
    return found.select("source_count", "conversation_count", "message_count", "conversation_with_limitations_count", "suspicious_conversation_count", "warning_count", "error_count", "orphan_file_count", "sources_with_orphans_count")


SQL["identity_reasons"] = BASE_SQL.replace("with msg", "with recursive msg") + f""", e as (
  select a.row_number as a, b.row_number as b from base a join base b on a.source = b.source and (a.source_session_id = b.source_session_id or a.source_artifact_path = b.source_artifact_path)),
reach(a, b) as (select row_number, row_number from base union select r.a, e.b from reach r join e on r.b = e.a),
m as (select base.*, c.component, {_RICH} as rich, {_SELECT} as sel, case when source_session_id is not null and source_artifact_path is not null then 'session_and_artifact'
    when source_session_id is not null then 'session_only' when source_artifact_path is not null then 'artifact_only' else 'unidentified' end as shape
  from base join (select a, min(b) as component from reach group by a) c on c.a = base.row_number),
g as (select source, component, arg_max(row_number, sel) as preferred_row_number, count(distinct transcript) as message_variants, array_to_string(list_sort(list(distinct shape)), '|') as identity_shapes,
  count(source_session_id) as ws, count(distinct source_session_id) as s, count(source_artifact_path) as wa, count(distinct source_artifact_path) as a, count(distinct shape) as shapes, min(rich) < max(rich) as richer from m group by 1, 2 having count(*) > 1)
select source, preferred_row_number, message_variants, identity_shapes, concat_ws('|', case when ws > s then 'duplicate_source_session_id' end, case when wa > a then 'duplicate_source_artifact_path' end,
  case when s > 1 then 'conflicting_source_session_ids' end, case when a > 1 then 'conflicting_source_artifact_paths' end, case when shapes > 1 then 'mixed_identity_shapes' end,
  case when message_variants > 1 then 'message_variants' end, case when richer then 'richer_transcript_available' end) as reasons from g"""

_SUSPICIOUS = "message_count <= 3 or limitation_count >= 2 or transcript_completeness = 'unsupported'"

SQL["archive_digest"] = BASE_SQL + f""", {RUNS_SQL.strip()},
l as (select 'src' || (length(source) % 3) as source, arg_max(status, {{'r': run_id, 's': source}}) as run_status from runs group by 1),
v as (select source, count(*) filter (conv_id % 11 = 0) as error_count, count(*) filter (transcript_completeness <> 'complete') as warning_count from allrows group by 1),
b as (select source, count(*) as conversation_count, cast(sum(message_count) as bigint) as message_count, count(*) filter ({_SUSPICIOUS}) as suspicious_conversation_count,
  count(*) filter (transcript_completeness = 'unsupported') >= 2 and count(*) filter (transcript_completeness = 'unsupported') / count(*) >= 0.5 as high_unsupported_ratio from base group by 1),
j as (select coalesce(b.source, v.source, l.source) as source, coalesce(conversation_count, 0) as conversation_count, coalesce(message_count, 0) as message_count,
  case when v.source is null then null when error_count > 0 then 'error' when warning_count > 0 then 'warning' else 'success' end as verify_status, coalesce(error_count, 0) as error_count, coalesce(warning_count, 0) as warning_count,
  coalesce(suspicious_conversation_count, 0) as suspicious_conversation_count, high_unsupported_ratio, run_status from b full join v on b.source = v.source full join l on l.source = coalesce(b.source, v.source)),
k as (select *, coalesce(run_status <> 'complete', false) or coalesce(verify_status <> 'success', false) or suspicious_conversation_count > 0 or coalesce(high_unsupported_ratio, false) as attention_required from j)
select *, case when verify_status = 'error' or run_status = 'failed' then 'error' when attention_required then 'warning' else 'success' end as status from k"""
