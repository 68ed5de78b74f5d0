"""Registered queries of verification, validation and policies, over raw rows with breaches and the manifests of runs.

The rows are the conversations as JSON lines, of which some are broken by their number;
`LINES_SQL` says which findings each must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import checks as C
from ..operators import runs as R
from . import views
from .queries import QUERIES, SQL, query
from .views import BASE_SQL, RUNS_SQL

__all__ = ["QUERIES", "SQL"]

ROOT = "/archive"
#: Rows are broken in one way for each remainder of their number: 0 and 1 are no JSON objects, then: no source, another source, an empty time, no contract, no messages, an unknown role in each message.
EVERY = 23


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_dir, output_path, row_number, line) of the conversations, some of them broken."""
    k = F.col("row_number") % EVERY
    rows = views.archive(spark, sf_dir).withColumns({
        "source": F.when(k == 3, "other").when(k != 2, F.col("source")), "collected_at": F.when(k == 4, "").otherwise(F.col("collected_at")), "contract": F.when(k != 5, F.col("contract")),
        "messages": F.when(k == 7, F.transform("messages", lambda m: m.withField("role", F.lit("tool")))).when(k != 6, F.col("messages")),
    })
    whole = F.to_json(F.struct("source", "execution_context", "collected_at", "contract", "transcript_completeness", "limitations", "messages"))
    line = F.when(k == 0, F.concat(F.lit("{"), whole)).when(k == 1, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    # Files f0 and f2 have names of their own, f1 is named by a run, f3 has the canonical name of its source.
    name = F.when(F.col("output_path").endswith("/f3"), F.concat("source_dir", F.lit("/memory_chat_v1-"), "source_dir", F.lit(".jsonl"))).otherwise(F.col("output_path"))
    return rows.select("source_dir", F.concat(F.lit(f"file:{ROOT}/"), name).alias("output_path"), "row_number", line.alias("line"))


LINES_SQL = BASE_SQL + f""", rows as (
  select *, conv_id % {EVERY} as k, 'file:{ROOT}/' || case when output_path like '%/f3' then source || '/memory_chat_v1-' || source || '.jsonl' else output_path end as file from allrows),
broken as (
  select source, file, row_number, 'error' as level, 'malformed_row' as code, 'line' as what from rows where k in (0, 1)
  union all select source, file, row_number, 'error', 'missing_required_field', case k when 2 then 'source' when 5 then 'contract' else 'messages' end from rows where k in (2, 5, 6)
  union all select source, file, row_number, 'error', 'invalid_field', case k when 3 then 'source is another' else 'collected_at' end from rows where k in (3, 4)
  union all select source, file, row_number, 'error', 'invalid_contract', '2026-03-18' from rows where k not in (0, 1, 5) and conv_id % 11 = 0
  union all select source, file, row_number, 'warning', 'incomplete_transcript', transcript_completeness from rows where k not in (0, 1) and transcript_completeness <> 'complete'
  union all select source, file, r.row_number, 'error', 'invalid_enum', 'messages[' || m.message_index || '].role' from rows r join msg m using (conv_id) where k = 7),
verified as (
  select source, file as output_path, row_number, level, code, what from broken
  union all select distinct source, file, cast(null as bigint), 'warning', 'orphan_output_file', 'output_path' from rows where file like '%/f0' or file like '%/f2'
  union all select null, '{ROOT}/runs/' || source || '/manifest.json', null, 'warning', 'invalid_manifest_reference', 'sources[' || i || '].output_path' from (select distinct source from rows), range(2, 4) r(i)
  union all select distinct source, 'file:{ROOT}/' || source || '/gone', cast(null as bigint), 'error', 'missing_file', 'output_path' from rows),
laid as (select *, case when source = 'src1' and code = 'incomplete_transcript' then 'p1' end as suppressed_by from verified)
"""


def _policy(spark: SparkSession) -> DataFrame:
    return views.policy(spark).withColumn("report", F.when(F.col("report") == "verify", "archive_verify").otherwise(F.col("report")))


def _verified(spark: SparkSession, sf_dir: str) -> C.Verified:
    """A run of each source names its file f1, and two paths that are no links; an index knows one file of each source that is gone."""
    own = lines(spark, sf_dir)
    files = own.select("source_dir", "output_path").distinct()
    source = files.select("source_dir").distinct()
    link = F.concat(F.lit(f'{{"sources":[{{"output_path":"{ROOT}/'), "source_dir", F.lit('/f1"},{"output_path":"f1"},{"output_path":"/elsewhere/f1"},{"output_path":null}]}'))
    manifests = source.select(F.col("source_dir").alias("run_id"), F.concat(F.lit(f"{ROOT}/runs/"), "source_dir", F.lit("/manifest.json")).alias("manifest_path"), link.alias("text"))
    gone = source.select("source_dir", F.concat(F.lit(f"file:{ROOT}/"), "source_dir", F.lit("/gone")).alias("output_path"))
    return C.verify(own, files, manifests, ROOT, _policy(spark), files.unionByName(gone))


@query(LINES_SQL + "select * replace (coalesce(row_number, 0) as row_number) from laid")
def archive_verify_findings(spark, sf_dir):
    """Findings of files and manifests have row 0."""
    return _verified(spark, sf_dir).findings.drop("suppression_kind", "suppression_reason").withColumn("row_number", F.coalesce("row_number", F.lit(0)))


_LEVELS_SQL = """count(*) as finding_count, count(*) filter (level = 'warning' and suppressed_by is null) as warning_count, count(*) filter (level = 'warning' and suppressed_by is not null) as suppressed_warning_count, count(*) filter (level = 'error') as error_count"""
_STATUS_SQL = """case when error_count > 0 then 'error' when warning_count > 0 then 'warning' else 'success' end as status, case when error_count > 0 then 'error' when warning_count + suppressed_warning_count > 0 then 'warning' else 'success' end as raw_status"""
_FILES_SQL = LINES_SQL + f""", f as (select source, file as output_path, count(*) as row_count from rows group by 1, 2),
b as (select output_path, count(distinct row_number) as bad_row_count from laid where level = 'error' and row_number is not null group by 1),
c as (select output_path, {_LEVELS_SQL} from laid where source is not null group by 1),
files as (select f.source, f.output_path, f.output_path like '%/f1' as manifest_linked, f.output_path like '%/f0' or f.output_path like '%/f2' as orphan, row_count, coalesce(bad_row_count, 0) as bad_row_count, row_count - coalesce(bad_row_count, 0) as verified_row_count,
    coalesce(finding_count, 0) as finding_count, coalesce(warning_count, 0) as warning_count, coalesce(suppressed_warning_count, 0) as suppressed_warning_count, coalesce(error_count, 0) as error_count
  from f left join b using (output_path) left join c using (output_path))
"""


@query(_FILES_SQL + f"select *, {_STATUS_SQL} from files")
def archive_verify_files(spark, sf_dir):
    return _verified(spark, sf_dir).files


@query(
    _FILES_SQL + f""", g as (select source, {_LEVELS_SQL} from laid where source is not null group by 1),
h as (select source, count(*) as file_count, count(*) filter (orphan) as orphan_file_count, cast(sum(row_count) as bigint) as row_count, cast(sum(verified_row_count) as bigint) as verified_row_count, cast(sum(bad_row_count) as bigint) as bad_row_count from files group by 1)
select *, {_STATUS_SQL} from h join g using (source)"""
)
def archive_verify_sources(spark, sf_dir):
    return _verified(spark, sf_dir).sources


#: What the runs declare of each file: of f0 the truth; of f1 one row too many; f2 says complete and failed; f3 is degraded; and of a file that is gone nothing.
DECLARED_SQL = LINES_SQL + f""", own as (
  select source, file as output_path, count(*) as n, cast(coalesce(sum(message_count) filter (k not in (0, 1, 6)), 0) as bigint) as m, case when file like '%.jsonl' then 'f3' else right(file, 2) end as kind from rows group by 1, 2
  union all select distinct source, 'file:{ROOT}/' || source || '/gone', 0, 0, 'gone' from rows),
entries as (select *, '{ROOT}' || substr(output_path, {len("file:" + ROOT) + 1}) as path, n + case when kind = 'f1' then 1 else 0 end as written from own),
validated as (
  select source, null as output_path, cast(null as bigint) as row_number, 'success' as level, 'manifest_loaded' as code, 'manifest' as what, null as suppressed_by from (select distinct source from rows)
  union all select source, null, null, 'error', 'count_mismatch', 'message_count', null from (select distinct source from rows)
  union all select source, path, null, 'error', 'count_mismatch', 'skipped and written', null from entries where kind = 'f1'
  union all select source, path, null, 'error', 'count_mismatch', 'written_conversation_count', null from entries where kind = 'f1'
  union all select source, path, null, 'error', 'status_mismatch', 'failed', null from entries where kind = 'f2'
  union all select source, path, null, 'warning', 'degraded_support_level', 'partial', case when source = 'src1' then 'p2' end from entries where kind = 'f3'
  union all select source, path, null, 'warning', 'degraded_source_status', 'partial', case when source = 'src1' then 'p2' end from entries where kind = 'f3'
  union all select source, path, null, 'error', 'missing_file', 'output_path', null from entries where kind = 'gone'
  union all select source, file, row_number, level, code, what, null from broken where code <> 'invalid_contract')
"""


def _validated(spark: SparkSession, sf_dir: str) -> C.Validated:
    own = lines(spark, sf_dir)
    path = C.file_path(F.col("output_path"))
    spoken = F.when((F.col("row_number") % EVERY).isin(0, 1, 6), 0).otherwise(C.message_count(own))
    files = own.groupBy("source_dir", "output_path").agg(F.count("*").alias("n"), F.sum(spoken).alias("m"))
    gone = files.select("source_dir").distinct().select("source_dir", F.concat(F.lit(f"file:{ROOT}/"), "source_dir", F.lit("/gone")).alias("output_path"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))
    name = F.element_at(F.split("output_path", "/"), -1)
    f3 = name.endswith(".jsonl")
    entry = F.struct(
        F.col("source_dir").alias("source"), F.when(f3, "partial").otherwise("complete").alias("support_level"), F.when(f3, "partial").otherwise("complete").alias("status"), F.lit(ROOT).alias("archive_root"), path.alias("output_path"),
        F.col("n").alias("scanned_artifact_count"), F.col("n").alias("conversation_count"), F.lit(0).alias("skipped_conversation_count"), (F.col("n") + (name == "f1").cast("int")).alias("written_conversation_count"), F.col("m").alias("message_count"),
        (name == "f2").alias("failed"), f3.alias("partial"), F.lit(False).alias("unsupported"),
    )
    runs = files.unionByName(gone).groupBy("source_dir").agg(F.sort_array(F.collect_list(entry)).alias("sources"))
    total = lambda of, more=0: (F.aggregate("sources", F.lit(0).cast("bigint"), lambda n, s: n + s[of]) + more).alias(of)
    folder = F.concat(F.lit(f"{ROOT}/runs/"), "source_dir")
    payload = F.struct(
        F.col("source_dir").alias("run_id"), F.lit(ROOT).alias("archive_root"), folder.alias("run_dir"), F.concat(folder, F.lit("/manifest.json")).alias("manifest_path"), F.size("sources").alias("source_count"),
        F.size(F.filter("sources", lambda s: s["failed"])).alias("failed_source_count"), total("conversation_count"), total("skipped_conversation_count"), total("written_conversation_count"), total("message_count", 1), "sources",
    )
    manifests = runs.select(F.col("source_dir").alias("run_id"), F.concat(folder, F.lit("/manifest.json")).alias("manifest_path"), F.to_json(payload).alias("text"))
    return C.validate(manifests, files, own, ROOT, _policy(spark))


@query(DECLARED_SQL + """select source as run_id, case when code in ('manifest_loaded') or (code = 'count_mismatch' and what = 'message_count') then '/archive/runs/' || source || '/manifest.json' else output_path end as output_path, coalesce(row_number, 0) as row_number, level, code, what, suppressed_by from validated
union all select source, path, 0, 'success', 'source_validated', 'source', null from entries e where not exists (select 1 from validated v where v.output_path in (e.path, e.output_path))""")
def validate_findings(spark, sf_dir):
    return _validated(spark, sf_dir).findings.select("run_id", "output_path", F.coalesce("row_number", F.lit(0)).alias("row_number"), "level", "code", "what", "suppressed_by")


@query(
    DECLARED_SQL + f""", t as (select coalesce(e.path, v.output_path) as path, level, suppressed_by from validated v left join entries e on v.output_path = e.output_path where v.output_path is not null),
l as (select path as output_path, {_LEVELS_SQL} from t group by 1)
select source as run_id, e.path as output_path, n as row_count, m as actual_message_count, coalesce(finding_count, 0) as finding_count, coalesce(warning_count, 0) as warning_count, coalesce(suppressed_warning_count, 0) as suppressed_warning_count, coalesce(error_count, 0) as error_count,
  case when coalesce(error_count, 0) > 0 then 'error' when coalesce(warning_count, 0) > 0 then 'warning' else 'success' end as validation_status from entries e left join l on l.output_path = e.path"""
)
def validate_sources(spark, sf_dir):
    return _validated(spark, sf_dir).sources.select("run_id", "output_path", "row_count", "actual_message_count", "finding_count", "warning_count", "suppressed_warning_count", "error_count", "validation_status")




@query(
    BASE_SQL + """, a as (select *, message_count <= 3 as low, limitation_count >= 2 as many, transcript_completeness = 'unsupported' as uns from base),
b as (select *, low or (many and source <> 'src2') or (uns and source <> 'src1') as open from a)
select source, count(*) filter (low or many or uns) as suspicious_conversation_count, count(*) filter (open) as active_suspicious_conversation_count, count(*) filter ((low or many or uns) and not open) as suppressed_suspicious_conversation_count,
  count(*) filter (uns) >= 1 and count(*) filter (uns) / count(*) >= 0.01 as high_unsupported_ratio, case when source = 'src1' and count(*) filter (uns) >= 1 and count(*) filter (uns) / count(*) >= 0.01 then 'p2' end as suppressed_by,
  count(*) filter (uns) >= 1 and count(*) filter (uns) / count(*) >= 0.01 and source <> 'src1' as active_high_unsupported_ratio from b group by 1"""
)
def active_anomalies(spark, sf_dir):
    rows, policy = A.active(views.archive(spark, sf_dir)), views.policy(spark)
    found = A.active_anomalies(A.source_anomalies(rows, low_messages=3, unsupported_count=1, unsupported_ratio=0.01), A.suppressed_reasons(A.anomalies(rows, low_messages=3), policy), policy)
    return found.select("source", "suspicious_conversation_count", "active_suspicious_conversation_count", "suppressed_suspicious_conversation_count", "high_unsupported_ratio", "suppressed_by", "active_high_unsupported_ratio")


#: Runs with the file that each source writes: f4 is in no archive, a failed source has none.
_HISTORY = BASE_SQL + f""", {RUNS_SQL.strip()},
h as (select *, case when status <> 'failed' then 'src' || (length(source) % 3) || '/f' || (conversation_count % 5) end as output_path, case when status = 'partial' then 'partial' else 'complete' end as support_level,
  case when status = 'failed' then 'broken' end as failure_reason, conversation_count // 3 as skipped from runs)
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, status = F.col("conversation_count"), F.col("status")
    file = F.concat(F.lit("src"), (F.length("source") % 3).cast("string"), F.lit("/f"), (n % 5).cast("string"))
    return views.run_sources(spark, sf_dir).withColumns({
        "output_path": F.when(status != "failed", file), "support_level": F.when(status == "partial", "partial").otherwise("complete"), "failure_reason": F.when(status == "failed", "broken"),
        "scanned_artifact_count": n, "skipped_conversation_count": F.floor(n / 3), "written_conversation_count": n - F.floor(n / 3), "redaction_event_count": F.lit(0).cast("bigint"),
    })


@query(
    _HISTORY + """, s as (select output_path, count(*) as n, cast(sum(message_count) as bigint) as m, count(*) filter (transcript_completeness = 'complete') as c, count(*) filter (limitation_count > 0) as l, min(collected_at) as e from base group by 1)
select run_id, source, status, coalesce(n, 0) as archived_conversations, coalesce(m, 0) as archived_messages, coalesce(c, 0) as archived_complete, coalesce(l, 0) as archived_with_limitations, e as earliest_collected_at, case when s.output_path is null then 0 else 1 end as archived_files,
  case when h.output_path is not null and s.output_path is null then 'the file of the run is not there: ' || h.output_path end as snapshot_error, count(*) filter (status = 'complete') over (partition by source order by run_id) / count(*) over (partition by source order by run_id) as complete_ratio
from h left join s using (output_path)"""
)
def run_trend_snapshots(spark, sf_dir):
    rows = A.active(views.archive(spark, sf_dir))
    found = R.with_snapshots(R.trend(_history(spark, sf_dir)), rows, rows)
    return found.select("run_id", "source", "status", "archived_conversations", "archived_messages", "archived_complete", "archived_with_limitations", "earliest_collected_at", "archived_files", "snapshot_error", "complete_ratio")


_TWO = ", w as (select distinct run_id from runs order by 1 desc limit 2), a as (select * from h where run_id = (select min(run_id) from w) and source <> 'view'), b as (select * from h where run_id = (select max(run_id) from w) and source <> 'click')"


@query(
    _HISTORY + _TWO + """, j as (select coalesce(a.source, b.source) as source, a.source as x, b.source as y, a.status as from_status, b.status as to_status, a.output_path as from_output_path, b.output_path as to_output_path,
  coalesce(b.conversation_count, 0) - coalesce(a.conversation_count, 0) as delta_conversation_count, coalesce(b.skipped, 0) - coalesce(a.skipped, 0) as delta_skipped_conversation_count, coalesce(b.message_count, 0) - coalesce(a.message_count, 0) as delta_message_count,
  coalesce(a.conversation_count, 0) <> coalesce(b.conversation_count, 0) or coalesce(a.message_count, 0) <> coalesce(b.message_count, 0) or a.status is distinct from b.status or a.output_path is distinct from b.output_path as changed from a full join b on a.source = b.source)
select source, from_status, to_status, from_output_path, to_output_path, delta_conversation_count, delta_skipped_conversation_count, delta_message_count, changed, case when x is null then 'added' when y is null then 'removed' when changed then 'changed' else 'unchanged' end as change_type,
  case when from_status <> to_status then from_status || '_to_' || to_status end as transition from j"""
)
def run_source_diff(spark, sf_dir):
    """The two newest runs; the earlier did not have views, the later does not have clicks."""
    rows = _history(spark, sf_dir)
    after, before = R.latest_runs(rows, 2)
    own = rows.where(((F.col("run_id") == before) & (F.col("source") != "view")) | ((F.col("run_id") == after) & (F.col("source") != "click")))
    names = ("source", "from_status", "to_status", "from_output_path", "to_output_path", "delta_conversation_count", "delta_skipped_conversation_count", "delta_message_count", "changed", "change_type", "transition")
    return R.source_diff(own, before, after).select(*names)


@query(
    _HISTORY + """, w as (select distinct run_id from runs order by 1 desc limit 2), lo as (select min(run_id) as r from w), hi as (select max(run_id) as r from w),
a as (select * from h, lo where run_id = r), b as (select * from h, hi where run_id = r),
sel as (select 'selected' as kind, case when x is null then 'added' else 'removed' end as change, source, cast(null as varchar) as was, cast(null as varchar) as now from (
  select coalesce(p.source, q.source) as source, p.source as x, q.source as y from (select source from a where status = 'complete') p full join (select source from b where status = 'complete') q on p.source = q.source) where x is null or y is null),
exc as (select 'excluded' as kind, case when x is null then 'added' when y is null then 'removed' else 'changed' end as change, source, x as was, y as now from (
  select coalesce(p.source, q.source) as source, p.status as x, q.status as y from (select source, status from a where status <> 'complete') p full join (select source, status from b where status <> 'complete') q on p.source = q.source) where x is distinct from y)
select * from sel union all select * from exc"""
)
def run_policy_diff(spark, sf_dir):
    """Runs that select their complete sources and leave out the others, by the reason of their status."""
    rows = _history(spark, sf_dir)
    entry = F.struct("source", "support_level", F.col("status").alias("reason"))
    done = F.col("status") == "complete"
    runs = rows.groupBy("run_id").agg(F.collect_list(F.when(done, F.col("source"))).alias("selected_sources"), F.collect_list(F.when(~done, entry)).alias("excluded_sources"))
    after, before = R.latest_runs(rows, 2)
    reason = lambda c: F.get_json_object(c, "$.reason")
    return R.policy_diff(runs, before, after).select("kind", "change", "source", reason("from_entry").alias("was"), reason("to_entry").alias("now"))
