"""Registered queries of the index on disk, of collection into an archive, baselines, readiness and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import readiness as D
from ..operators import verify as V
from ..operators.runs import latest_runs
from ..session import checkpointed
from ..sources import archive as files
from ..sources.batch import write_incremental_sources
from ..sources.collectors import provider_candidates, provider_class
from ..sources.index import ensure_index, read_index
from . import views
from .maintenance import _MERGED, _ON_DISK, _halves, stored
from .queries import QUERIES, SQL, query
from .views import BASE_SQL, POLICY, RUNS_SQL
from .writing import scratch

__all__ = ["QUERIES", "SQL"]


@query(_ON_DISK.format("allrows"))
def archive_index_rows(spark, sf_dir):
    with stored(spark, sf_dir) as root:
        if not ensure_index(spark, root).ready:
            raise ValueError(f"the index of {root} is not ready")
        limited = F.size(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitation_count")
        row_id = F.split("source_session_id", "/")[0].cast("bigint").alias("row_id")
        return checkpointed(read_index(spark, root).select("source", row_id, F.size("messages").alias("message_count"), S.completeness(F.col("transcript_completeness")).alias("transcript_completeness"), limited, F.sha2(S.transcript(F.col("messages")), 256).alias("transcript_sha256")))


@query(_MERGED + "select d.source, sha256(b.transcript) as transcript_sha256, not new and won as superseded from d join base b using (row_number) where not new or (won and sel = winner)")
def incremental_collect(spark, sf_dir):
    """Conversations of odd number merged into an archive on disk that holds those of even number; superseded rows are marked in their files."""
    old, new = _halves(spark, sf_dir)
    with scratch(spark) as root:
        files.write_archive(old, root)
        write_incremental_sources(spark, root, new, "2024-03-01T00:00:00Z")
        rows = files.read_archive(spark, root, include_superseded=True)
        return checkpointed(rows.select("source", F.sha2(S.transcript(F.col("messages")), 256).alias("transcript_sha256"), (~S.is_active(F.col("superseded_at"))).alias("superseded")))


_SNAPSHOT = BASE_SQL + f""", {RUNS_SQL.strip()},
odd as (select * from base where message_count <= 3 or limitation_count >= 2 or transcript_completeness = 'unsupported'),
snap as (select distinct 'finding' as kind, source, 'verify' as report, 'incomplete_transcript' as code, cast(null as varchar) as limitation, cast(null as varchar) as status from allrows where transcript_completeness <> 'complete'
union all select distinct 'limitation', source, null, null, 'no tools', null from odd where limitation_count >= 1
union all select distinct 'limitation', source, null, null, 'no images', null from odd where limitation_count = 2
union all select 'degraded_source', source, null, null, null, status from runs where run_id = (select max(run_id) from runs) and status <> 'complete')
"""


def _snapshot(spark, sf_dir):
    every = views.archive(spark, sf_dir)
    runs = views.run_sources(spark, sf_dir)
    latest = runs.where(F.col("run_id").isin(latest_runs(runs))).withColumn("support_level", F.lit("complete"))
    found = D.finding_entries(V.findings(every).withColumnRenamed("source_dir", "source"), "verify")
    return found.unionByName(D.limitation_entries(A.anomalies(A.active(every), low_messages=3))).unionByName(D.degraded_entries(latest))


@query(_SNAPSHOT + "select * from snap")
def baseline_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir).drop("support_level")


_POLICY_SQL = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in row) + ")" for row in POLICY)


@query(
    _SNAPSHOT + f""", policy(id, kind, source, report, code, limitation) as (values {_POLICY_SQL})
select kind, source, report, code, limitation, null as status, false as added from policy
union all select *, true from snap s where not exists (select 1 from policy p where s.status is null and p.kind = s.kind and p.source = s.source
  and p.report is not distinct from s.report and p.code is not distinct from s.code and p.limitation is not distinct from s.limitation)"""
)
def baseline_merge(spark, sf_dir):
    return D.merged_policy(views.policy(spark), _snapshot(spark, sf_dir)).drop("id", "support_level")


_SOURCES_SQL = "with" + RUNS_SQL + ", s as (select *, conversation_count // 2 % 3 as scanned, message_count % 2 as written, conversation_count % 4 = 0 as failed from runs)"


def _run_sources(spark, sf_dir):
    n, m = F.col("conversation_count"), F.col("message_count")
    return views.run_sources(spark, sf_dir).withColumns({"scanned_artifact_count": F.floor(n / 2) % 3, "written_conversation_count": m % 2, "failed": n % 4 == 0})


@query(
    _SOURCES_SQL + """select run_id, source, 'source_failed' as code from s where failed union all select run_id, source, 'source_missing_artifacts' from s where not failed and scanned = 0
union all select run_id, source, 'source_no_written_conversations' from s where not failed and written = 0
union all select run_id, source, 'source_unexpected_degraded' from s where not failed and status <> 'complete' and source <> 'click'"""
)
def acceptance_findings(spark, sf_dir):
    return D.acceptance_findings(_run_sources(spark, sf_dir), may_be_degraded=("click",))


@query(
    _SOURCES_SQL + """, r as (select run_id, source, scanned as observed, written as reconstructed, conversation_count % 5 as roots, case when length(source) % 2 = 0 then 'partial' else 'complete' end as level from s)
select run_id, source, observed > 0 and reconstructed = 0 as drift_suspected,
  case when roots = 0 then 'missing' when (observed > 0 and reconstructed = 0) or observed = 0 or level <> 'complete' then 'partial-ready' else 'ready' end as status from r"""
)
def source_readiness(spark, sf_dir):
    level = F.when(F.length("source") % 2 == 0, "partial").otherwise("complete").alias("support_level")
    rows = _run_sources(spark, sf_dir).select("run_id", "source", level, (F.col("conversation_count") % 5).alias("readable_root_count"), F.col("scanned_artifact_count").alias("observed"), F.col("written_conversation_count").alias("reconstructed"))
    return D.readiness(rows).select("run_id", "source", "drift_suspected", "status")


@query(
    """with c as (select page_id, url, case page_id % 4 when 0 then 'Gemini Code' when 1 then 'GitHub Copilot' when 2 then 'Acme' end as name from pages),
f as (select *, case when name ilike '%gemini%' then name when url ilike '%gemini%' then url end as g, case when name ilike '%copilot%' then name when regexp_matches(lower(url), 'copilot|claude|cursor|openai\\.chatgpt') then url end as h from c)
select page_id, case when g is not null then 'gemini' when h is not null then 'foreign' else 'unknown' end as provider, coalesce(g, h, name, url) as candidate from f"""
)
def provider_classification(spark, sf_dir):
    """A chat session for each page, that names one of three providers or none, and its url."""
    name = F.get(F.array(F.lit("Gemini Code"), F.lit("GitHub Copilot"), F.lit("Acme")), (F.col("page_id") % 4).cast("int"))
    session = F.struct(name.alias("responderUsername"), F.struct(F.struct(F.col("url").alias("provider")).alias("metadata")).alias("selectedModel"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.parse_json(F.to_json(session)).alias("v"))
    return pages.select("page_id", provider_class(provider_candidates(F.col("v"))).alias("c")).select("page_id", "c.provider", "c.candidate")
