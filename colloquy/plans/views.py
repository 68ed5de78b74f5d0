"""Archive, run and policy frames over the driver's tables, for the registered queries.

The tables hold turns of conversations and events, not an archive; the missing
columns are derived from the ids, so that every operator has rows of each kind.
`BASE_SQL` and `RUNS_SQL` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CONTRACT, MESSAGE


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, superseded ones too."""
    grouped = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    message = F.expr(
        f"transform(turns, t -> cast(named_struct('role', t.role, 'text', t.text, 'images', null, 'timestamp', null, 'source_message_id', null, 'provenance', null) as {MESSAGE}))"
    )
    return grouped.selectExpr(
        "concat('src', conv_id % 3) as source", "if(conv_id % 2 = 0, 'cli', 'ide') as execution_context",
        "concat('2024-01-', lpad(cast(1 + conv_id % 28 as string), 2, '0'), 'T00:00:00Z') as collected_at", "turns", "conv_id",
        f"cast(named_struct('schema_version', if(conv_id % 11 = 0, '2026-03-18', '2026-03-19'), 'archive_kind', 'chat', 'focus', null, 'allowed_roles', null, 'excluded_artifacts', null) as {CONTRACT}) as contract",
        "case conv_id % 10 when 0 then 'unsupported' when 1 then 'partial' when 2 then 'partial' end as transcript_completeness",
        "case conv_id % 4 when 1 then array('no tools') when 2 then array('no images', 'no tools') end as limitations",
        "if(conv_id % 7 = 0, null, concat('s', conv_id div 6)) as source_session_id", "if(conv_id % 5 = 0, null, concat('a', conv_id % 40)) as source_artifact_path",
        "cast(null as string) as session_metadata", """if(conv_id % 3 = 1, '{"originator":"x"}', null) as provenance""",
        "if(conv_id % 13 = 0, '2024-02-01T00:00:00Z', null) as superseded_at", "concat('src', conv_id % 3) as source_dir",
        "concat('src', conv_id % 3, '/f', conv_id % 4) as output_path", "conv_id as row_number",
    ).withColumn("messages", message).drop("turns", "conv_id")


BASE_SQL = """
with msg as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as message_index, role, text from conversations),
allrows as (
  select conv_id, count(*) as message_count, sum(case when trim(text) <> '' then 1 else 0 end) as text_messages, sum(length(text)) as text_size,
    string_agg(role || ': ' || (case when text = '' then '[empty]' else text end), chr(10) || chr(10) order by message_index) as transcript,
    'src' || (conv_id % 3) as source, case when conv_id % 2 = 0 then 'cli' else 'ide' end as execution_context,
    '2024-01-' || lpad(cast(1 + conv_id % 28 as varchar), 2, '0') || 'T00:00:00Z' as collected_at,
    case when conv_id % 10 = 0 then 'unsupported' when conv_id % 10 in (1, 2) then 'partial' else 'complete' end as transcript_completeness,
    case when conv_id % 4 = 1 then 1 when conv_id % 4 = 2 then 2 else 0 end as limitation_count,
    case when conv_id % 7 = 0 then null else 's' || (conv_id // 6) end as source_session_id,
    case when conv_id % 5 = 0 then null else 'a' || (conv_id % 40) end as source_artifact_path,
    conv_id % 3 = 1 as has_provenance, 'src' || (conv_id % 3) || '/f' || (conv_id % 4) as output_path, conv_id as row_number
  from msg group by conv_id),
base as (select * from allrows where conv_id % 13 <> 0)
"""


def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each day of events, a source for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    grouped = events.groupBy(F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("event_type").alias("source")).agg(F.count("*").alias("conversation_count"), F.count_distinct("user_id").alias("message_count"))
    status = F.expr("element_at(array('failed', 'partial', 'unsupported', 'complete'), cast(conversation_count % 4 as int) + 1)")
    return grouped.withColumn("status", status)


RUNS_SQL = """
runs as (
  select strftime(ts, '%Y%m%d') as run_id, event_type as source, count(*) as conversation_count, count(distinct user_id) as message_count,
    case count(*) % 4 when 0 then 'failed' when 1 then 'partial' when 2 then 'unsupported' else 'complete' end as status
  from events group by 1, 2)
"""


#: Entries of a baseline policy: id, kind, source, report, code, limitation.
POLICY = [
    ("p1", "finding", "src1", "verify", "incomplete_transcript", None), ("p2", "degraded_source", "src1", None, None, None), ("p3", "limitation", "src2", None, None, "no tools"),
    ("p4", "limitation", "src2", None, None, "no images"), ("p5", "limitation", "src0", None, None, "no tools"), ("p6", "finding", "src2", "verify", "invalid_contract", None),
]


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "id string, kind string, source string, report string, code string, limitation string")
