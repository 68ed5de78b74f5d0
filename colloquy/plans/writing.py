"""Registered queries over archives that are written to the shared folder, changed there and read back; the folders are deleted after.

The number of a conversation is kept in the metadata of its row.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import checks as C
from ..session import checkpointed, shared_folder
from ..sources import archive as files
from ..sources import bundles as B
from ..sources import rewrite as R
from ..sources.swap import Store
from . import views
from .queries import QUERIES, SQL, query
from .views import BASE_SQL

__all__ = ["QUERIES", "SQL"]


@contextmanager
def scratch(spark: SparkSession):
    """A folder that is deleted when the work in it is done; what is read from it must be checkpointed before."""
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        Store(spark, folder).delete(folder)


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("session_metadata", F.to_json(F.struct(F.col("row_number").alias("row"))))


def row_id():
    return F.get_json_object("session_metadata", "$.row").cast("bigint").alias("row_id")


_KEYS = "collected_at, coalesce(source_session_id, ''), coalesce(source_artifact_path, '')"
_RICH = "{'c': case transcript_completeness when 'complete' then 2 when 'partial' then 1 else 0 end, 't': text_messages, 'm': message_count, 's': text_size, 'p': has_provenance, 'l': -limitation_count}"
_SELECT = _RICH[:-1] + ", 'd': collected_at, 'r': row_number}"
_KEPT = BASE_SQL + f""", g as (select source, coalesce('session:' || source_session_id, 'artifact:' || source_artifact_path, 'exact:' || conv_id) as k, count(*) as n, arg_max(row_number, {_SELECT}) as best from base group by 1, 2),
kept as (select b.*, g.n from base b join g on b.row_number = g.best)
"""


@query(_KEPT + f"select source, row_number as row_id, 'memory_chat_v1-' || source as file, rank() over (partition by source order by {_KEYS}) as place from kept")
def archive_rewritten(spark, sf_dir):
    """The compacted archive as its canonical files hold it; rows of equal keys have the place of their first."""
    with scratch(spark) as root:
        files.write_archive(numbered(views.archive(spark, sf_dir)), root)
        R.rewrite(spark, root, execute=True)
        rows = files.read_archive(spark, root)
        nth = F.row_number().over(W.partitionBy("source").orderBy("output_path", "row_number"))
        first = F.min("_nth").over(W.partitionBy("source", "collected_at", F.coalesce("source_session_id", F.lit("")), F.coalesce("source_artifact_path", F.lit(""))))
        name = F.regexp_replace(F.element_at(F.split("output_path", "/"), -1), r"(-\d{5})?\.jsonl$", "")
        return checkpointed(rows.withColumn("_nth", nth).withColumn("place", first).select("source", row_id(), name.alias("file"), "place"))


@query(
    _KEPT + """select source as source_dir, cast(sum(n) as bigint) as before_conversation_count, count(*) as after_conversation_count, cast(sum(n - 1) as bigint) as dropped_row_count, count(*) as upgraded_row_count, 0 as untouched_row_count, true as changed from kept group by 1"""
)
def archive_rewrite_plan(spark, sf_dir):
    """What a rewrite would do; no file has a canonical name yet, so every group counts as upgraded."""
    with scratch(spark) as root:
        files.write_archive(numbered(views.archive(spark, sf_dir)), root)
        plan = R.rewrite(spark, root)
        names = ("before_conversation_count", "after_conversation_count", "dropped_row_count", "upgraded_row_count", "untouched_row_count")
        return spark.createDataFrame([(s["source_dir"], *[s[n] for n in names], s["changed"]) for s in plan.sources], "source_dir string, " + ", ".join(f"{n} bigint" for n in names) + ", changed boolean")


@query(BASE_SQL + "select source as source_dir, row_number as row_id, '2026-03-19' as version, conv_id % 11 = 0 as was_moved from allrows")
def archive_migrated(spark, sf_dir):
    """All rows after a migration into another folder, superseded ones too, and whether the archive, which stays, holds them in the version before."""
    with scratch(spark) as root, scratch(spark) as other:
        files.write_archive(numbered(views.archive(spark, sf_dir)), root)
        R.migrate(spark, root, output=other, execute=True)
        after, before = (files.read_archive(spark, folder, include_superseded=True).select("source_dir", row_id(), F.col("contract.schema_version").alias("version")) for folder in (other, root))
        return checkpointed(after.join(before.withColumnRenamed("version", "_was"), ["source_dir", "row_id"]).withColumn("was_moved", F.col("_was") != F.col("version")).drop("_was"))


@query(BASE_SQL + "select row_number as row_id, source, message_count, (select count(*) from base where transcript_completeness = 'partial') as conversation_count, (select cast(sum(message_count) as bigint) from base where transcript_completeness = 'partial') as total_messages from base where transcript_completeness = 'partial'")
def bundle_exported(spark, sf_dir):
    """Rows of a bundle of partial transcripts, with the totals of its manifest; reading it shows that the two agree."""
    with scratch(spark) as root, scratch(spark) as bundle:
        files.write_archive(numbered(views.archive(spark, sf_dir)), root)
        B.export_bundle(spark, root, bundle, execute=True, transcript_completeness="partial")
        rows, manifest = B.read_bundle(spark, bundle)
        totals = [F.lit(manifest["conversation_count"]).alias("conversation_count"), F.lit(manifest["message_count"]).alias("total_messages")]
        return checkpointed(rows.select(row_id(), "source", F.size("messages").alias("message_count"), *totals))


_IMPORTED = BASE_SQL + f""", k as (select *, {_SELECT} as sel, coalesce('session:' || source_session_id, 'artifact:' || source_artifact_path, 'exact:' || conv_id) as k, row_number % 2 = 1 as new from base),
g as (select source, k, count(*) filter (new) as n, count(*) filter (not new) as old, arg_max(row_number, sel) as best, arg_max(row_number, sel) filter (not new) as before from k group by 1, 2)
"""


@query(
    _IMPORTED + """, c as (select source, count(*) filter (old = 0 and n > 0) as imported, count(*) filter (old > 0 and n > 0 and best <> before) as upgraded, cast(sum(n) as bigint) as n, count(*) as after_conversation_count from g group by 1)
select source, imported, n - imported - upgraded as skipped, upgraded, after_conversation_count from c"""
)
def bundle_import_changes(spark, sf_dir):
    """A bundle of conversations of odd number comes into an archive of those of even number: the changes, and the rows of the archive after."""
    rows = numbered(A.active(views.archive(spark, sf_dir)))
    with scratch(spark) as root, scratch(spark) as other, scratch(spark) as bundle:
        files.write_archive(rows.where("row_number % 2 = 0"), root)
        files.write_archive(rows.where("row_number % 2 = 1"), other)
        B.export_bundle(spark, other, bundle, execute=True)
        _, changes = B.import_bundle(spark, root, bundle, execute=True)
        after = files.read_archive(spark, root).groupBy("source").agg(F.count("*").alias("after_conversation_count"))
        return checkpointed(changes.join(after, "source"))


@query(_IMPORTED + "select source, best as row_id from g")
def bundle_imported(spark, sf_dir):
    """The rows of an archive after the import of a bundle: the richest of each group of both."""
    rows = numbered(A.active(views.archive(spark, sf_dir)))
    with scratch(spark) as root, scratch(spark) as other, scratch(spark) as bundle:
        files.write_archive(rows.where("row_number % 2 = 0"), root)
        files.write_archive(rows.where("row_number % 2 = 1"), other)
        B.export_bundle(spark, other, bundle, execute=True)
        B.import_bundle(spark, root, bundle, execute=True)
        return checkpointed(files.read_archive(spark, root).select("source", row_id()))


@query(BASE_SQL + "select source, row_number as row_id from base where source <> 'src2'")
def run_rows(spark, sf_dir):
    """Rows of a run that names the folders of two of three sources."""
    with scratch(spark) as root:
        files.write_archive(numbered(views.archive(spark, sf_dir)), root)
        Store(spark, root).write(f"{root}/runs/r1/manifest.json", {"sources": [{"source": s, "output_path": f"{C.plain_root(root)}/{s}"} for s in ("src0", "src1")]})
        return checkpointed(B.rows_of_run(spark, root, "r1").select("source", row_id()))
