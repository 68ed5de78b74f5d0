"""Streaming forms of the incremental operators: new files of an archive as a stream, exports and merges by batch."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..model import CONVERSATION
from ..operators.memory import memory_records
from ..session import checkpointed
from ..sources.batch import TIME, write_incremental
from ..sources.swap import Store


def archive_stream(spark: SparkSession, root: str, source: str = "*") -> DataFrame:
    """Conversations of new archive files; a file counts once, so rows changed in place are not seen again."""
    lines = spark.readStream.schema("value string").text(f"{root}/{source}/")
    parsed = lines.select(F.from_json("value", T._parse_datatype_string(CONVERSATION)).alias("row"), F.col("_metadata.file_path").alias("output_path"))
    rows = parsed.where("row.source is not null").select("row.*", "output_path", F.lit(None).cast("bigint").alias("row_number"))
    return rows.where(S.is_active(F.col("superseded_at")))


def export_memory_stream(conversations: DataFrame, target: str, checkpoint: str):
    """Export memory records of new rows; the checkpoint is the watermark, so no row is lost to equal times."""
    records = memory_records(conversations)
    return records.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, number: int, root: str, name: str, moment: str | None = None) -> bool:
    """Merge one batch of a stream into an archive, by source; a batch that the ledger has is left alone.  Returns whether it was merged.

    The ledger has a file for each batch, written after its rows.  A break between the two makes the batch come once
    more; its rows then are no richer than those the archive has, so nothing changes.
    """
    spark = batch.sparkSession
    store, entry = Store(spark, root), f"{root}/runs/stream-{name}/batch-{number}.json"
    if store.exists(entry):
        return False
    now = moment or datetime.now(UTC).strftime(TIME)
    rows = checkpointed(batch.select(*[c for c in batch.columns if c not in ("output_path", "row_number", "source_dir")]))
    counts = {r.source: write_incremental(spark, root, r.source, rows.where(F.col("source") == r.source), now) for r in rows.select("source").distinct().orderBy("source").collect()}  # a handful of stores
    store.write(entry, {"batch": number, "merged_at": now, "sources": counts})
    return True


def merge_stream(conversations: DataFrame, root: str, checkpoint: str, name: str = "merge"):
    """Merge a stream of conversations into an archive, once for each batch whatever breaks off; `name` is that of its ledger and must go with the checkpoint."""
    return conversations.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, root, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
