"""Identity: candidates and their richness, merge groups, compaction, incremental merge, identity audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpointed
from .graph import components


def candidates(conversations: DataFrame) -> DataFrame:
    """Adds the measures by which the richest of several rows is chosen.

    `richness` compares what a row holds; `selection` breaks ties by time and place.
    """
    texts = F.filter("messages", lambda m: F.coalesce(S.identity(m["text"]), F.lit("")) != "")
    limitations = F.size(F.coalesce("limitations", F.array().cast("array<string>")))
    metadata = (F.coalesce("session_metadata", F.lit("{}")) != "{}").cast("int") + (F.coalesce("provenance", F.lit("{}")) != "{}").cast("int")
    images = F.aggregate("messages", F.lit(0), lambda n, m: n + F.greatest(F.coalesce(F.size(m["images"]), F.lit(0)), F.lit(0)))
    richness = F.struct(
        S.completeness_rank(F.col("transcript_completeness")).alias("completeness"), F.size(texts).alias("text_messages"), F.size("messages").alias("messages"), images.alias("images"),
        F.aggregate(texts, F.lit(0), lambda n, m: n + F.length(m["text"])).alias("text_size"), metadata.alias("metadata"), (-limitations).alias("fewer_limitations"),
    )
    return conversations.withColumn("richness", richness).withColumn("selection", F.struct("richness", "collected_at", "output_path", "row_number"))


def group_key(exact: Column) -> Column:
    """Session, else artifact, else the exact content; not trimmed."""
    session, artifact = F.col("source_session_id"), F.col("source_artifact_path")
    return F.when(session.isNotNull(), F.concat(F.lit("session:"), session)).when(artifact.isNotNull(), F.concat(F.lit("artifact:"), artifact)).otherwise(F.concat(F.lit("exact:"), exact))


def compacted(conversations: DataFrame, exact: Column) -> DataFrame:
    """The richest row of each group of a source, with the number of rows that it stands for."""
    found = candidates(conversations).withColumn("_key", group_key(exact))
    columns = conversations.columns
    best = found.groupBy("source", "_key").agg(F.max_by(F.struct(*columns), "selection").alias("row"), F.count("*").alias("group_size"))
    return best.select(*[F.col(f"row.{c}").alias(c) for c in columns], "group_size")


def linked(conversations: DataFrame) -> DataFrame:
    """Adds component: rows of one source that share a trimmed session id or artifact path, also by way of other rows.

    Rows are nodes by a number of their place; a star of edges joins the rows of each shared value.
    """
    node = F.xxhash64("output_path", "row_number")
    rows = conversations.withColumn("node", node)
    values = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(mark), v)) for mark, v in (("s:", S.identity(F.col("source_session_id"))), ("a:", S.identity(F.col("source_artifact_path"))))]))
    held = rows.select("source", "node", F.explode(values).alias("value"))
    hubs = held.groupBy("source", "value").agg(F.min("node").alias("hub"))
    edges = held.join(hubs, ["source", "value"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = components(edges)
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def identity_audit(conversations: DataFrame, fingerprint: Column) -> DataFrame:
    """Groups of rows that share an identity: their size, ids, shapes, variants, preferred row and reasons."""
    found = linked(candidates(conversations)).withColumns({
        "_session": S.identity(F.col("source_session_id")), "_artifact": S.identity(F.col("source_artifact_path")),
        "_shape": S.identity_shape(F.col("source_session_id"), F.col("source_artifact_path")), "_print": fingerprint,
    })
    groups = found.groupBy("source", "component").agg(
        F.count("*").alias("conversation_count"), F.count("_session").alias("_with_session"), F.count("_artifact").alias("_with_artifact"),
        F.array_sort(F.collect_set("_session")).alias("source_session_ids"), F.array_sort(F.collect_set("_artifact")).alias("source_artifact_paths"),
        F.array_sort(F.collect_set("_shape")).alias("identity_shapes"), F.count_distinct("_print").alias("message_variants"),
        F.min("richness").alias("_poorest"), F.max("selection").alias("_best"),
    ).where("conversation_count > 1")
    sessions, artifacts = F.size("source_session_ids"), F.size("source_artifact_paths")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_with_session") > sessions, F.lit("duplicate_source_session_id")),
            F.when(F.col("_with_artifact") > artifacts, F.lit("duplicate_source_artifact_path")),
            F.when(sessions > 1, F.lit("conflicting_source_session_ids")),
            F.when(artifacts > 1, F.lit("conflicting_source_artifact_paths")),
            F.when(F.size("identity_shapes") > 1, F.lit("mixed_identity_shapes")),
            F.when(F.col("message_variants") > 1, F.lit("message_variants")),
            F.when(F.col("_poorest") < F.col("_best.richness"), F.lit("richer_transcript_available")),
        )
    )
    return groups.select("source", "conversation_count", "source_session_ids", "source_artifact_paths", "identity_shapes", "message_variants", F.col("_best.output_path").alias("preferred_output_path"), F.col("_best.row_number").alias("preferred_row_number"), reasons.alias("reasons"))


def audit_members(conversations: DataFrame) -> DataFrame:
    """Rows of groups that share an identity, with group_place and member_place from 1: the newest groups by their preferred row first, its richest rows first.

    Groups are placed by the order of their preferred rows' times, sources, ids, and places, all descending.
    """
    found = linked(candidates(conversations))
    sizes = found.groupBy("source", "component").agg(F.count("*").alias("_n"), F.max_by(F.struct("collected_at", F.coalesce("source_session_id", F.lit("")).alias("s"), F.coalesce("source_artifact_path", F.lit("")).alias("a"), "output_path", "row_number"), "selection").alias("_best")).where("_n > 1")
    rank = F.struct(F.col("_best.collected_at").alias("at"), F.col("source"), F.col("_best.s"), F.col("_best.a"), F.col("_best.output_path"), F.col("_best.row_number"))
    # Places of groups come from ranges and their counts, so that no task sees them all.
    ordered = checkpointed(sizes.select("source", "component", rank.alias("_rank")).repartitionByRange(F.desc("_rank")).sortWithinPartitions(F.desc("_rank")).withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).drop("_c")  # a row a range
    placed = ordered.withColumn("_nth", F.row_number().over(W.partitionBy("_part").orderBy(F.desc("_rank")))).join(before, "_part")
    placed = placed.select("source", "component", (F.col("_nth") + F.col("_before")).alias("group_place"))
    member = F.row_number().over(W.partitionBy("source", "component").orderBy(F.desc("selection")))
    return found.join(placed, ["source", "component"]).withColumn("member_place", member).select(*conversations.columns, "group_place", "member_place")


def incremental_merge(existing: DataFrame, incoming: DataFrame, exact: Column) -> DataFrame:
    """Decision on each row: incoming rows are `insert`, `upgrade` or `skip`, existing ones `keep` or `supersede`.

    Rows are grouped as by `linked`, and equal rows without identity too.  The
    richest incoming row of a group goes in if it is strictly richer than all
    existing ones, which it then supersedes.

    Rows are read once, for their ids and measures; what follows sees no messages.  `exact` is
    taken of rows without identity only: others hand it null messages.
    """
    both = existing.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    lacking = F.coalesce(S.identity(F.col("source_session_id")), S.identity(F.col("source_artifact_path"))).isNull()
    found = candidates(both).withColumn("_lacking", lacking).withColumn("messages", F.when(F.col("_lacking"), F.col("messages")))
    named = found.withColumn("source_artifact_path", F.when(F.col("_lacking"), F.concat(F.lit("exact:"), exact)).otherwise(F.col("source_artifact_path")))
    rows = linked(checkpointed(named.select("source", "output_path", "row_number", "_new", "source_session_id", "source_artifact_path", "richness", "selection")))
    groups = rows.groupBy("source", "component").agg(
        F.max(F.when(F.col("_new"), F.col("selection"))).alias("_winner"), F.max(F.when(~F.col("_new"), F.col("richness"))).alias("_richest"),
    )
    won = F.col("_winner").isNotNull() & (F.col("_richest").isNull() | (F.col("_winner.richness") > F.col("_richest")))
    joined = rows.join(groups.withColumn("_won", won), ["source", "component"])
    taken = F.col("_won") & (F.col("selection") == F.col("_winner"))
    decision = (
        F.when(F.col("_new") & taken & F.col("_richest").isNull(), "insert").when(F.col("_new") & taken, "upgrade").when(F.col("_new"), "skip")
        .when(F.col("_won"), "supersede").otherwise("keep")
    )
    return joined.select("source", "output_path", "row_number", F.col("_new").alias("is_incoming"), decision.alias("decision"))


def merged(existing: DataFrame, incoming: DataFrame, exact: Column, moment: str) -> DataFrame:
    """The archive after an incremental merge: existing rows, those that are superseded marked with the moment, and the new rows that go in."""
    at = ["source", "output_path", "row_number"]
    decided = incremental_merge(existing, incoming, exact)
    old = existing.join(decided.where("not is_incoming").select(*at, "decision"), at)
    marked = F.when(F.col("decision") == "supersede", F.lit(moment)).otherwise(F.col("superseded_at"))
    new = incoming.join(decided.where("is_incoming and decision in ('insert', 'upgrade')").select(*at), at, "left_semi")
    return old.withColumn("superseded_at", marked).drop("decision").unionByName(new)


def import_changes(existing: DataFrame, bundle: DataFrame, exact: Column) -> DataFrame:
    """(source, imported, skipped, upgraded): what an import of the bundle changes, by groups of `group_key`.

    A group that the archive lacks imports one row; of another, one row upgrades it
    if the best row of both is not the archive's; all other rows are skipped.
    """
    both = candidates(existing.withColumn("_new", F.lit(False)).unionByName(bundle.withColumn("_new", F.lit(True)))).withColumn("_key", group_key(exact))
    best = F.max(F.struct("selection", exact.alias("payload")))
    groups = both.groupBy("source", "_key").agg(F.count_if("_new").alias("n"), F.count_if(~F.col("_new")).alias("old"), best.alias("best"), F.max(F.when(~F.col("_new"), F.struct("selection", exact.alias("payload")))).alias("before")).where("n > 0")
    fresh = F.col("old") == 0
    better = ~fresh & (F.col("best.payload") != F.col("before.payload"))
    counts = groups.groupBy("source").agg(F.count_if(fresh).alias("imported"), F.count_if(better).alias("upgraded"), F.sum("n").alias("_n"))
    return counts.select("source", "imported", (F.col("_n") - F.col("imported") - F.col("upgraded")).alias("skipped"), "upgraded")
