"""Queries over the archive: list, show, find, sample, statistics, profile, anomalies, limitations.

Input is a conversations DataFrame (see colloquy.model); superseded rows are left
out by `active` before, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import COMPLETENESS, ROLES
from .policy import NEVER, degraded_rules, with_place

SUMMARY = ("source", "source_session_id", "transcript_completeness", "collected_at", "message_count", "limitation_count", "limitations", "has_provenance", "source_artifact_path", "execution_context", "output_path", "row_number")


def active(conversations: DataFrame) -> DataFrame:
    return conversations.where(S.is_active(F.col("superseded_at")))


def newest_first() -> list[Column]:
    return [F.desc("collected_at"), F.desc("source"), F.desc(F.coalesce("source_session_id", F.lit(""))), F.desc("output_path"), F.desc("row_number")]


def matching(conversations: DataFrame, source: str | None = None, session: str | None = None, completeness: str | None = None, text: str | None = None) -> DataFrame:
    """Rows that fulfil every filter that is given; text is searched without regard to case in all messages."""
    if source is not None:
        conversations = conversations.where(F.col("source") == source)
    if session is not None:
        conversations = conversations.where(F.col("source_session_id") == session)
    if completeness is not None:
        conversations = conversations.where(S.completeness(F.col("transcript_completeness")) == completeness)
    if text is not None:
        if not text.strip():
            raise ValueError("the text to search for must not be empty")
        conversations = conversations.where(F.exists(folded_texts(), holds(text)))
    return conversations


def folded_texts() -> Column:
    """The case-folded texts of a conversation's messages, in order; ASCII texts, and rows of them, never leave the JVM."""
    texts = F.transform("messages", lambda m: F.coalesce(m["text"], F.lit("")))
    plain = F.forall(texts, lambda t: F.octet_length(t) == F.length(t))
    return F.when(plain, F.transform(texts, lambda t: F.lower(t))).otherwise(S.casefold_all(F.when(~plain, texts)))


def holds(text: str) -> Callable[[Column], Column]:
    """A case-folded text holds the query, case-folded too."""
    return lambda folded: F.contains(folded, F.lit(text.strip().casefold()))


def summaries(conversations: DataFrame, *more: Column) -> DataFrame:
    """The summary columns of each conversation, its limitations sorted, and more columns of it."""
    return conversations.select(
        "source", "source_session_id", S.completeness(F.col("transcript_completeness")).alias("transcript_completeness"), "collected_at",
        F.size("messages").alias("message_count"), F.size(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitation_count"),
        F.array_sort(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitations"), F.col("provenance").isNotNull().alias("has_provenance"),
        "source_artifact_path", "execution_context", "output_path", "row_number", *more,
    )


def list_conversations(conversations: DataFrame, **filters: str | None) -> DataFrame:
    return summaries(matching(conversations, **filters)).orderBy(*newest_first())


def show(conversations: DataFrame, source: str, session: str) -> DataFrame:
    """The one conversation of a session; none or several are errors."""
    found = matching(conversations, source=source, session=session)
    several = found.limit(2).count()
    if several != 1:
        raise LookupError("no such conversation" if not several else "the session is ambiguous")
    return found


def messages(conversations: DataFrame) -> DataFrame:
    """One row for each message, numbered from 1; an unknown role is `__invalid__`."""
    exploded = conversations.select("source", "source_session_id", "collected_at", "output_path", "row_number", F.posexplode("messages").alias("place", "message"))
    role = F.when(F.col("message.role").isin(*ROLES), F.col("message.role")).otherwise("__invalid__")
    return exploded.select("source", "source_session_id", "collected_at", "output_path", "row_number", (F.col("place") + 1).alias("message_index"), role.alias("role"), F.col("message.text").alias("text"))


def find(conversations: DataFrame, text: str, **filters: str | None) -> DataFrame:
    """Conversations with the number of messages that hold the text, and a preview of the first of these."""
    if not text.strip():
        raise ValueError("the text to search for must not be empty")
    hits = F.filter(F.transform(folded_texts(), lambda t, i: F.when(holds(text)(t), i)), lambda i: i.isNotNull())
    found = matching(conversations, **filters).withColumn("_hits", hits).where(F.size("_hits") > 0)
    first = S.preview(F.get("messages", F.get("_hits", F.lit(0)))["text"])
    return summaries(found, F.size("_hits").alias("matched_message_count"), first.alias("preview")).orderBy(*newest_first())


def sample(conversations: DataFrame, count: int, seed: str, payload: Column, **filters: str | None) -> DataFrame:
    """The `count` conversations of least sha256(seed, 0, payload); the same for a seed in any order of rows."""
    if count < 1 or not seed.strip():
        raise ValueError("a sample needs a positive count and a seed")
    rank = F.sha2(F.concat(F.lit(seed.strip()), F.lit("\0"), payload), 256)
    spoken = F.filter("messages", lambda m: F.coalesce(F.trim(m["text"]), F.lit("")) != "")
    chosen = matching(conversations, **filters).withColumns({"rank": rank, "preview": S.preview(F.try_element_at(spoken, F.lit(1))["text"])})
    return chosen.orderBy("rank", *newest_first()).limit(count)


def _measured(conversations: DataFrame) -> DataFrame:
    """What statistics count of each row, so that no text or list is copied for the grouping sets."""
    of_role = lambda r: F.size(F.filter("messages", lambda m: m["role"] == r))
    return conversations.select(
        "source", "output_path", "collected_at", S.completeness(F.col("transcript_completeness")).alias("known"), F.size("messages").alias("n"),
        (F.size(F.coalesce("limitations", F.array().cast("array<string>"))) > 0).alias("limited"), *[of_role(r).alias(r) for r in ROLES],
    )


def _summed(conversations: DataFrame, more: list[Column]) -> DataFrame:
    counts = [
        F.count_distinct("output_path").alias("file_count"), F.count("*").alias("conversation_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("message_count"),
        *[F.count_if(F.col("known") == c).alias(f"{c}_count") for c in COMPLETENESS],
        F.min("collected_at").alias("earliest_collected_at"), F.max("collected_at").alias("latest_collected_at"), F.count_if("limited").alias("conversation_with_limitations_count"), *more,
    ]
    found = _measured(conversations).rollup("source").agg(F.grouping("source").alias("_all"), *counts)
    return found.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("source")).alias("source"), *[c for c in found.columns if c not in ("source", "_all")])


def stats(conversations: DataFrame) -> DataFrame:
    """Counts of each source, and of all (source `*`), in one grouping-sets aggregation."""
    return _summed(conversations, [])


def first_invalid_role(conversations: DataFrame) -> DataFrame:
    """The first message, in order of rows, whose role is unknown; no row if there is none."""
    return messages(conversations).where("role = '__invalid__'").orderBy("output_path", "row_number", "message_index").limit(1)


def check_roles(conversations: DataFrame) -> None:
    """Raise on the first message, in order of rows, whose role is unknown."""
    bad = first_invalid_role(conversations).first()
    if bad is not None:
        raise ValueError(f"{bad.output_path}, row {bad.row_number}: message {bad.message_index} has an unknown role")


def profile(conversations: DataFrame) -> DataFrame:
    """Statistics with message counts by role and the ratios of all counts, by source and for all."""
    both = _summed(conversations, [F.coalesce(F.sum(r), F.lit(0)).cast("bigint").alias(f"{r}_messages") for r in ROLES])
    n, m = F.col("conversation_count"), F.col("message_count")
    return both.withColumns(
        {f"{c}_ratio": S.ratio(F.col(f"{c}_count"), n) for c in COMPLETENESS}
        | {f"{r}_ratio": S.ratio(F.col(f"{r}_messages"), m) for r in ROLES}
        | {"with_limitations_ratio": S.ratio(F.col("conversation_with_limitations_count"), n)}
    )


def limitation_counts(conversations: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """How often each source has each limitation; with a baseline policy, how many of these it suppresses."""
    found = conversations.select("source", F.explode("limitations").alias("limitation")).groupBy("source", "limitation").agg(F.count("*").alias("raw_count"))
    if policy is not None:
        known = policy.where("kind = 'limitation'").select("source", "limitation", F.lit(True).alias("_known")).distinct()
        found = found.join(known, ["source", "limitation"], "left").withColumn("suppressed_count", F.when(F.col("_known"), F.col("raw_count")).otherwise(0)).drop("_known")
    return found


def top_limitations(conversations: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent limitations of all sources, by count and name."""
    total = conversations.select(F.explode("limitations").alias("limitation")).groupBy("limitation").agg(F.count("*").alias("raw_count"))
    return total.orderBy(F.desc("raw_count"), "limitation").limit(k)


def anomalies(conversations: DataFrame, low_messages: int = 1, many_limitations: int = 2) -> DataFrame:
    """Conversations with at least one suspicious trait, and the codes of their traits."""
    s = summaries(conversations)
    codes = F.array_compact(
        F.array(
            F.when(F.col("message_count") <= low_messages, F.lit("low_message_count")),
            F.when((F.col("limitation_count") > 0) & (F.col("limitation_count") >= many_limitations), F.lit("excessive_limitations")),
            F.when(F.col("transcript_completeness") == "unsupported", F.lit("unsupported_transcript")),
        )
    )
    return s.withColumn("reasons", codes).where(F.size("reasons") > 0)


def anomalies_first() -> list[Column]:
    """The order of suspicious conversations: the newest first, then by session, file and row, descending."""
    return [F.desc("collected_at"), F.desc(F.coalesce("source_session_id", F.lit(""))), F.desc("output_path"), F.desc("row_number")]


def source_anomalies(conversations: DataFrame, low_messages: int = 1, many_limitations: int = 2, unsupported_count: int = 2, unsupported_ratio: float = 0.5) -> DataFrame:
    """Counts of each trait by source, and whether unsupported transcripts are too frequent."""
    s = summaries(conversations)
    limited = (F.col("limitation_count") > 0) & (F.col("limitation_count") >= many_limitations)
    unsupported = F.col("transcript_completeness") == "unsupported"
    low = F.col("message_count") <= low_messages
    found = s.groupBy("source").agg(
        F.count_distinct("output_path").alias("file_count"), F.count("*").alias("conversation_count"), F.sum("message_count").cast("bigint").alias("message_count"),
        F.count_if(low).alias("low_message_count"), F.count_if(limited).alias("excessive_limitations"), F.count_if(unsupported).alias("unsupported_transcript"),
        F.count_if(low | limited | unsupported).alias("suspicious_conversation_count"),
    )
    share = S.ratio(F.col("unsupported_transcript"), F.col("conversation_count"))
    return found.withColumn("unsupported_ratio", share).withColumn("high_unsupported_ratio", (F.col("unsupported_transcript") >= unsupported_count) & (share >= unsupported_ratio))


def with_suppression(found: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds the policy entry that suppresses each finding (source, report, code, level): a warning whose source, report and code an entry names, of several the first.

    `drift_suspected` is never suppressed, nor is a finding without source.
    """
    rules = with_place(policy).where("kind = 'finding'").groupBy("source", "report", "code").agg(F.min_by("id", "place").alias("_entry"))
    open_ = (F.col("level") == "warning") & ~F.col("code").isin(*NEVER)
    return found.join(rules, ["source", "report", "code"], "left").withColumn("suppressed_by", F.when(open_, F.col("_entry"))).drop("_entry")


def _degraded(policy: DataFrame) -> DataFrame:
    """(source, _degraded): the entry for each degraded source, whatever its state; the most specific one, of several the first."""
    sources = policy.where("kind = 'degraded_source'").select("source").distinct().select("source", F.lit(None).cast("string").alias("support_level"), F.lit(None).cast("string").alias("status"))
    return degraded_rules(policy, sources, ["source"], ignore_state=True).select("source", F.col("_of_state.id").alias("_degraded"))


def suppressed_reasons(found: DataFrame, policy: DataFrame) -> DataFrame:
    """One row for each reason of each suspicious conversation (as of `anomalies`), with the policy entry that suppresses it.

    Unsupported transcripts are suppressed by an entry for the degraded source,
    many limitations only if there is an entry for each of them (the first
    limitation's is named), and few messages never.
    """
    known = with_place(policy).where("kind = 'limitation'").groupBy("source", "limitation").agg(F.min_by("id", "place").alias("id"))
    known = known.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("limitation", "id"))).alias("_known"))
    entries = F.transform("limitations", lambda x: F.try_element_at("_known", x))
    every = F.when((F.size("limitations") > 0) & F.forall(entries, lambda x: x.isNotNull()), F.try_element_at(entries, F.lit(1)))
    rows = found.join(_degraded(policy), "source", "left").join(known, "source", "left").withColumn("_every", every)
    by = F.when(F.col("code") == "unsupported_transcript", F.col("_degraded")).when(F.col("code") == "excessive_limitations", F.col("_every"))
    return rows.withColumn("code", F.explode("reasons")).withColumn("suppressed_by", by).drop("_degraded", "_known", "_every", "reasons")


def active_anomalies(sources: DataFrame, reasons: DataFrame, policy: DataFrame) -> DataFrame:
    """Sources (as of `source_anomalies`) with what a policy leaves: suspicious conversations that have an active reason, and the source's own reason.

    `reasons` are those of `suppressed_reasons`.  A frequent lack of support is the one reason of a source; an entry for the degraded source accepts it.
    """
    by_row = reasons.groupBy("source", "output_path", "row_number").agg(F.count_if(F.col("suppressed_by").isNull()).alias("_open"))
    counts = by_row.groupBy("source").agg(F.count_if(F.col("_open") > 0).alias("active_suspicious_conversation_count"), F.count_if(F.col("_open") == 0).alias("suppressed_suspicious_conversation_count"))
    rows = sources.join(counts, "source", "left").join(_degraded(policy), "source", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("active_suspicious_conversation_count", "suppressed_suspicious_conversation_count")}
    named = F.when(F.col("high_unsupported_ratio"), F.col("_degraded"))
    return rows.withColumns(filled | {"suppressed_by": named, "active_high_unsupported_ratio": F.col("high_unsupported_ratio") & named.isNull()}).drop("_degraded")
