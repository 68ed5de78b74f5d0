"""Scalar functions over conversations, messages and run records, as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of secret fields, and the patterns of secrets in texts.
SECRET_FIELDS = (
    "accesstoken", "refreshtoken", "idtoken", "clientsecret", "apikey", "authorization", "authtoken", "oauthtoken", "token", "bearertoken", "sessiontoken",
)
_SECRET_WORDS = "access[_-]?token|refresh[_-]?token|id[_-]?token|client[_-]?secret|api[_-]?key|auth[_-]?token|oauth[_-]?token|token"
REDACTIONS = (
    (r"(?iU)\b(Authorization\s*:\s*Bearer\s+)([A-Za-z0-9._~+/=-]+)", "$1[REDACTED]"),
    (rf'(?iU)("(?:authorization|{_SECRET_WORDS})"\s*:\s*")[^"]*(")', "$1[REDACTED]$2"),
    (rf"(?iU)('(?:authorization|{_SECRET_WORDS})'\s*:\s*')[^']*(')", "$1[REDACTED]$2"),
    (rf"(?iU)\b((?:{_SECRET_WORDS})\s*[=:]\s*)([^\s,;]+)", "$1[REDACTED]"),
    (r"(?U)\bsk-(?:proj-|live-|test-)?[A-Za-z0-9_-]{16,}\b", "[REDACTED_API_KEY]"),
    (r"(?U)\bsk-ant-[A-Za-z0-9_-]{16,}\b", "[REDACTED_API_KEY]"),
    (r"(?U)\bAIza[0-9A-Za-z\-_]{20,}\b", "[REDACTED_API_KEY]"),
)
#: The end of an ISO time that names its zone.
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
STATUS_ORDER = {"failed": 0, "unsupported": 1, "partial": 2, "complete": 3}
PREVIEW = 120


@F.pandas_udf(T.ArrayType(T.StringType()))
def casefold_all(texts: pd.Series) -> pd.Series:
    """Full Unicode case folding, which `lower` is not (for instance of the sharp s), of each text of a list; null stays null."""
    return texts.map(lambda own: [t.casefold() for t in own], na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON text with sorted keys and without blanks; text that is no JSON stays as it is."""

    def canonical(text: str) -> str:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return text

    return value.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_row(line: pd.Series) -> pd.Series:
    """Canonical JSON of a row: what is absent, empty or the default of an optional field is left out, all other fields are kept."""

    def canonical(text: str) -> str:
        row = json.loads(text)
        if row.get("transcript_completeness") == "complete":
            del row["transcript_completeness"]
        for name in ("limitations", "provenance"):
            if not row.get(name):
                row.pop(name, None)
        for name in ("session_metadata", "source_artifact_path", "source_session_id", "superseded_at"):
            if row.get(name) is None:
                row.pop(name, None)
        return json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return line.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def with_version(line: pd.Series, version: pd.Series) -> pd.Series:
    """A row's JSON with another version in its contract; all else, its order too, stays."""

    def changed(text: str, to: str) -> str:
        row = json.loads(text)
        row["contract"]["schema_version"] = to
        return json.dumps(row, ensure_ascii=False)

    return pd.Series([None if pd.isna(t) else changed(t, v) for t, v in zip(line, version, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("events", T.LongType())]))
def redact_json(value: pd.Series) -> pd.DataFrame:
    """Redact a JSON object by the names of its fields and the texts of its values, at any depth."""
    import re

    patterns = [(re.compile(p.replace("(?iU)", "(?i)").replace("(?U)", "")), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in REDACTIONS]

    def clean(item: object, field: str | None) -> tuple[object, int]:
        if isinstance(item, dict):
            parts = {k: clean(v, k) for k, v in item.items()}
            return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
        if isinstance(item, list):
            parts = [clean(v, field) for v in item]
            return [v for v, _ in parts], sum(n for _, n in parts)
        if not isinstance(item, str):
            return item, 0
        if field is not None and re.sub(r"[^a-z0-9]+", "", field.lower()) in SECRET_FIELDS:
            return (item, 0) if item.startswith("[REDACTED") else ("[REDACTED]", 1)
        events = 0
        for pattern, by in patterns:
            item, n = pattern.subn(by, item)
            events += n
        return item, events

    def one(text: str | None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        try:
            found, events = clean(json.loads(text), None)
        except ValueError:
            return text, 0
        return json.dumps(found, ensure_ascii=False, separators=(",", ":")), events

    return pd.DataFrame([one(None if pd.isna(x) else x) for x in value], columns=["value", "events"])


def redacted(text: Column) -> Column:
    """The text without secrets: all patterns in order."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def redaction_events(text: Column) -> Column:
    """How many secrets `redacted` replaces; each pattern counts on what those before it have left."""
    total = F.lit(0)
    for pattern, by in REDACTIONS:
        total = total + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, by)
    return total


def preview(text: Column, size: int = PREVIEW) -> Column:
    """White space collapsed; at most `size` characters, longer texts end in three dots."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size - 3), F.lit("...")))


def identity(value: Column) -> Column:
    """Trimmed, null if empty."""
    return F.nullif(F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def identity_shape(session: Column, artifact: Column) -> Column:
    s, a = identity(session).isNotNull(), identity(artifact).isNotNull()
    return F.when(s & a, "session_and_artifact").when(s, "session_only").when(a, "artifact_only").otherwise("unidentified")


def completeness(value: Column) -> Column:
    """An absent completeness means complete."""
    return F.coalesce(value, F.lit("complete"))


def completeness_rank(value: Column) -> Column:
    return F.when(completeness(value) == "complete", 2).when(value == "partial", 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def is_active(superseded_at: Column) -> Column:
    return F.coalesce(F.trim(superseded_at), F.lit("")) == ""


def instant(text: Column) -> Column:
    """Timestamp of an ISO text with a time zone; null for any other."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def lenient_instant(text: Column) -> Column:
    """ISO, or the compact form of run ids and log folders; without a zone it counts as UTC, whatever the session's zone."""
    iso = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6Z")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit("T00:00:00Z"))).when(iso.rlike(ZONED), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.try_to_timestamp(iso)


def utc_text(moment: Column) -> Column:
    """ISO text of a timestamp in UTC to the second.

    The text is made from the seconds since 1970 and not from the time of day in the session's zone, which skips and repeats hours.
    """
    plain = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(moment))
    return F.concat(F.replace(plain.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def epoch_text(value: Column) -> Column:
    """Milliseconds since 1970, as digits, or an ISO text, in UTC to the second; anything else stays."""
    digits = F.when(value.rlike(r"^\d+$"), F.timestamp_millis(value.cast("bigint")))
    return F.coalesce(utc_text(F.coalesce(digits, lenient_instant(value))), value)


def message_text(message: Column) -> Column:
    """Text with a mark of the number of images, `[empty]` if there is neither."""
    images = F.coalesce(F.size(message["images"]), F.lit(0))
    images = F.when(images < 0, 0).otherwise(images)
    mark = F.when(images == 1, "[image]").when(images > 1, F.concat(F.lit("[images:"), images.cast("string"), F.lit("]")))
    return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(message["text"], F.lit("")), mark), F.lit("")), F.lit("[empty]"))


def transcript(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), message_text(m))), "\n\n")


def messages_json(messages: Column) -> Column:
    """Canonical JSON of the messages, without absent fields."""
    return canonical_json(F.to_json(messages))


def message_fingerprint(messages: Column) -> Column:
    return F.sha2(messages_json(messages), 256)


def conversation_json(*names: str) -> Column:
    """Canonical JSON of the row: absent, empty and default fields are left out, JSON texts are nested."""
    shaped = []
    for name in names:
        column = F.col(name)
        if name == "transcript_completeness":
            column = F.nullif(column, F.lit("complete"))
        elif name == "limitations":
            column = F.when(F.size(column) > 0, column)
        elif name in ("session_metadata", "provenance"):
            column = F.try_parse_json(column)
        shaped.append(column.alias(name))
    return canonical_json(F.to_json(F.struct(*shaped)))


def conversation_id(source: Column, session: Column, artifact: Column, collected_at: Column, fingerprint: Column) -> Column:
    """Stable id: of the session, else of the artifact, else of the content."""
    by_session = F.to_json(F.struct(F.lit("source_session_id").alias("identity_basis"), source.alias("source"), session.alias("source_session_id")))
    by_artifact = F.to_json(F.struct(F.lit("source_artifact_path").alias("identity_basis"), source.alias("source"), artifact.alias("source_artifact_path")))
    by_content = F.to_json(F.struct(collected_at.alias("collected_at"), F.lit("content_fingerprint").alias("identity_basis"), fingerprint.alias("message_fingerprint"), source.alias("source")))
    return F.concat(F.lit("sha256:"), F.sha2(F.when(session.isNotNull(), by_session).when(artifact.isNotNull(), by_artifact).otherwise(by_content), 256))


def dedupe_key(source: Column, session: Column, artifact: Column, fingerprint: Column) -> Column:
    parts = F.struct(fingerprint.alias("message_fingerprint"), source.alias("source"), artifact.alias("source_artifact_path"), session.alias("source_session_id"))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def status_order(status: Column) -> Column:
    return F.coalesce(*[F.when(status == name, F.lit(place)) for name, place in STATUS_ORDER.items()])


def transition(before: Column, after: Column) -> Column:
    change = status_order(after) - status_order(before)
    return F.when(before.isNull() | (before == after), None).when(change > 0, "improved").when(change < 0, "regressed").otherwise("changed")


def expected_status(failed: Column, unsupported: Column, partial: Column) -> Column:
    return F.when(failed, "failed").when(unsupported, "unsupported").when(partial, "partial").otherwise("complete")


def uri_path(uri: Column) -> Column:
    """Path of a file: URI, percent-decoded; a plus sign is kept."""
    return F.url_decode(F.replace(F.parse_url(uri, F.lit("PATH")), F.lit("+"), F.lit("%2B")))
