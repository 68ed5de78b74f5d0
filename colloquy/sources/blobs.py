"""Conversation blobs in protobuf wire format, and the files that lie beside them.

The layout of a blob is known from its content only: field 1 names the session, field 2
holds messages (id, role, text, time).  A blob that is something else is a conversation
without messages that says why; what a known one holds beside messages is counted.
Spark does not list empty files, so an empty blob is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import artifacts as A
from ..operators.checks import file_path
from .collectors import conversations, existing, matching, message

#: Fields of a blob and of a message, roles by number, limitations, wire types that no known layout begins with, and endings of images.
SESSION, MESSAGES = 1, 2
ID, ROLE, TEXT, TIME = 1, 2, 3, 4
ROLES = {1: "user", 2: "assistant"}
UNKNOWN, FAILED, METADATA_ONLY = "variant_unknown", "decode_failed", "metadata_only_session_family"
MISMATCH, NO_USER, NO_ASSISTANT = "conversation_protobuf_session_id_mismatch", "user_message_missing_from_conversation_protobuf", "assistant_message_missing_from_conversation_protobuf"
STRANGE = (3, 4, 6, 7)
IMAGES = r"(?i)\.(png|jpe?g|webp|gif)$"


class WireError(ValueError):
    """Bytes that are no message: where, while reading what, and of which field."""

    def __init__(self, what: str, offset: int, stage: str, number: int | None = None, kind: int | None = None) -> None:
        super().__init__(f"{what} at {offset}")
        self.offset, self.stage, self.number, self.kind = offset, stage, number, kind


def wire_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message, in order."""

    def varint(at: int) -> tuple[int, int]:
        value = 0
        for n in range(10):
            if at + n >= len(data):
                raise WireError("cut number", at, "varint")
            value |= (data[at + n] & 127) << 7 * n
            if data[at + n] < 128:
                return value, at + n + 1
        raise WireError("long number", at, "varint")

    fields, at = [], 0
    while at < len(data):
        begin = at
        tag, at = varint(at)
        number, kind = tag >> 3, tag & 7
        if not tag:
            raise WireError("empty tag", begin, "tag")
        if kind not in (0, 1, 2, 5):
            raise WireError(f"wire type {kind}", begin, "field", number, kind)
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            if at + size > len(data):
                raise WireError("cut field", at, "field", number, kind)
            value, at = data[at : at + size], at + size
        fields.append((number, value))
    return fields


def _text(fields: list[tuple[int, int | bytes]], number: int, strip: bool = False) -> str | None:
    """The first text of a field that is UTF-8 and not empty."""
    for n, value in fields:
        if n == number and isinstance(value, bytes):
            try:
                found = value.decode()
            except UnicodeDecodeError:
                continue
            found = found.strip() if strip else found
            if found:
                return found
    return None


def _role(fields: list[tuple[int, int | bytes]]) -> str | None:
    for n, value in fields:
        if n == ROLE and isinstance(value, int):
            return ROLES.get(value)
        if n == ROLE and (said := value.decode(errors="replace").strip().lower()) in ROLES.values():
            return said
    return None


def decoded(data: bytes) -> dict:
    """Session, messages, number of messages that were skipped, and the failure, if it is one."""
    try:
        fields = wire_fields(data)
    except WireError as e:
        return {"session": None, "said": [], "skipped": 0, "failure": {"error": str(e), "offset": e.offset, "stage": e.stage, "number": e.number, "kind": e.kind}}
    said, skipped = [], 0
    for number, value in fields:
        if number != MESSAGES or not isinstance(value, bytes):
            continue
        try:
            own = wire_fields(value)
        except WireError:
            own = []
        role, text = _role(own), _text(own, TEXT, strip=True)
        if role is None or text is None:
            skipped += 1
        else:
            said.append({"role": role, "text": text, "at": _text(own, TIME), "id": _text(own, ID)})
    return {"session": _text(fields, SESSION), "said": said, "skipped": skipped, "failure": None}


_DECODED = "path string, session string, said array<struct<role:string,text:string,at:string,id:string>>, skipped int, failure struct<error:string,offset:bigint,stage:string,number:int,kind:int>"


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size) of the files of a pattern, without reading them."""
    found = matching(spark, [f"{root}/{pattern}"])
    if not found:
        return spark.createDataFrame([], "path string, size bigint")
    return spark.read.format("binaryFile").load(found).select(file_path(F.col("_metadata.file_path")).alias("path"), F.col("length").alias("size"))


def beside(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, brain, annotation, browser_recording) of the sessions that files name: facts of their folder, record and recordings, null where there is none."""
    folder = A.uuid(F.element_at(F.split("path", "/"), -2)).alias("session_id")
    name = F.element_at(F.split("path", "/"), -1)
    above = F.regexp_replace("path", "/[^/]*$", "")
    image, marked = name.rlike(IMAGES), name.endswith(".metadata.json")
    brain = _listed(spark, root, "brain/*/*").select(folder, "size", name.alias("name"), above.alias("folder"), image.alias("image"), marked.alias("marked")).where("session_id is not null").groupBy("session_id").agg(
        F.min("folder").alias("path"), F.array_sort(F.collect_set(F.when(F.col("name").endswith(".md"), F.col("name")))).alias("artifact_names"), F.count_if("marked").alias("artifact_summary_count"),
        F.count_if(F.col("name").endswith(".resolved")).alias("resolved_artifact_count"), F.count_if("image").alias("image_artifact_count"), F.sum("size").alias("byte_count"),
    )
    recorded = _listed(spark, root, "browser_recordings/*/*").select(folder, above.alias("folder"), image.alias("image")).where("session_id is not null").groupBy("session_id").agg(F.min("folder").alias("path"), F.count_if("image").alias("frame_count"))
    noted = matching(spark, [f"{root}/annotations/*.pbtxt"])
    if noted:
        own = file_path(F.col("_metadata.file_path"))
        records = spark.read.text(noted, wholetext=True).select(own.alias("path"), "value").withColumn("session_id", A.uuid_of_path(F.col("path"))).where("session_id is not null")
        first = records.groupBy("session_id").agg(F.min_by(F.struct("path", "value"), "path").alias("r")).select("session_id", F.struct(F.col("r.path").alias("path"), A.text_record(F.col("r.value")).alias("fields")).alias("annotation"))
    else:
        first = spark.createDataFrame([], "session_id string, annotation struct<path:string,fields:string>")
    whole = lambda rows, as_: rows.select("session_id", F.struct(*[c for c in rows.columns if c != "session_id"]).alias(as_))
    return whole(brain, "brain").join(first, "session_id", "full_outer").join(whole(recorded, "browser_recording"), "session_id", "full_outer")


def antigravity(spark: SparkSession, root: str) -> DataFrame:
    """Conversations of blobs, named by the UUID of their file, with what could not be decoded and what lies beside them."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame({k: [v] for k, v in ({"path": path} | decoded(bytes(content))).items()})

    files = spark.read.format("binaryFile").load(existing(spark, [f"{root}/conversations/*.pb"])).select(file_path(F.col("_metadata.file_path")).alias("path"), "content")
    rows = files.mapInPandas(read, _DECODED).withColumn("messages", F.transform("said", lambda m: message(m["role"], m["text"], None, m["at"], m["id"])))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    by_file, inside = A.uuid(name), A.uuid(F.col("session"))
    rows = rows.withColumn("session_id", F.coalesce(by_file, inside, S.identity(F.col("session")), name))
    failed, none = F.col("failure").isNotNull(), F.size("messages") == 0
    has = lambda role: F.exists("messages", lambda m: m["role"] == role)
    strange = failed & (F.col("failure.offset") == 0) & F.coalesce(F.col("failure.kind").isin(*STRANGE), F.lit(False))
    of_known: list[Column] = [
        F.when(none | (F.col("skipped") > 0), UNKNOWN), F.when(none, METADATA_ONLY), F.when(by_file.isNotNull() & (inside != by_file), MISMATCH), F.when(~none & ~has("user"), NO_USER), F.when(~none & ~has("assistant"), NO_ASSISTANT),
    ]
    told = F.when(failed, F.array_compact(F.array(F.when(strange, UNKNOWN), F.lit(FAILED), F.lit(METADATA_ONLY)))).otherwise(F.array_compact(F.array(*of_known)))
    status = F.when(strange | failed, FAILED).when(none, UNKNOWN).when(F.size(told) > 0, "partially_decoded").otherwise("decoded")
    rows = rows.withColumns({"limitations": F.when(F.size(told) > 0, told), "status": status, "completeness": F.when(none, "unsupported").when(F.size(told) > 0, "partial")})
    joined = rows.join(beside(spark, root), "session_id", "left")
    blob = F.struct(F.col("status").alias("decode_status"), inside.alias("protobuf_session_id"), F.nullif(F.size("messages"), F.lit(0)).alias("recovered_message_count"), F.nullif("skipped", F.lit(0)).alias("skipped_message_count"), F.col("failure"))
    metadata = F.to_json(F.struct(blob.alias("conversation_blob"), "brain", "annotation", "browser_recording"))
    first = F.try_element_at(F.filter(F.transform("messages", lambda m: m["timestamp"]), lambda t: t.isNotNull()), F.lit(1))
    provenance = F.to_json(F.struct(first.alias("session_started_at"), F.lit("antigravity").alias("source"), F.lit("antigravity_editor_view").alias("originator")))
    return conversations(joined, "antigravity_editor_view", "ide", F.col("session_id"), provenance, F.col("completeness"), F.col("limitations"), metadata)
