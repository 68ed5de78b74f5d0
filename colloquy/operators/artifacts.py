"""Side artifacts of sessions: files that a UUID in their path joins to a conversation, totals of folders, and simple text records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid(text: Column) -> Column:
    """The text in lower case if it is a UUID, else null."""
    return F.when(text.rlike(UUID), F.lower(text))


def uuid_of_path(path: Column) -> Column:
    """The UUID that the last part of a path is, with or without an ending."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(uuid(last), uuid(F.regexp_replace(last, r"\.[^.]*$", "")))


def mentions(value: Column, session: Column) -> Column:
    """A text, or JSON as text, holds the id."""
    return F.coalesce(F.contains(value, session), F.lit(False))


def first_by_uuid(rows: DataFrame, files: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with `name`: of the files (path) whose last part is their id, whatever its case, the one of least path; null without any."""
    own = files.select(uuid_of_path(F.col("path")).alias("_uuid"), "path").where("_uuid is not null").groupBy("_uuid").agg(F.min("path").alias(name))
    return rows.withColumn("_uuid", F.lower(key)).join(own, "_uuid", "left").drop("_uuid")


def tree_totals(files: DataFrame, deepest: int | None = None) -> DataFrame:
    """(folder, file_count, byte_count) of every folder above files (path, size), the files of its subfolders counted too.

    A path `a/b/c` lies in the folders `a` and `a/b`; a file without a folder in none.  With `deepest`, folders of more parts are left out.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1 if deepest is None else F.least(F.size(parts) - 1, F.lit(deepest))
    above = F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("file_count"), F.sum("size").cast("bigint").alias("byte_count"))


@F.pandas_udf(T.StringType())
def text_record(text: pd.Series) -> pd.Series:
    """Lines `key: value` as a JSON object: quoted texts, true and false, whole numbers, and anything else as its text; of equal keys the last holds."""

    def value(raw: str) -> object:
        if len(raw) > 1 and raw[0] == raw[-1] == '"':
            return raw[1:-1]
        if raw in ("true", "false"):
            return raw == "true"
        try:
            return int(raw)
        except ValueError:
            return raw

    def record(own: str) -> str:
        lines = [line.strip() for line in own.splitlines()]
        pairs = [line.partition(":") for line in lines if ":" in line and not line.startswith("#")]
        return json.dumps({k.strip(): value(v.strip()) for k, _, v in pairs if k.strip()}, ensure_ascii=False)

    return text.map(record, na_action="ignore")


def side_facts(conversations: DataFrame, key: str, folders: DataFrame, records: DataFrame, shared: DataFrame) -> DataFrame:
    """Conversations with what lies beside them: totals of their folder, the record of their annotation, and how many shared files speak of them.

    `folders` are files (path, size) below folders named by ids, `records` (path, text) files named by ids, `shared` texts (text) of all sessions.
    Shared texts meet ids as words of a UUID's form, so that no text is compared with every id.
    """
    inside = folders.select(uuid(F.element_at(F.split("path", "/"), -2)).alias("_uuid"), "path", "size").where("_uuid is not null").groupBy("_uuid").agg(F.count("*").alias("folder_files"), F.sum("size").cast("bigint").alias("folder_bytes"))
    noted = records.select(uuid_of_path(F.col("path")).alias("_uuid"), "path", "text").where("_uuid is not null").groupBy("_uuid").agg(F.min_by("text", "path").alias("_text")).select("_uuid", text_record(F.col("_text")).alias("annotation"))
    said = shared.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(UUID[1:-1]), F.lit(0)), F.lower))).alias("_uuid")).groupBy("_uuid").agg(F.count("*").alias("shared_mentions"))
    rows = conversations.withColumn("_uuid", F.lower(key)).join(inside, "_uuid", "left").join(noted, "_uuid", "left").join(said, "_uuid", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("folder_files", "folder_bytes", "shared_mentions")}).drop("_uuid")
