"""Reading and writing archives: JSON lines in a folder for each source, and run manifests."""

from __future__ import annotations

import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..model import CONVERSATION, RUN
from ..operators.checks import file_path
from ..session import bounded_batches

FILES = "*.{jsonl,txt}"
#: Folders beside those of the sources.
RESERVED = ("runs", "archive-index")


def folder_of(uri: Column) -> Column:
    """Name of the folder of a file that Spark names by its URI, without escapes."""
    folder = F.try_element_at(F.split(uri, "/"), F.lit(-2))
    return F.coalesce(F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))), folder)


def numbered(lines: DataFrame, path: str, name: str) -> DataFrame:
    """Adds the number of each line in its file, from 1, to rows (path, _block, _order, ...).

    Lines are counted by split, and only lines of one split are sorted together.
    """
    counts = lines.groupBy(path, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(path).orderBy("_block")) - F.col("_n")
    starts = counts.select(path, "_block", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy(path, "_block").orderBy("_order"))
    return lines.withColumn(name, inside).join(starts, [path, "_block"]).withColumn(name, (F.col(name) + F.col("_start")).cast("bigint")).drop("_start")


def read_lines(spark: SparkSession, root: str, source: str | list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """(source_dir, output_path, row_number, line): all lines, numbered from 1 within their file.

    Files are read in splits; a line's number comes from the order of the splits
    of its file and of the lines in them.  Of `source`, one or several may be named.  With `paths`, only these files are read, named as in output_path.
    """
    bounded_batches(spark)  # lines are as long as their conversations
    own = [urllib.parse.unquote(p) for p in paths] if paths else [f"{root}/{s}/{FILES}" for s in (source if isinstance(source, list) else [source or "*"])]
    lines = spark.read.text(own).select(
        F.col("_metadata.file_path").alias("output_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"), F.col("value").alias("line")
    )
    return numbered(lines, "output_path", "row_number").select(folder_of(F.col("output_path")).alias("source_dir"), "output_path", "row_number", "line").where(~F.col("source_dir").isin(*RESERVED))


def parsed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Typed conversations; in strict mode a line that is no JSON object is an error, else it is left out."""
    schema = T._parse_datatype_string(f"{CONVERSATION}, _corrupt string")
    rows = lines.where(F.trim("line") != "").withColumn("_row", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row._corrupt").isNotNull()
    rows = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("malformed row "), F.col("row_number").cast("string"), F.lit(" of "), F.col("output_path")))).otherwise(F.lit(True))) if strict else rows.where(~bad)
    names = [f.name for f in schema.fields if f.name != "_corrupt"]
    return rows.select(*[F.col(f"_row.{n}").alias(n) for n in names], "source_dir", "output_path", "row_number", "line")


def invalid_rows(lines: DataFrame) -> DataFrame:
    """(source_dir, output_path, row_number, reason) of lines that break the row's form: no JSON object, a required field absent or of another kind, messages that are no list."""
    v = F.try_parse_json("line")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: kind(path) == "STRING"
    checks = [F.when(~F.coalesce(text(f"$.{name}"), F.lit(False)), F.lit(name)) for name in ("source", "execution_context", "collected_at")]
    checks.append(F.when(~F.coalesce(kind("$.messages").startswith("ARRAY"), F.lit(False)), F.lit("messages")))
    checks += [F.when(kind(f"$.{name}").isNotNull() & ~kind(f"$.{name}").isin("STRING", "VOID"), F.lit(name)) for name in ("source_session_id", "source_artifact_path", "superseded_at", "transcript_completeness")]
    rows = lines.where(F.trim("line") != "").withColumn("v", v)
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reasons = F.when(~whole, F.array(F.lit("no JSON object"))).otherwise(F.array_compact(F.array(*checks)))
    return rows.select("source_dir", "output_path", "row_number", F.explode(reasons).alias("reason"))


def read_archive(spark: SparkSession, root: str, source: str | list[str] | None = None, strict: bool = True, include_superseded: bool = False) -> DataFrame:
    rows = parsed(read_lines(spark, root, source), strict)
    return rows if include_superseded else rows.where(S.is_active(F.col("superseded_at")))


def conversation_names() -> list[str]:
    """Names of a row's fields."""
    return [f.name for f in T._parse_datatype_string(CONVERSATION).fields]


def json_line(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(source, line): the canonical JSON of each row."""
    own = [n for n in (names or conversation_names()) if n in df.columns]
    return df.select("source", S.conversation_json(*own).alias("line"))


def write_archive(conversations: DataFrame, root: str, source_column: str = "source") -> None:
    """Append JSON lines in a folder for each source, in one pass over the rows.

    Spark writes a staging folder inside the archive; its files, which have unique
    names, are then moved, so that no run can cut another's file and no reader sees half a
    write of a file.  Rows without a source are an error.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = json_line(conversations.withColumn("source", F.col(source_column)))
    named = F.coalesce(F.col("source"), F.raise_error(F.lit("a conversation without source cannot be written")).cast("string"))
    jvm = spark._jvm
    staging = jvm.org.apache.hadoop.fs.Path(f"{root}/.staging-{uuid.uuid4().hex}")
    rows.select(named.alias("source_dir"), "line").write.partitionBy("source_dir").text(staging.toString())
    place_staged(spark, root, staging)


def place_staged(spark: SparkSession, root: str, staging) -> None:
    """Move files that were written by source_dir from a staging folder into the archive's folders."""
    jvm = spark._jvm
    fs = staging.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(staging):
        name = folder.getPath().getName()
        if name.startswith("source_dir="):
            target = jvm.org.apache.hadoop.fs.Path(root, urllib.parse.unquote(name.removeprefix("source_dir=")))
            fs.mkdirs(target)
            for file in fs.listStatus(folder.getPath()):
                if not fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(target, file.getPath().getName())):
                    raise OSError(f"cannot move {file.getPath()} to {target}")
    fs.delete(staging, True)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run manifests, one row each."""
    return spark.read.schema(RUN).json(f"{root}/runs/*/manifest.json", multiLine=True)


def found_any(spark: SparkSession, pattern: str) -> bool:
    """Whether any file has a path of the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, manifest_path, text) of each run, named by its folder; texts are not judged.  An archive without runs gives no rows."""
    pattern = f"{root}/runs/*/manifest.json"
    if not found_any(spark, pattern):
        return spark.createDataFrame([], "run_id string, manifest_path string, text string")
    path = F.col("_metadata.file_path")
    return spark.read.text(pattern, wholetext=True).select(folder_of(path).alias("run_id"), file_path(path).alias("manifest_path"), F.col("value").alias("text"))


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """(source_dir, output_path, size_bytes, modified): the files of an archive, without reading them."""
    found = spark.read.format("binaryFile").load(f"{root}/*/{FILES}")
    path = F.col("_metadata.file_path")
    named = found.select(folder_of(path).alias("source_dir"), path.alias("output_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return named.where(~F.col("source_dir").isin(*RESERVED))


def file_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files that were added, updated (size or time) or removed since they were stored."""
    a = stored.select("output_path", F.col("size_bytes").alias("_s"), F.col("modified").alias("_m"))
    b = found.select("output_path", F.col("size_bytes").alias("_t"), F.col("modified").alias("_n"))
    change = F.when(F.col("_s").isNull(), "added").when(F.col("_t").isNull(), "removed").when((F.col("_s") != F.col("_t")) | (F.col("_m") != F.col("_n")), "updated")
    return a.join(b, "output_path", "full_outer").select("output_path", change.alias("change")).where("change is not null")
