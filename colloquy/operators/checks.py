"""Checks of raw rows, files and run manifests: verification of an archive, validation of runs.

Raw JSON is checked as VARIANT values, so that a field of the wrong kind is told from an
absent one; a row is judged by itself, in one pass over the lines.  What a manifest
says is exploded into rows of its sources and joined to the files by path.  Both reports
count each level twice, raw and as a baseline policy leaves it.

JSON that repeats a key is malformed.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import COMPLETENESS, ROLES, SCHEMA_VERSION, STATUSES
from ..session import checkpointed
from .policy import overlay

#: Support levels of sources, counts that a run and each of its sources declare, and flags of a source.
SUPPORT = ("scaffold", "partial", "complete")
COUNTS = ("conversation_count", "skipped_conversation_count", "written_conversation_count", "message_count")
FLAGS = ("failed", "partial", "unsupported")

FINDING = "struct<level:string,code:string,what:string>"


def finding(level: str, code: str, what: Column | str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(what) if isinstance(what, str) else what).cast("string").alias("what"))


def error(code: str, what: Column | str) -> Column:
    return finding("error", code, what)


def warning(code: str, what: Column | str) -> Column:
    return finding("warning", code, what)


def kind(value: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID (a JSON null) or another number; null where nothing is."""
    whole = lambda type_: F.try_variant_get(value, path, type_).isNotNull()
    item = F.try_variant_get(value, path, "variant")
    return F.when(item.isNull(), None).when(whole("array<variant>"), "ARRAY").when(whole("map<string,variant>"), "OBJECT").otherwise(F.schema_of_variant(item))


def text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def required(value: Column, name: str, of: str, what: Column | str | None = None, empty: bool = False) -> Column:
    """A finding where a required field is absent, or of another kind; a text must not be empty unless that is allowed."""
    what, found = name if what is None else what, kind(value, f"$.{name}")
    wrong = found != of if of != "STRING" or empty else (found != of) | (text(value, f"$.{name}") == "")
    return F.when(found.isNull(), error("missing_required_field", what)).when(wrong, error("invalid_field", what))


def _all(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _of_image(image: Column, where: Column) -> Column:
    return F.when(kind(image) != "OBJECT", error("invalid_field", where)).otherwise(required(image, "source", "STRING", F.concat(where, F.lit(".source"))))


def _of_message(m: Column, i: Column) -> Column:
    where = F.concat(F.lit("messages["), (i + 1).cast("string"), F.lit("]"))
    at = lambda name: F.concat(where, F.lit(f".{name}"))
    role, said, images = kind(m, "$.role"), kind(m, "$.text"), kind(m, "$.images")
    known = (role == "STRING") & (text(m, "$.role") != "")
    checks = _all(
        required(m, "role", "STRING", at("role")), F.when(known & ~text(m, "$.role").isin(*ROLES), error("invalid_enum", at("role"))),
        F.when(said.isNull() & images.isNull(), error("missing_required_field", at("text or images"))), F.when(said.isNotNull() & ~said.isin("STRING", "VOID"), error("invalid_field", at("text"))),
        F.when(images.isNotNull() & (images != "ARRAY"), error("invalid_field", at("images"))),
    )
    listed = F.coalesce(F.try_variant_get(m, "$.images", "array<variant>"), F.array().cast("array<variant>"))
    of_images = F.array_compact(F.transform(listed, lambda image, j: _of_image(image, F.concat(at("images["), (j + 1).cast("string"), F.lit("]")))))
    return F.when(kind(m) != "OBJECT", F.array(error("malformed_row", where))).otherwise(F.concat(checks, of_images))


def row_findings(lines: DataFrame, contract: bool = True) -> DataFrame:
    """Every breach of the row's form in lines (source_dir, output_path, row_number, line, ...): the other columns with level, code and what.

    source_dir is the source that the row must declare; with `contract`, its contract must be the current one.  Blank lines are no rows.
    """
    v = F.col("v")
    version, complete = text(v, "$.contract.schema_version"), text(v, "$.transcript_completeness")
    own, said = kind(v, "$.source") == "STRING", kind(v, "$.transcript_completeness")
    checks = [
        required(v, "source", "STRING"), F.when(own & (text(v, "$.source") != "") & (text(v, "$.source") != F.col("source_dir")), error("invalid_field", "source is another")),
        required(v, "execution_context", "STRING"), required(v, "collected_at", "STRING"), required(v, "contract", "OBJECT"),
        F.when(kind(v, "$.contract") == "OBJECT", required(F.try_variant_get(v, "$.contract", "variant"), "schema_version", "STRING", "contract.schema_version")),
        F.when(said.isNotNull() & (said != "STRING"), error("invalid_field", "transcript_completeness")), F.when((said == "STRING") & ~complete.isin(*COMPLETENESS), error("invalid_enum", "transcript_completeness")),
        F.when((said == "STRING") & (complete != "complete"), warning("incomplete_transcript", complete)), required(v, "messages", "ARRAY"),
    ]
    if contract:
        checks.append(F.when((kind(v, "$.contract.schema_version") == "STRING") & (version != "") & (version != SCHEMA_VERSION), error("invalid_contract", version)))
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    whole = F.concat(_all(*checks), F.flatten(F.transform(messages, _of_message)))
    every = F.when(F.coalesce(kind(v) != "OBJECT", F.lit(True)), F.array(error("malformed_row", "line"))).otherwise(whole)
    rows = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    kept = [c for c in lines.columns if c != "line"]
    return rows.select(*kept, F.explode(every).alias("f")).select(*kept, "f.*")


def message_count(lines: DataFrame) -> Column:
    """Messages of a line; 0 where the row or the list is none."""
    return F.greatest(F.coalesce(F.size(F.try_variant_get(F.try_parse_json("line"), "$.messages", "array<variant>")), F.lit(0)), F.lit(0))


def plain_path(path: Column) -> Column:
    """A path without scheme, authority, empty parts and dots; parts before `..` are taken away."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda p: ~p.isin("", "."))
    up = lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def plain_root(root: str) -> str:
    """The plain path of a folder that is given by path or URI."""
    return "/" + "/".join(p for p in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).split("/") if p not in ("", "."))


def file_path(uri: Column) -> Column:
    """The plain path of a file that Spark names by its URI."""
    return plain_path(F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri))


def absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/")


def within(path: Column, root: Column) -> Column:
    """Of plain paths: the path is the root or lies under it."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def manifest_links(manifests: DataFrame, root: str) -> DataFrame:
    """(manifest_path, entry, path, problem): the output that each source of a run names, or what keeps it from being a link.

    A manifest that is no object, or without a list of sources, has one row with its problem; a source without an output has none.
    """
    v = F.col("v")
    rows = manifests.withColumn("v", F.try_parse_json("text"))
    listed = F.try_variant_get(v, "$.sources", "array<variant>")
    whole = F.when(F.coalesce(kind(v) != "OBJECT", F.lit(True)), "manifest").when(listed.isNull(), "sources")
    rows = rows.withColumn("whole", whole).select("manifest_path", "whole", F.posexplode_outer(F.when(F.col("whole").isNull(), listed)).alias("at", "e"))
    e, at = F.col("e"), F.concat(F.lit("sources["), (F.col("at") + 1).cast("string"), F.lit("]"))
    named, said = kind(e, "$.output_path"), text(e, "$.output_path")
    own = plain_path(said)
    of_path = F.concat(at, F.lit(".output_path"))
    problem = (
        F.when(F.col("whole").isNotNull(), F.col("whole")).when(kind(e) != "OBJECT", at).when(named.isNull() | (named == "VOID"), None)
        .when((named != "STRING") | (said == "") | ~absolute(said) | ~within(own, plain_path(F.lit(root))), of_path)
    )
    rows = rows.where(F.col("whole").isNotNull() | F.col("e").isNotNull()).withColumn("problem", problem)
    linked = F.when(F.col("problem").isNull() & (named == "STRING"), own)
    return rows.select("manifest_path", (F.col("at") + 1).alias("entry"), linked.alias("path"), "problem").where("path is not null or problem is not null")


def canonical(source: Column, path: Column) -> Column:
    """The file has the name of a compacted file of its source, whole or one of its parts."""
    name = F.element_at(F.split(path, "/"), -1)
    return (name == F.concat(F.lit("memory_chat_v1-"), source, F.lit(".jsonl"))) | (name.startswith(F.concat(F.lit("memory_chat_v1-"), source, F.lit("-"))) & F.substr(name, F.length(source) + 17).rlike(r"^\d{5}\.jsonl$"))


def by_link(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files (source_dir, output_path) with manifest_linked: a run names the file, or the folder that holds it."""
    paths = links.where("path is not null").select("path").distinct()
    own = file_path(F.col("output_path"))
    held = files.select("output_path", F.explode(F.array(own, F.regexp_replace(own, "/[^/]*$", ""))).alias("path")).join(paths, "path", "left_semi").select("output_path").distinct()
    return files.join(held.withColumn("manifest_linked", F.lit(True)), "output_path", "left").withColumn("manifest_linked", F.coalesce("manifest_linked", F.lit(False)))


def levels(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of findings by keys, raw and active: what an entry accepts counts in finding_count, raw_status and suppressed_warning_count only."""
    is_warning, open_ = F.col("level") == "warning", F.col("suppressed_by").isNull()
    counts = found.groupBy(*keys).agg(
        F.count_if(F.col("level") != "success").alias("finding_count"), F.count_if(is_warning & open_).alias("warning_count"), F.count_if(is_warning & ~open_).alias("suppressed_warning_count"), F.count_if(F.col("level") == "error").alias("error_count"),
    )
    return with_status(counts)


def with_status(counts: DataFrame) -> DataFrame:
    """Adds status, of what is active, and raw_status, of all findings."""
    worst = lambda warnings: F.when(F.col("error_count") > 0, "error").when(warnings > 0, "warning").otherwise("success")
    return counts.withColumns({"status": worst(F.col("warning_count")), "raw_status": worst(F.col("warning_count") + F.col("suppressed_warning_count"))})


class Verified(NamedTuple):
    """Findings (source, output_path, row_number, level, code, what, and the entry that accepts each), and reports by file, by source and of the whole."""

    findings: DataFrame
    files: DataFrame
    sources: DataFrame
    whole: DataFrame


_NO_ENTRIES = "place bigint, id string, kind string, source string, reason string, report string, code string, limitation string, support_level string, status string"
_FILLED = ("row_count", "bad_row_count", "finding_count", "warning_count", "suppressed_warning_count", "error_count")


def verify(lines: DataFrame, files: DataFrame, manifests: DataFrame, root: str, policy: DataFrame | None = None, expected: DataFrame | None = None) -> Verified:
    """Verify an archive from its lines (as of `read_lines`), its files (source_dir, output_path) and its manifests (as of `read_manifests`).

    Besides the breaches of rows: links of manifests that lead nowhere (without a source), files that no
    run names and whose name is not the canonical one, and files of `expected` (source_dir, output_path), such as those of an index, that are gone.
    """
    spark = lines.sparkSession
    links = manifest_links(manifests, root)
    known = by_link(files.select("source_dir", "output_path").distinct(), links).withColumn("orphan", ~F.col("manifest_linked") & ~canonical(F.col("source_dir"), F.col("output_path")))
    none = F.lit(None).cast("bigint").alias("row_number")
    shaped = lambda rows, source, path, row, f: rows.select(source, path, row, f.alias("f")).select("source", "output_path", "row_number", "f.*")
    parts = [
        row_findings(lines.select("source_dir", "output_path", "row_number", "line")).withColumnRenamed("source_dir", "source"),
        shaped(known.where("orphan"), F.col("source_dir").alias("source"), F.col("output_path"), none, warning("orphan_output_file", "output_path")),
        shaped(links.where("problem is not null"), F.lit(None).cast("string").alias("source"), F.col("manifest_path").alias("output_path"), none, warning("invalid_manifest_reference", F.col("problem"))),
    ]
    if expected is not None:
        gone = expected.select("source_dir", "output_path").distinct().join(files.select("output_path"), "output_path", "left_anti")
        parts.append(shaped(gone, F.col("source_dir").alias("source"), F.col("output_path"), none, error("missing_file", "output_path")))
    policy = policy if policy is not None else spark.createDataFrame([], _NO_ENTRIES)
    found = checkpointed(overlay(reduce(DataFrame.unionByName, parts), policy, "archive_verify"))  # rows are parsed once

    rows = lines.where(F.trim("line") != "").groupBy("output_path").agg(F.count("*").alias("row_count"))
    bad = found.where("level = 'error' and row_number is not null").groupBy("output_path").agg(F.count_distinct("row_number").alias("bad_row_count"))
    of_file = levels(found.where("source is not null"), ["output_path"]).drop("status", "raw_status")
    by_file = known.join(rows, "output_path", "left").join(bad, "output_path", "left").join(of_file, "output_path", "left").withColumnRenamed("source_dir", "source")
    by_file = with_status(by_file.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in _FILLED})).withColumn("verified_row_count", F.col("row_count") - F.col("bad_row_count"))
    held = by_file.groupBy("source").agg(F.count("*").alias("file_count"), F.count_if("orphan").alias("orphan_file_count"), *[F.sum(c).alias(c) for c in ("row_count", "verified_row_count", "bad_row_count")])
    of_source = levels(found.where("source is not null"), ["source"]).drop("status", "raw_status")
    sources = held.join(of_source, "source", "full_outer")
    sources = with_status(sources.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in sources.columns if c != "source"}))
    whole = levels(found, []).join(by_file.agg(F.count("*").alias("file_count"), F.count_if("orphan").alias("orphan_file_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("bad_row_count"), F.lit(0)).alias("bad_row_count")))  # one row each
    return Verified(found, by_file, sources, whole)


def _path(v: Column, name: str, what: Column | str | None = None, nullable: bool = False) -> Column:
    """A finding where a required absolute path is absent, of another kind or relative."""
    what, found, said = name if what is None else what, kind(v, f"$.{name}"), text(v, f"$.{name}")
    bad = (found != "STRING") | (said == "") | ~absolute(said)
    return F.when(found.isNull(), error("missing_required_field", what)).when(bad & (found != "VOID") if nullable else bad, error("invalid_field", what))


def _path_of(v: Column, name: str) -> Column:
    """The plain path of a field; null where it is no absolute path."""
    said = text(v, f"$.{name}")
    return F.when((kind(v, f"$.{name}") == "STRING") & absolute(said), plain_path(said))


def _number(v: Column, name: str) -> Column:
    return F.when(kind(v, f"$.{name}") == "BIGINT", F.try_variant_get(v, f"$.{name}", "bigint"))


def _flag(v: Column, name: str) -> Column:
    return F.when(kind(v, f"$.{name}") == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean"))


class Validated(NamedTuple):
    """Findings (run_id, source, output_path, row_number, level, code, what, and the entry that accepts each), and a report of each source of each run."""

    findings: DataFrame
    sources: DataFrame


def validate(manifests: DataFrame, files: DataFrame, lines: DataFrame, root: str, policy: DataFrame | None = None, repository: str | None = None, runs: list[str] | None = None) -> Validated:
    """Validate runs: the form of their manifests, what these declare against the rows of the files they name, and the form of these rows.

    A run of `runs` without a manifest is a missing file.  An output is a file, or a folder whose files are read as one.
    With `repository`, no path may lie under it.  Where a manifest is no object, or lists no sources, nothing else of it is judged.
    """
    spark, v = manifests.sparkSession, F.col("v")
    home = plain_path(F.lit(root))
    inside = lambda path: F.coalesce(within(path, plain_path(F.lit(repository))), F.lit(False)) if repository is not None else F.lit(False)
    outside = lambda name: F.when(inside(_path_of(v, name)), error("external_archive_only_violation", name))
    parsed = manifests.withColumn("v", F.try_parse_json("text")).withColumn("readable", F.coalesce(kind(v) == "OBJECT", F.lit(False)))
    parsed = parsed.withColumn("listed", F.when(F.col("readable"), F.try_variant_get(v, "$.sources", "array<variant>")))

    # The sources, each with its own findings.
    entries = parsed.where("listed is not null").select("run_id", F.coalesce(_path_of(v, "archive_root"), home).alias("home"), F.posexplode("listed").alias("at", "e"))
    e = F.col("e")
    placeholder = F.concat(F.lit("<source #"), (F.col("at") + 1).cast("string"), F.lit(">"))
    known = (kind(e, "$.source") == "STRING") & (text(e, "$.source") != "")
    named = entries.withColumns({
        "source": F.when(known, text(e, "$.source")).otherwise(placeholder), "path": _path_of(e, "output_path"), "support_level": F.when(kind(e, "$.support_level") == "STRING", F.nullif(text(e, "$.support_level"), F.lit(""))),
        "status": F.when(kind(e, "$.status") == "STRING", F.nullif(text(e, "$.status"), F.lit(""))), **{c: _number(e, c) for c in (*COUNTS, "scanned_artifact_count")}, **{c: _flag(e, c) for c in FLAGS},
    })
    named = named.withColumn("entry", F.col("at") + 1).drop("at")

    # The lines of each output, by the path of the file or of its folder.
    own = file_path(F.col("output_path"))
    at_path = lambda rows: rows.withColumn("path", F.explode(F.array(own, F.regexp_replace(own, "/[^/]*$", ""))))
    outputs = named.where("path is not null").select("run_id", "entry", "source", "path")
    present = at_path(files.select("output_path")).select("path").distinct().withColumn("present", F.lit(True))
    read = at_path(lines.select("output_path", "row_number", "line")).join(outputs, "path").withColumn("source_dir", F.col("source"))
    actual = read.where(F.trim("line") != "").groupBy("run_id", "entry").agg(F.count("*").alias("rows"), F.sum(message_count(read)).alias("messages"))
    joined = named.join(present, "path", "left").join(actual, ["run_id", "entry"], "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "messages": F.coalesce("messages", F.lit(0))})

    paths = kind(e, "$.input_roots")
    roots = F.coalesce(F.try_variant_get(e, "$.input_roots", "array<variant>"), F.array().cast("array<variant>"))
    expected = S.expected_status(F.col("failed"), F.col("unsupported"), F.col("partial"))
    flagged = F.col("failed").isNotNull() & F.col("unsupported").isNotNull() & F.col("partial").isNotNull()
    path, written = F.col("path"), F.col("written_conversation_count")
    unnamed = path.isNull()
    checks = [
        required(e, "source", "STRING"), F.when(paths.isNotNull() & ~paths.isin("ARRAY", "VOID"), error("invalid_field", "input_roots")),
        required(e, "support_level", "STRING"), F.when(~F.col("support_level").isin(*SUPPORT), error("invalid_enum", "support_level")), F.when(F.col("support_level") != "complete", warning("degraded_support_level", F.col("support_level"))),
        required(e, "status", "STRING"), F.when(~F.col("status").isin(*STATUSES), error("invalid_enum", "status")), F.when(F.col("status") != "complete", warning("degraded_source_status", F.col("status"))),
        _path(e, "archive_root"), F.when(inside(_path_of(e, "archive_root")), error("external_archive_only_violation", "archive_root")), F.when(_path_of(e, "archive_root") != F.col("home"), error("invalid_field", "archive_root is another")),
        _path(e, "output_path", nullable=True), *[required(e, c, "BIGINT") for c in COUNTS], *[required(e, c, "BOOLEAN") for c in FLAGS],
        F.when(flagged & (F.col("status") != expected), error("status_mismatch", expected)),
        F.when(unnamed & F.col("status").isin("complete", "partial"), error("missing_required_field", "output_path of the status")), F.when(unnamed & (F.coalesce(written, F.lit(0)) != 0), error("count_mismatch", "written_conversation_count without output_path")),
        F.when(inside(path), error("external_archive_only_violation", "output_path")), F.when(path.isNotNull() & ~within(path, F.col("home")), error("invalid_field", "output_path is outside")),
        F.when(path.isNotNull() & F.col("present").isNull(), error("missing_file", "output_path")),
        F.when(F.col("conversation_count") != F.col("skipped_conversation_count") + written, error("count_mismatch", "skipped and written")),
        F.when(written != F.col("rows"), error("count_mismatch", "written_conversation_count")), F.when(F.col("message_count") != F.col("messages"), error("count_mismatch", "message_count")),
        F.when((F.col("scanned_artifact_count") > 0) & (F.col("conversation_count") == 0), warning("drift_suspected", "conversation_count")),
    ]
    of_root = lambda r, i: F.when((kind(r) != "STRING") | (text(r, "$") == "") | ~absolute(text(r, "$")), error("invalid_field", F.concat(F.lit("input_roots["), (i + 1).cast("string"), F.lit("]"))))
    every = F.when(kind(e) != "OBJECT", F.array(error("invalid_field", F.concat(F.lit("sources["), F.col("entry").cast("string"), F.lit("]"))))).otherwise(F.concat(_all(*checks), F.array_compact(F.transform(roots, of_root))))
    of_source = joined.select("run_id", "entry", "source", F.col("path").alias("output_path"), F.lit(None).cast("bigint").alias("row_number"), F.explode(every).alias("f")).select("run_id", "entry", "source", "output_path", "row_number", "f.*")
    of_rows = row_findings(read.select("run_id", "entry", "source", "source_dir", "output_path", "row_number", "line"), contract=False).drop("source_dir")

    # The runs, whose totals are those of their sources.
    sums = joined.groupBy("run_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"sum_{c}") for c in COUNTS], F.count_if("failed").alias("sum_failed"), F.count("*").alias("sum_sources"))
    totals = parsed.join(sums, "run_id", "left")
    said = lambda name, total: F.when(F.col("listed").isNotNull() & (_number(v, name) != F.coalesce(total, F.lit(0))), error("count_mismatch", name))
    run_dir, stated = _path_of(v, "run_dir"), _path_of(v, "manifest_path")
    of_run = [
        finding("success", "manifest_loaded", "manifest"), required(v, "run_id", "STRING"), F.when((kind(v, "$.run_id") == "STRING") & (text(v, "$.run_id") != "") & (text(v, "$.run_id") != F.col("run_id")), error("invalid_field", "run_id is another")),
        _path(v, "archive_root"), outside("archive_root"), F.when(_path_of(v, "archive_root") != home, error("invalid_field", "archive_root is another")),
        _path(v, "run_dir"), outside("run_dir"), _path(v, "manifest_path"), outside("manifest_path"), F.when(stated != F.col("manifest_path"), error("invalid_field", "manifest_path is another")),
        F.when(F.col("manifest_path") != F.concat(run_dir, F.lit("/manifest.json")), error("invalid_field", "run_dir is another")),
        *[required(v, c, "BIGINT") for c in ("source_count", "failed_source_count", *COUNTS)], F.when(F.col("listed").isNull(), error("invalid_field", "sources")),
        said("source_count", F.col("sum_sources")), said("failed_source_count", F.col("sum_failed")), *[said(c, F.col(f"sum_{c}")) for c in COUNTS],
    ]
    whole = F.when(F.col("readable"), _all(*of_run)).otherwise(F.array(error("invalid_field", "manifest")))
    none = [F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("source")]
    of_runs = totals.select("run_id", *none, F.col("manifest_path").alias("output_path"), F.lit(None).cast("bigint").alias("row_number"), F.explode(whole).alias("f")).select("run_id", "entry", "source", "output_path", "row_number", "f.*")

    parts = [of_source.withColumn("entry", F.col("entry").cast("int")), of_rows.withColumn("entry", F.col("entry").cast("int")), of_runs]
    if runs is not None:
        asked = spark.createDataFrame([(r,) for r in runs], "run_id string").join(manifests.select("run_id"), "run_id", "left_anti")
        parts.append(asked.select("run_id", *none, F.lit(None).cast("string").alias("output_path"), F.lit(None).cast("bigint").alias("row_number"), error("missing_file", "manifest").alias("f")).select("run_id", "entry", "source", "output_path", "row_number", "f.*"))
    every_finding = reduce(DataFrame.unionByName, parts)
    policy = policy if policy is not None else spark.createDataFrame([], _NO_ENTRIES)
    found = checkpointed(overlay(every_finding, policy, "validate", joined.select("run_id", "entry", "source", "support_level", "status"), keys=("run_id", "entry", "source")))

    facts = joined.select("run_id", "entry", "source", "support_level", "status", F.col("path").alias("output_path"), F.col("rows").alias("row_count"), F.col("messages").alias("actual_message_count"), *COUNTS).withColumn("entry", F.col("entry").cast("int"))
    report = levels(found.where("entry is not null"), ["run_id", "entry"]).withColumnsRenamed({"status": "validation_status", "raw_status": "raw_validation_status"})
    sources = facts.join(report, ["run_id", "entry"], "left").withColumns({
        **{c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("finding_count", "warning_count", "suppressed_warning_count", "error_count")}, **{c: F.coalesce(c, F.lit("success")) for c in ("validation_status", "raw_validation_status")},
    })
    validated = sources.where("raw_validation_status = 'success'").select("run_id", "entry", "source", "output_path", F.lit(None).cast("bigint").alias("row_number"), F.lit("success").alias("level"), F.lit("source_validated").alias("code"), F.lit("source").alias("what"))
    return Validated(found.unionByName(validated, allowMissingColumns=True), sources)
