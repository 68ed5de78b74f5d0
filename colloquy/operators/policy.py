"""Baseline policies: strict parsing, ids and keys of entries, and which findings they accept.

A policy is a small file, read by the driver's side of a job as one row; what it is laid over
may be of any size.  Entries are rows (place, id, kind, source, reason, report, code,
limitation, support_level, status, added_at); place is the order in the file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version and name of a policy file, the kinds of its entries, the reports whose findings they may accept, and findings that none may.
VERSION = 1
FILE = "baseline-policy.json"
KINDS = ("degraded_source", "finding", "limitation")
REPORTS = ("validate", "archive_verify")
NEVER = ("drift_suspected",)
#: Findings that speak of a source's state, which entries of degraded sources accept.
OF_STATE = ("degraded_support_level", "degraded_source_status")
#: Rules that are broadcast; more are joined like any other rows.
MOST_BROADCAST = 100_000
FIELDS = ("id", "kind", "source", "reason", "report", "code", "limitation", "support_level", "status", "added_at")


def entry_id(kind: Column, source: Column, report: Column, code: Column, limitation: Column, support_level: Column, status: Column) -> Column:
    """The id of an entry that has none of its own."""
    said = lambda *parts: F.concat_ws(":", kind, *[F.coalesce(p, F.lit("*")) for p in parts])
    return F.when(kind == "finding", said(report, source, code)).when(kind == "limitation", said(source, limitation)).otherwise(said(source, support_level, status))


def entry_key() -> Column:
    """What makes entries equal, and their order in a file that is saved: of a row with the fields of an entry."""
    or_any = lambda name: F.coalesce(F.col(name), F.lit("*"))
    by_kind = (
        F.when(F.col("kind") == "finding", F.array("kind", or_any("report"), "source", or_any("code"))).when(F.col("kind") == "limitation", F.array("kind", "source", or_any("limitation")))
        .otherwise(F.array("kind", "source", or_any("support_level"), or_any("status")))
    )
    return by_kind


def _text(path: str) -> Column:
    """A field as text; null if it is absent or null."""
    return F.when(F.schema_of_variant(F.try_variant_get("e", path, "variant")) == "STRING", F.try_variant_get("e", path, "string"))


def _problem() -> Column:
    """What is wrong with an entry `e`, in the order of the checks; null if nothing is."""
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("e", f"$.{name}", "variant")), F.lit("VOID"))
    blank = lambda name: (kind(name) != "VOID") & ((kind(name) != "STRING") | (F.coalesce(F.trim(_text(f"$.{name}")), F.lit("")) == ""))
    checks = [F.when(F.try_variant_get("e", "$", "map<string,variant>").isNull(), F.lit("an entry must be an object"))]
    checks += [F.when(blank(name), F.lit(f"'{name}' must be a text that is not empty")) for name in FIELDS]
    checks += [F.when(kind(name) == "VOID", F.lit(f"'{name}' is required")) for name in ("kind", "source", "reason")]
    checks.append(F.when(~_text("$.kind").isin(*KINDS), F.lit("'kind' is unknown")))
    finding = _text("$.kind") == "finding"
    checks += [F.when(finding & (kind(name) == "VOID"), F.lit(f"'{name}' is required")) for name in ("report", "code")]
    checks += [F.when(finding & _text("$.code").isin(*NEVER), F.lit("'code' may not be suppressed")), F.when(finding & ~_text("$.report").isin(*REPORTS), F.lit("'report' is unknown"))]
    checks.append(F.when((_text("$.kind") == "limitation") & (kind("limitation") == "VOID"), F.lit("'limitation' is required")))
    return F.coalesce(*checks)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a policy file; a file that breaks the form in any way is an error that names the first breach.

    A limitation of an entry that is no limitation, and the like, is left out.
    """
    texts = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    head = texts.select(
        F.try_variant_get("v", "$", "map<string,variant>").isNotNull().alias("whole"), F.try_variant_get("v", "$.version", "string").alias("version"),
        (F.schema_of_variant(F.try_variant_get("v", "$.version", "variant")) == "BIGINT").alias("number"), F.try_variant_get("v", "$.entries", "array<variant>").isNotNull().alias("listed"),
    ).first()
    if head is None or not head.whole:
        raise ValueError(f"{path}: a policy must be a JSON object")
    if not head.number or head.version != str(VERSION):
        raise ValueError(f"{path}: the version of a policy must be {VERSION}")
    if not head.listed:
        raise ValueError(f"{path}: 'entries' must be an array")
    rows = texts.select(F.posexplode(F.try_variant_get("v", "$.entries", "array<variant>")).alias("place", "e"))
    bad = rows.select("place", _problem().alias("problem")).where("problem is not null").orderBy("place").first()
    if bad is not None:
        raise ValueError(f"{path}: entry {bad.place + 1}: {bad.problem}")
    named = rows.select("place", *[_text(f"$.{name}").alias(name) for name in FIELDS])
    of = {"report": "finding", "code": "finding", "limitation": "limitation", "support_level": "degraded_source", "status": "degraded_source"}
    named = named.withColumns({name: F.when(F.col("kind") == kind, F.col(name)) for name, kind in of.items()})
    return named.withColumn("id", F.coalesce("id", entry_id(*[F.col(c) for c in ("kind", "source", "report", "code", "limitation", "support_level", "status")])))


def write_policy(entries: DataFrame, path: str) -> int:
    """Save a policy: one entry of each key, the first by place, in the order of keys; the file is complete or not there. Returns the number of entries."""
    spark = entries.sparkSession
    absent = [F.lit(None).cast("string").alias(name) for name in FIELDS if name not in entries.columns]
    given = with_place(entries).select("*", *absent)
    own = given.withColumn("id", F.coalesce("id", entry_id(*[F.col(c) for c in ("kind", "source", "report", "code", "limitation", "support_level", "status")])))
    first = own.groupBy(entry_key().alias("key")).agg(F.min_by(F.struct(*FIELDS), "place").alias("e")).orderBy("key").select("e.*").collect()  # a policy is a small file
    payload = {"version": VERSION, "entries": [{k: v for k, v in r.asDict().items() if v is not None} for r in first]}
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".policy-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray((json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")
    return len(first)


def with_place(policy: DataFrame) -> DataFrame:
    """The policy with the order of its entries, that of its rows where none is given."""
    return policy if "place" in policy.columns else policy.withColumn("place", F.monotonically_increasing_id())


def _with(policy: DataFrame, *names: str) -> DataFrame:
    absent = [F.lit(None).cast("string").alias(name) for name in names if name not in policy.columns]
    return with_place(policy).select("*", *absent)


def _small(rules: DataFrame) -> DataFrame:
    """The rules, marked for broadcast if they are few, which one count tells."""
    return F.broadcast(rules) if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rules


def degraded_rules(policy: DataFrame, state: DataFrame, keys: list[str], ignore_state: bool = False) -> DataFrame:
    """(keys, id, kind, reason): the most specific entry for the state of each source, from state (keys with source, support_level, status).

    An entry names a support level, a status, both, or neither; what it names must be so (unless the state is ignored).  A support
    level counts more than a status; of equally specific ones the first holds.
    """
    entries = _with(policy, "support_level", "status", "reason").where("kind = 'degraded_source'").select("source", F.struct("place", "id", "kind", "reason", "support_level", "status").alias("e"))
    joined = state.join(_small(entries), "source")
    fits = lambda name: F.col(f"e.{name}").isNull() | F.coalesce(F.col(f"e.{name}") == F.col(name), F.lit(False))
    rows = joined if ignore_state else joined.where(fits("support_level") & fits("status"))
    rank = F.struct(F.col("e.support_level").isNull(), F.col("e.status").isNull(), F.coalesce("e.support_level", F.lit("*")), F.coalesce("e.status", F.lit("*")), F.col("e.place"))
    return rows.groupBy(*keys).agg(F.min_by("e", rank).alias("e")).select(*keys, F.struct("e.id", "e.kind", "e.reason").alias("_of_state"))


def overlay(found: DataFrame, policy: DataFrame, report: str, state: DataFrame | None = None, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Findings (source, code, level, ...) with suppressed_by, suppression_kind and suppression_reason: the entry that accepts each.

    Only warnings of a source are accepted, drift never.  What speaks of the state of a source, where its state is
    given, is accepted by an entry of the degraded source alone; anything else by an entry of the report, source and code, of several the first.
    """
    rules = _with(policy, "reason").where((F.col("kind") == "finding") & (F.col("report") == report)).groupBy("source", "code").agg(F.min_by(F.struct("id", "kind", "reason"), "place").alias("_rule"))
    joined = found.join(_small(rules), ["source", "code"], "left")
    entry = F.col("_rule")
    if state is not None:
        joined = joined.join(degraded_rules(policy, state, list(keys)), list(keys), "left")
        entry = F.when(F.col("code").isin(*OF_STATE), F.col("_of_state")).otherwise(F.col("_rule"))
    open_ = (F.col("level") == "warning") & F.col("source").isNotNull() & ~F.col("code").isin(*NEVER)
    made = {"suppressed_by": "id", "suppression_kind": "kind", "suppression_reason": "reason"}
    return joined.withColumn("_entry", F.when(open_, entry)).withColumns({name: F.col(f"_entry.{of}") for name, of in made.items()}).select(*found.columns, *made)
