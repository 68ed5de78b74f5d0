"""Personal data: candidate spans of high recall, judged by boosted trees.

The base patterns give spans that always stay.  Further generators propose spans that
overlap freely (a run of digits may be a card and a phone number); boosted trees over the
form of a candidate and the words around it score them, and thresholds calibrated for each
kind accept some.  Of accepted spans that overlap, those of the base stay; without one,
the span of the highest score.

All is built-in expressions.  A pattern's matches have no positions in SQL, so a text is
also split by the pattern: a match starts where the pieces and matches before it end.
Texts are read once and never shuffled; only their candidates are, one text's to one task.
Patterns are written so that no text, however long, makes one search its start again: runs
are taken whole (possessive) and only from their first character.

Defined cases: a null text is an empty one; rows are told apart by their place, so null and
repeated ids are rows like any others; an empty table gives no rows.  Positions are code
points from 0, ends exclusive.  Of other columns none is read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .pii_model import Model, digits, features, luhn, trained

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")

#: The base patterns.  Each run of an address's first part or of digits is taken from its start and whole, and a card
#: only from 13 digits on, which changes no match that passes its test: what they leave out could not match or would be dropped.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NO_TOKEN = r"\s<>()\[\],;:\"'|@"
_AT = r"(?:\x20?[\[({<]\x20?(?:at|arroba|chez)\x20?[\])}>]\x20?|\x20(?:at|AT|arroba)\x20)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|punkt|punto|point)\x20?[\])}>]\x20?|\x20(?:dot|DOT|punkt|punto|point)\x20|\.)"
_SAID = rf"[\[({{<]\x20?(?:at|arroba|chez)\x20?[\])}}>]|\x20(?:at|AT|arroba)\x20[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9]"
#: A run of what numbers are written with, from its first digit, sign or bracket on.  All matches of the number patterns lie in one.
ZONE = r"[0-9+(][0-9\x20()./,+\-\[\]]{6,}+"


class Pattern(NamedTuple):
    kind: str
    pattern: str
    base: bool = False
    #: Text or pattern without which a text is not searched.
    holds: str | None = None
    rlike: str | None = None


#: Patterns over whole texts.
WORDY = (
    Pattern("email", BASE["email"], True, holds="@"),
    Pattern("email", rf"(?<![^{_NO_TOKEN}])[^{_NO_TOKEN}]{{1,64}}+@[^{_NO_TOKEN}]{{0,254}}[\p{{L}}0-9]", holds="@"),
    Pattern("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", rlike=_SAID),
    Pattern("ip", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])", rlike=":[0-9A-Fa-f]{0,4}:"),
)
#: Patterns over the zones of numbers.
NUMERIC = (
    *[Pattern(kind, BASE[kind], True) for kind in ("ip", "card", "phone")],
    Pattern("ip", r"(?<![0-9.,])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\.|,)[0-9]{1,3}){3}(?![0-9.,])"),
    Pattern("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    Pattern("card", r"(?<![0-9])[0-9]{4}[\x20./-](?:[0-9]{4}[\x20./-][0-9]{4}[\x20./-][0-9]{4}|[0-9]{6}[\x20./-][0-9]{5})(?![0-9])"),
    Pattern("phone", r"(?<![0-9+.])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,3}\(?[0-9]{2,8}\)?){1,6}(?![0-9])"),
    Pattern("phone", r"(?<![0-9.+-])[0-9]{9,12}(?![0-9])"),
)
PATTERNS = WORDY + NUMERIC
#: Characters of a candidate's surroundings that the features read.
BEFORE, AFTER = 40, 16
_FOUND = "array<struct<gen:int,nth:int,hit:string,before:string,after:string,skipped:int,size:int>>"


def base_valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a base pattern is one: the tests of its kind."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    n = F.length(digits(hit))
    card = n.between(13, 19) & luhn(digits(hit))
    return F.when(kind == "ip", hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")).when(kind == "card", card).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _found(gen: int, text: Column, hits: Column, pattern: str) -> Column:
    """What a pattern finds in a text: each match with its surroundings and the size of the piece before it."""

    def of(pieces: Column) -> Column:
        at = lambda i: F.get(pieces, i)
        return F.transform(hits, lambda hit, i: F.struct(
            F.lit(gen).alias("gen"), i.alias("nth"), hit.alias("hit"), F.right(at(i), F.lit(BEFORE)).alias("before"), F.left(at(i + 1), F.lit(AFTER)).alias("after"), F.length(at(i)).alias("skipped"), F.length(hit).alias("size"),
        ))

    # The pieces stand in an array of one, whose transform hands them over computed once.
    return F.when(F.size(hits) > 0, F.element_at(F.transform(F.array(F.split(text, pattern, -1)), of), 1)).otherwise(F.array().cast(_FOUND))


def _matches(p: Pattern, text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(p.pattern), F.lit(0))
    held = F.contains(text, F.lit(p.holds)) if p.holds else text.rlike(p.rlike) if p.rlike else None
    return hits if held is None else F.when(held, hits).otherwise(F.array().cast("array<string>"))


def proposed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, kind, base, hit, before, after, start, end): spans of the base, and candidates that may overlap them and one another.

    A text without any has a row without a span.  Whole texts are searched for zones of numbers and for what is
    written with words; the number patterns search the zones only.
    """
    zone, text = len(PATTERNS), F.col("text")
    scans = [*enumerate(WORDY), (zone, Pattern("", ZONE))]
    texts = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    listed = texts.withColumns({f"_hits{gen}": _matches(p, text) for gen, p in scans})
    every = F.concat(*[_found(gen, text, F.col(f"_hits{gen}"), p.pattern) for gen, p in scans])
    rows = listed.select("key", "doc_id", F.explode_outer(every).alias("z"))

    # Inside a zone, its own matches; any other match is its own and only one.
    whole, numbers = F.col("z.hit"), list(enumerate(NUMERIC, len(WORDY)))
    rows = rows.withColumns({f"_hits{gen}": F.when(F.col("z.gen") == zone, _matches(p, whole)).otherwise(F.array().cast("array<string>")) for gen, p in numbers})
    inside = F.concat(*[_found(gen, whole, F.col(f"_hits{gen}"), p.pattern) for gen, p in numbers])
    itself = F.array(F.struct(F.col("z.gen").alias("gen"), F.lit(0).alias("nth"), whole.alias("hit"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(0).alias("skipped"), F.col("z.size").alias("size")))
    rows = rows.select("key", "doc_id", "z", F.posexplode_outer(F.when(F.col("z.gen") == zone, inside).when(F.col("z.gen").isNotNull(), itself)).alias("_at", "m"))
    before = F.when(F.col("m.skipped") < BEFORE, F.right(F.concat("z.before", "m.before"), F.lit(BEFORE))).otherwise(F.col("m.before"))
    after = F.left(F.concat("m.after", "z.after"), F.lit(AFTER))
    flat = rows.select(
        "key", "doc_id", "_at", F.col("z.gen").alias("_zone"), F.col("z.nth").alias("_nth"), F.col("z.skipped").alias("_skipped"), F.col("z.size").alias("_size"),
        "m.gen", "m.nth", "m.skipped", "m.size", "m.hit", before.alias("before"), F.when(F.col("z.gen") == zone, after).otherwise(F.col("z.after")).alias("after"),
    ).repartition("key")

    # A zone ends where all pieces and zones up to it end; each counts once, with its first row.
    up_to = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_skipped") + F.col("_size")).otherwise(0)
    zone_end = F.sum(first).over(up_to(W.partitionBy("key", "_zone").orderBy("_nth", "_at")))
    match_end = F.sum(F.col("skipped") + F.col("size")).over(up_to(W.partitionBy("key", "_zone", "_nth", "gen").orderBy("nth")))
    placed = flat.withColumns({"_end": zone_end - F.col("_size"), "_match_end": match_end}).withColumn("end", F.col("_end") + F.col("_match_end"))
    named = placed.withColumns({
        "kind": F.get(F.array(*[F.lit(p.kind) for p in PATTERNS]), F.col("gen")), "base": F.get(F.array(*[F.lit(p.base) for p in PATTERNS]), F.col("gen")), "start": F.col("end") - F.col("size"),
    })
    # A match that fails its test, or a candidate inside a word, leaves a row without a span, so that no text is lost.
    loose = ~F.col("before").rlike(r"[\p{L}0-9]$") & ~F.col("after").rlike(r"^[\p{L}0-9]")
    right = F.when(F.col("base"), base_valid(F.col("kind"), F.col("hit"))).otherwise(loose)
    return named.select("key", "doc_id", *[F.when(right, F.col(c)).alias(c) for c in ("kind", "base", "hit", "before", "after", "start", "end")])


def accepted(spans: DataFrame, model: Model) -> DataFrame:
    """(key, doc_id, kind, base, start, end, score) of the spans that stay, and the rows without a span."""
    scored = spans.withColumns(features(F.col("hit"), F.col("before"), F.col("after"))).withColumn("score", F.when(F.col("base"), 1.0).otherwise(model.probability(F.col("kind"))))
    # What does not pass stays as a row without a span; a filter would be pushed down and computed with all features once more.
    stays = F.col("base") | (F.col("score") >= model.threshold(F.col("kind")))
    passed = scored.select("key", "doc_id", *[F.when(stays, F.col(c)).alias(c) for c in ("kind", "base", "start", "end", "score")])
    # Overlapping spans form a cluster: a span starts one if all before it have ended.
    own = W.partitionBy("key").orderBy("start", "end", "kind", "base")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    fresh = passed.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    clustered = fresh.withColumn("_cluster", F.sum("_fresh").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    together = W.partitionBy("key", "_cluster")
    rank = F.struct("score", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), "kind")
    best = clustered.withColumns({"_base": F.max("base").over(together), "_best": F.max(F.when(~F.col("base"), rank)).over(together), "_rank": rank})
    keep = F.col("kind").isNull() | F.col("base") | (~F.col("_base") & (F.col("_rank") == F.col("_best")))
    return best.where(keep).select("key", "doc_id", "kind", "base", "start", "end", "score")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(key, doc_id, spans) of each row: its spans (place of the kind in KINDS, kind, start, end, base, score), by kind and place."""
    model = model or trained(docs.sparkSession, proposed)
    span = F.struct((F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).alias("order"), "start", "end", "kind", "base", "score")
    kept = F.collect_list(F.when(F.col("kind").isNotNull(), span))
    # A span that two generators propose alike is one span.
    return accepted(proposed(docs), model).groupBy("key", "doc_id").agg(F.sort_array(F.array_distinct(kept)).alias("spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) with each span, or run of overlapping ones, as the kind of its first in brackets."""
    texts = docs.select(F.monotonically_increasing_id().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda state, s: F.when(s["start"] < state["at"], F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(state["out"], F.substr("text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    done = lambda state: F.concat(state["out"], F.substr("text", (state["at"] + 1).cast("int"), F.length("text")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    return personal_data(docs, model).join(texts, "key").select("doc_id", F.aggregate(by_place, start, step, done).alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
