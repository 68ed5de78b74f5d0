"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each source gets a target of words: the total is shared out by weight, a target
stops at `MOST_EPOCHS` times its source's size, and what that leaves is shared
again by weight.  Complete epochs come first: every document is taken
floor(target / source size) times.  The rest of the target is drawn without
replacement: each document gets the key -ln(u) / quality weight, with u from a
hash of its id, and the words of a source are taken in ascending order of the
key until its budget is used up; the document at the boundary gives the words
that are left.

The prefix sums need no sorted source in one task: `measured` keeps a row of a few
numbers for each document, keys fall into ranges of their logarithm (which spreads
them alike whatever the quality weights are), and the sums of the ranges give the range in
which each source's budget ends.  That range is cut into finer ones (`RANGES` to a
unit), and only the rows of the last are sorted.  What comes out is one cut for each source; every document is then
judged by itself against the cut of its source, so texts are never dealt out.

Defined results: a null or empty text has size 0 and takes nothing; a null source
is a source of its own, the last in order; a source of size 0 has target 0; equal
keys are ordered by id, nulls last, then by a hash of the text; repeated ids share a
key, a null id has one by its text.  Rows that are equal in key, id and text are
one draw: where the budget ends among them, each gets the same number of words.  Texts of
any length are read whole; an empty table gives an empty one.  Columns of the input
called size, source_size, target, epochs or taken are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
RANGES = (1 << 6, 1 << 13, 1 << 20)
#: Sources whose plan is broadcast; the plan of more sources is dealt out, with SALTS copies against hot ones.
MOST_BROADCAST = 100_000
SALTS = 64
SEED = "mix-1"


def words_of(text: Column) -> Column:
    """Number of runs of `[^\\x20\\x09-\\x0D]`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters and blanks in the text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.1))


def uniform(id_: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), from the first 48 bits of a hash of the id, of the text for a null id."""
    own = F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), 1, 12), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources are filled in ascending order of cap / weight: a source is capped
    if its cap is at most what its weight would get of the words and weights
    that the capped sources before it leave.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything = W.partitionBy(F.lit(1))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final).alias("target"))


def measures(id_: Column, text: Column, source: Column, quality: Column | None) -> Column:
    """What the mix needs of a document, as a struct (id, source, size, key, tie)."""
    weight = quality_weight(text) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-9))
    return F.struct(id_.alias("id"), source.alias("source"), words_of(text).alias("size"), (-F.log(uniform(id_, text)) / weight).alias("key"), F.xxhash64(text).alias("tie"))


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None) -> DataFrame:
    """(id, source, size, key, tie) of each document."""
    return docs.select(measures(F.col(f"`{id_column}`"), F.col(f"`{text}`"), F.col(f"`{source}`"), quality).alias("m")).select("m.*")


def cuts(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, budget, cut), one row for each source of `measured` rows.

    cut is the draw at which the budget ends, as a struct (key, last, id, tie, words): what
    each row of that draw gives.  It is null if the budget ends at no row.
    """
    ranges = [F.floor(F.log("key") * n) for n in RANGES]
    sums = checkpointed(rows.groupBy("source", ranges[0].alias("range")).agg(F.sum("size").alias("words")))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint"))
    plan = checkpointed(plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")).drop("weight", "cap"))
    # left: the words of the budget that are left where the range begins.
    budgets = plan.select(F.col("source").alias("_source"), F.col("budget").alias("left"))
    sums = sums.join(budgets, F.col("source").eqNullSafe(F.col("_source")))
    for k, finer in enumerate([*ranges[1:], None]):
        before = F.sum("words").over(W.partitionBy("_source").orderBy("range")) - F.col("words")
        ends = sums.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        ends = checkpointed(ends.select("_source", F.col("range").alias("_range"), (F.col("left") - F.col("before")).alias("left")))
        inside = with_plan(rows, ends, ranges[k] == F.col("_range"))
        if finer is not None:
            sums = inside.groupBy("_source", "left", finer.alias("range")).agg(F.sum("size").alias("words"))
    draws = inside.groupBy("_source", "left", "key", F.col("id").isNull().alias("last"), "id", "tie").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    order = W.partitionBy("_source").orderBy("key", "last", "id", "tie")
    left = F.col("left") - (F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size"))
    cut = F.struct("key", "last", "id", "tie", F.floor(F.col("left") / F.col("n")).cast("bigint").alias("words"))
    found = draws.withColumn("left", left).where((F.col("left") >= 0) & (F.col("left") < F.col("n") * F.col("size"))).select("_source", cut.alias("cut"))
    return checkpointed(plan.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def with_plan(rows: DataFrame, plan: DataFrame, also: Column | None = None) -> DataFrame:
    """Rows with what the plan (by _source) says of their source; a small plan is broadcast, a large one has copies for the salts of the rows."""
    same = F.col("source").eqNullSafe(F.col("_source")) if also is None else F.col("source").eqNullSafe(F.col("_source")) & also
    if plan.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(plan), same)
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod(F.xxhash64("tie", "id"), F.lit(SALTS)) == F.col("_salt"))).drop("_salt")


def _amounts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, epochs and taken to rows with the columns of `measured`."""
    joined = with_plan(rows, plan.withColumnRenamed("source", "_source"))
    own = F.struct("key", F.col("id").isNull().alias("last"), "id", "tie")
    cut = F.struct("cut.key", "cut.last", "cut.id", "cut.tie")
    # No cut: a budget of 0 takes nothing, any other is the whole source.
    extra = F.when(F.col("budget") <= 0, F.lit(0)).when(F.col("cut").isNull() | (own < cut), F.col("size")).when(own == cut, F.col("cut.words")).otherwise(F.lit(0))
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("bigint"))


def amounts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) of each document, without its other columns."""
    rows = checkpointed(measured(docs, id_column, text, source, quality))
    return _amounts(rows, cuts(rows)).select(F.col("id").alias(id_column), F.col("source").alias(source), "size", "source_size", "target", "epochs", "taken")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None) -> DataFrame:
    """Adds size, source_size, target, epochs and taken to each row of docs; columns of these names are replaced."""
    plan = cuts(checkpointed(measured(docs, id_column, text, source, quality)))
    made = ("size", "source_size", "target", "epochs", "taken")
    others = [c for c in docs.columns if c not in made]
    own = measures(F.col(f"`{id_column}`"), F.col(f"`{text}`"), F.col(f"`{source}`"), quality)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), own.alias("m")).select("row", "m.*")
    return _amounts(rows, plan).select(*[F.col(f"row.`{c}`").alias(c) for c in others], *made)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return amounts(docs).select("doc_id", "size", "source_size", "target", "taken")
