"""Document fingerprints by I-Match with several randomised lexicons.

The lexicon keeps the terms whose share of documents lies in a band, so neither
the common nor the rare ones.  Of each text the distinct lexicon terms are
sorted, and `SUBSETS` random subsets of the lexicon, each with one term in
`ONE_IN`, give one hash each over the terms of the text that they hold.  The
subsets of a draw share out the whole lexicon, so that each term is in one
subset of every draw.  Two texts are as alike as the share of equal hashes among those subsets that hold a
term of either.

The number of lexicon terms is at most (mean distinct terms of a document) /
`LOW`, whatever the number of documents.  Their table is broadcast up to
`MOST_BROADCAST` terms and joined by a shuffle beyond.  Words meet that table as
rows, so that splitting, hashing and looking up run as generated code; a text's
rows stay in its own task, and carry its id and a few numbers only.

Defined results: a null text is an empty one; a text without any chosen term, an
empty one too, has a fingerprint of its whole text, like another only if equal; an
only document is its own next one.  Documents are in the order of their ids, a
null id last; rows that repeat an id with its text are one document, which gives
equal rows, as many as they are; different texts of one id are documents of their own in the order of a hash.
Texts of any length are read whole; an empty table gives an empty one; only
doc_id and text of the input are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, document_keys, table

LOW, HIGH = 0.002, 0.05
DRAWS = 1
ONE_IN = 64
#: Subsets of one draw: all classes of the terms by a random hash, so disjoint and without a term left over.
CHOICES = ONE_IN
SUBSETS = DRAWS * CHOICES
#: A subset's number gives its draw and its class.
NUMBERS = tuple(d * ONE_IN + c for d in range(DRAWS) for c in range(CHOICES))
#: Lexicon terms that are broadcast, at 16 bytes each.
MOST_BROADCAST = 2_000_000
#: Stands for the text itself among its words, so that each text has a row.
WHOLE = -1


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty string may come first or last."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subset): the hashes of the terms in the band, once for each subset that holds them.

    The empty term has one row, with the subset WHOLE.
    """
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word")).where("word <> ''")
    often = words.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("docs"))
    chosen = often.where((F.col("docs") >= F.lit(low) * n) & (F.col("docs") < F.lit(high) * n))
    draws = chosen.select("term", F.explode(F.array(*[F.lit(d) for d in range(DRAWS)])).alias("draw"))
    classes = draws.select("term", "draw", F.pmod(F.xxhash64("term", "draw"), F.lit(ONE_IN)).cast("int").alias("class"))
    held = classes.select("term", (F.col("draw") * ONE_IN + F.col("class")).alias("subset"))
    return checkpointed(held.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(WHOLE).alias("subset"))))


def hashes_of(texts: DataFrame, terms: DataFrame, keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried, hashes) of rows (keys, carried, text): one 32-bit hash for each subset, null where it holds no term of the text.

    Rows of equal keys must be equal.  Only the row that stands for the whole text brings the carried
    columns to the grouping.  Rows that are dealt out by a key are not dealt out again.
    """
    words = texts.select(*keys, *carried, F.explode(F.concat(words_of(F.col("text")), F.array(F.lit("")))).alias("word"))
    known = words.select(*keys, *carried, F.xxhash64("word").alias("term")).join(F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms, "term")
    brought = F.when(F.col("subset") == WHOLE, F.struct(F.lit(0).alias("none"), *carried)).alias("brought")
    known = known.select(*keys, "subset", "term", brought)
    each = known.groupBy(*keys, "subset").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.max("brought").alias("brought"))
    low = F.shiftright(F.shiftleft(F.xxhash64("terms", "subset"), 32), 32).cast("int")
    hashed = each.select(*keys, F.when(F.col("subset") != WHOLE, F.struct("subset", low.alias("hash"))).alias("own"), "brought")
    found = hashed.groupBy(*keys).agg(F.collect_list("own").alias("found"), F.max("brought").alias("brought"))
    return found.select(*keys, *[F.col("brought")[c].alias(c) for c in carried], by_subset(F.col("found")).alias("hashes"))


def by_subset(found: Column) -> Column:
    """One hash for each subset, null where it holds no term of the text."""
    known = F.map_from_entries(found)
    return F.transform(F.array(*[F.lit(k) for k in NUMBERS]), lambda s: F.try_element_at(known, s))


def fingerprint_of(hashes: Column, sha: Column) -> Column:
    """The subsets' hashes as text; sha is the digest of the text, for one without any."""
    parts = F.transform(hashes, lambda h: F.coalesce(F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8), F.lit("-")))
    return F.when(F.exists(hashes, lambda h: h.isNotNull()), F.array_join(parts, ".")).otherwise(F.concat(F.lit("text:"), sha))


def likeness(a: Column, a_print: Column, b: Column, b_print: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(a_print == b_print, 1.0).when(used > 0, same / used).otherwise(0.0)


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, n, next_id) from (doc_id, n): the next greater id, the least after the greatest.

    Ids are dealt by ranges; the least id of each range closes the one before it.
    """
    ranged = checkpointed(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))
    order = W.orderBy("part")
    least = F.min("head").over(W.partitionBy(F.lit(1)))
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), least).alias("after"))
    # Descending, so that the frame only grows and each row is added once.
    inside = W.partitionBy("part").orderBy(F.desc("doc_id")).rangeBetween(W.unboundedPreceding, -1)
    found = ranged.withColumn("following", F.min("doc_id").over(inside)).join(heads, "part")
    return found.select("doc_id", "n", F.coalesce("following", "after").alias("next_id"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """(key, text, n_chars, edited, next_key) of (doc_id, text), dealt out by key; where keys and ids differ, also doc_id, and copies: how many rows share id and text.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"))
    rows = document_keys(given)
    # Without a column that only one side needs, both sides of the join share one shuffle.
    own = [] if rows is given else [F.col("id").alias("doc_id"), "copies"]
    if own:
        rows = rows.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("id").alias("id"), F.count("*").alias("copies"))
    follow = checkpointed(next_ids(rows.select("doc_id", F.length("text").alias("n"))))
    dealt = rows.repartition("doc_id")
    asked = follow.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_key"), F.floor(F.col("n") / 4).cast("int").alias("quarter"))
    tails = dealt.join(asked.distinct(), "doc_id").select(F.col("for_key").alias("doc_id"), F.col("doc_id").alias("next_key"), F.substring("text", F.lit(1), F.col("quarter")).alias("tail"))
    joined = dealt.join(tails, "doc_id").withColumn("n_chars", F.length("text").cast("bigint"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    return joined.select(F.col("doc_id").alias("key"), *own, "text", "n_chars", F.concat(F.substring("text", F.lit(1), kept), "tail").alias("edited"), "next_key")


def with_next(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text), against `edited_texts` and the next document."""
    edited = edited_texts(docs)
    same = [c for c in edited.columns if c not in ("text", "edited")]
    texts = edited.select(*same, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    carried = (*[c for c in same if c != "key"], "sha")
    found = hashes_of(texts.withColumn("sha", F.unhex(F.sha2("text", 256))), terms, ["key", "which"], carried).withColumn("sha", F.lower(F.hex("sha")))
    of = lambda column, which: F.max(F.when(F.col("which") == which, F.col(column)))
    both = checkpointed(found.groupBy(*same).agg(of("sha", 0).alias("sha"), of("sha", 1).alias("edited_sha"), of("hashes", 0).alias("hashes"), of("hashes", 1).alias("edited_hashes")))
    following = both.select(F.col("key").alias("next_key"), F.col("hashes").alias("next_hashes"), F.col("sha").alias("next_sha"))
    out = both.join(following, "next_key")
    if "copies" in same:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    out = out.withColumns({f"{x}print": fingerprint_of(F.col(f"{x}hashes"), F.col(f"{x}sha")) for x in ("", "edited_", "next_")})
    return out.select(
        F.col("doc_id" if "doc_id" in same else "key").alias("doc_id"), "n_chars", F.col("edited_sha").alias("edited_sha256"), F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("print"), F.col("edited_hashes"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("print"), F.col("next_hashes"), F.col("next_print")).alias("near_next"),
    )


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, lexicon(docs))
