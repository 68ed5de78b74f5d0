"""A manifest of a dataset as a Merkle tree, with a proof for each row.

The leaves of a source, in the order of their ids, are collected into blocks of 16 ** 2 as
ordered arrays.  Inside a block, `sequence`, `transform`, `slice` and `aggregate` collapse
two levels at once; the roots of the blocks are the nodes of the next round, until each
source has one block.  The subroots of the sources are then the leaves of one more tree.
On the way back each block hands its members the siblings that lie above it.

Nothing is ordered in one task: rows are ordered by ranges, and a row's place in its source
is its place in its range plus the counts of the ranges before.

Defined cases: null fields count as `-`; a null source is a source of its own, the first;
null ids come last in their source, rows that share an id in the order of their leaves (equal
rows are interchangeable); a null id is never tampered with.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, table

#: A run has 2 ** BITS nodes; a block has as many leaves as fill DEPTH levels.
BITS, DEPTH = 4, 2
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a null, else bytes of the UTF-8 form, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of each row; tampered is the leaf of the changed row, null where none is changed.

    The tree of a source is named so that names sort as sources do, the null source first.
    """
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    whole = digest(*[field(F.col(c)) for c in FIELDS])
    changed = digest(*[field(lowered if c == "text" else F.col(c)) for c in FIELDS])
    return docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", whole.alias("leaf"), F.when(crc_mod("doc_id", 5) == 0, changed).alias("tampered"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds n, the number of rows of a tree, and place, that of each row in its tree from 0."""
    keys = [F.col("tree"), *order, F.monotonically_increasing_id()]
    ordered = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    runs = ordered.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy("tree")
    starts = runs.withColumns({"_start": F.sum("_n").over(own.orderBy("_range")) - F.col("_n"), "n": F.sum("_n").over(own)}).drop("_n")
    return ordered.join(starts, ["tree", "_range"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_start")).drop("_at", "_range", "_first", "_start")


def _run(level: Column) -> Column:
    """The next level: each run of nodes, the last one maybe shorter, as its digest."""
    last = F.shiftright(F.size(level) - 1, BITS)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(level, F.shiftleft(i, BITS) + 1, F.lit(1 << BITS)), ""), 256))


def collapsed(nodes: Column, lone: Column, depth: int) -> Column:
    """The levels of a block, its nodes first: `depth` more of them, fewer where a lone block comes to one node before."""
    top = lambda levels: F.element_at(levels, -1)
    up = lambda levels, _: F.when(lone & (F.size(top(levels)) == 1), levels).otherwise(F.concat(levels, F.array(_run(top(levels)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(nodes), up)


def siblings(levels: Column, place: Column) -> Column:
    """What stands before and after a node in its run, on each level of its block but the last."""

    def of(level: Column) -> Column:
        at, nodes = F.call_function("shiftright", place, level * BITS), F.element_at(levels, level + 1)
        start = F.shiftleft(F.shiftright(at, BITS), BITS)
        join = lambda first, n: F.array_join(F.slice(nodes, first + 1, n), "")
        return F.struct(join(start, at - start).alias("before"), join(at + 1, start + (1 << BITS) - 1 - at).alias("after"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), of)).otherwise(F.array().cast(PATH))


def blocks(rows: DataFrame, depth: int) -> DataFrame:
    """(tree, n, block, lone, own, levels): rows (tree, n, place, node, own) by blocks, of at most 2 ** (BITS * depth) rows each."""
    found = rows.groupBy("tree", "n", F.shiftright("place", BITS * depth).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "node", "own"))).alias("_rows"))
    lone = F.col("n") <= 1 << BITS * depth
    return found.select("tree", "n", "block", lone.alias("lone"), F.transform("_rows", lambda r: r["own"]).alias("own"), collapsed(F.transform("_rows", lambda r: r["node"]), lone, depth).alias("levels"))


def climbed(rows: DataFrame, depth: int) -> list[DataFrame]:
    """The blocks of each round, from rows (tree, n, place, node, own) up; a tree ends in the round in which its block is lone."""
    rounds = []
    while not rounds or not rounds[-1].where("not lone").isEmpty():
        rounds.append(checkpointed(blocks(rows, depth)))
        more = F.shiftright(F.col("n") - 1, BITS * depth) + 1
        roots = F.element_at(F.element_at("levels", -1), 1)
        rows = rounds[-1].where("not lone").select("tree", more.alias("n"), F.col("block").alias("place"), roots.alias("node"), F.lit(None).cast("string").alias("own"))
    return rounds


def ends(rounds: list[DataFrame]) -> DataFrame:
    """(tree, round, node): the root of each tree and the round that made it."""
    made = [b.where("lone").select("tree", F.lit(i).alias("round"), F.element_at(F.element_at("levels", -1), 1).alias("node")) for i, b in enumerate(rounds)]
    found = made[0]
    for m in made[1:]:
        found = found.unionByName(m)
    return found


def descended(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The blocks of the first round, each with the siblings above it and the other columns of tops (tree, round, path, ...) of its tree."""
    others = [c for c in tops.columns if c not in ("tree", "round", "path")]
    above = None
    for i in reversed(range(len(rounds))):
        upper = tops.where(F.col("round") == i).select("tree", F.lit(0).cast("bigint").alias("block"), "path", *others)
        joined = rounds[i].join(upper if above is None else upper.unionByName(above), ["tree", "block"])
        paths = F.transform(_places(), lambda j: F.concat(siblings(F.col("levels"), j), F.col("path")))
        first = F.shiftleft("block", BITS * depth)
        above = joined.select("tree", first.alias("_first"), *others, F.posexplode(paths).alias("_at", "path")).withColumn("block", F.col("_first") + F.col("_at")).drop("_first", "_at")
    return joined


def _places() -> Column:
    return F.sequence(F.lit(0), F.size("own") - 1)


def proof(path: Column, start: Column) -> Column:
    """(proof_sha256, folded_root): the digest of all siblings from leaf to root, and the root that they give for a leaf."""
    fold = lambda state, p: F.struct(digest(p["before"], state["node"], p["after"]).alias("node"), F.concat(state["said"], p["before"], p["after"]).alias("said"))
    made = lambda state: F.struct(F.sha2(state["said"], 256).alias("proof_sha256"), state["node"].alias("folded_root"))
    return F.aggregate(path, F.struct(start.alias("node"), F.lit("").alias("said")), fold, made)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; a row that was tampered with folds its changed leaf.

    Nodes are lowercase hex; `depth` levels are collapsed in a round and changes no result.
    """
    own = F.struct("doc_id", "leaf", "tampered")
    rows = placed(checkpointed(leaves(docs)), [F.col("doc_id").asc_nulls_last(), F.col("leaf")])
    sources = climbed(rows.select("tree", "n", "place", F.col("leaf").alias("node"), own.alias("own")), depth)

    named = ends(sources).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "round", "node")
    whole = climbed(placed(named, [F.col("name")]).select("tree", "n", "place", "node", F.struct("name", "round", "node").alias("own")), depth)
    root = ends(whole).select("tree", "round", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    top = lambda j: F.struct(F.get("own", j).alias("own"), F.concat(siblings(F.col("levels"), j), F.col("path")).alias("path"))
    tops = descended(whole, root, depth).select("root", F.explode(F.transform(_places(), top)).alias("t"))
    tops = tops.select(F.col("t.own.name").alias("tree"), F.col("t.own.round").alias("round"), F.col("t.path").alias("path"), F.col("t.own.node").alias("subroot"), "root")

    def of_leaf(j: Column) -> Column:
        one = F.get("own", j)
        path = F.concat(siblings(F.col("levels"), j), F.col("path"))
        return F.struct(one.alias("own"), proof(path, F.coalesce(one["tampered"], one["leaf"])).alias("proof"))

    found = descended(sources, tops, depth).select("subroot", "root", F.explode(F.transform(_places(), of_leaf)).alias("d"))
    folded = F.col("d.proof.folded_root")
    return found.select(F.col("d.own.doc_id").alias("doc_id"), F.col("d.own.leaf").alias("leaf"), "subroot", "root", F.col("d.proof.proof_sha256").alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
