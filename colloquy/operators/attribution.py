"""Attribution joins: sessions to invocations in time windows, and metadata by fallback keys.

Joins on time are equi-joins on buckets as wide as the window, each row of one
side put into the neighbouring buckets too, so no pair far apart is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bucket widths of spans: each twice the one before it, so the last takes spans of a year and more.
WIDTHS = 18


def unique_best(pairs: DataFrame, left: str, score: Column) -> DataFrame:
    """The pair of least score of each left row; a tie at the least score gives none."""
    best = pairs.withColumn("_score", score)
    least = best.groupBy(left).agg(F.min("_score").alias("_least"))
    tied = best.join(least, left).where(F.col("_score") == F.col("_least"))
    one = tied.groupBy(left).agg(F.count("*").alias("_n"), F.min(F.struct(*[c for c in pairs.columns if c != left])).alias("_pair")).where("_n = 1")
    return one.select(left, "_pair.*")


def near_in_time(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with equal keys whose times, in whole seconds, are at most `seconds` apart, with their distance."""
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(left_time) / seconds) + d)))
    b = right.withColumn("_bucket", F.floor(F.col(right_time) / seconds))
    pairs = a.join(b, [*on, "_bucket"]).drop("_bucket").withColumn("distance", F.abs(F.col(left_time) - F.col(right_time)))
    return pairs.where(F.col("distance") <= seconds)


def within_span(points: DataFrame, spans: DataFrame, on: list[str], time: str, start: str, end: str, slack: int, bucket: int = 600) -> DataFrame:
    """Pairs with equal keys where the time lies in the span, widened by `slack` seconds on either side."""
    # A span goes into the two or three buckets of the least width that is not under its own length, a point into one of each width in use.
    width = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start) + 2 * slack + 1) / F.lit(float(bucket))))).cast("int")
    spans = spans.withColumn("_width", F.least(width, F.lit(WIDTHS - 1)))
    step = F.lit(bucket) * F.pow(F.lit(2.0), F.col("_width")).cast("bigint")
    low, high = F.floor((F.col(start) - slack) / step), F.floor((F.col(end) + slack) / step)
    a = spans.where(F.col(end) >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(low, high)))
    used = sorted(r._width for r in spans.select("_width").distinct().collect() if r._width is not None)
    b = points.withColumn("_width", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")))
    b = b.withColumn("_bucket", F.floor(F.col(time) / (F.lit(bucket) * F.pow(F.lit(2.0), F.col("_width")).cast("bigint"))))
    pairs = b.join(a, [*on, "_width", "_bucket"]).drop("_width", "_bucket")
    return pairs.where((F.col(time) >= F.col(start) - slack) & (F.col(time) <= F.col(end) + slack))


def attributed(points: DataFrame, spans: DataFrame, on: list[str], left: str, time: str, start: str, end: str, slack: int = 120) -> DataFrame:
    """The one span of each point that fits best: one that contains it first, then the one with the nearest start."""
    pairs = within_span(points, spans, on, time, start, end, slack)
    outside = (~F.col(time).between(F.col(start), F.col(end))).cast("bigint")
    return unique_best(pairs, left, F.struct(outside, F.abs(F.col(time) - F.col(start))))


def by_fallback_keys(rows: DataFrame, facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds value: of the first key of the row that names exactly one value among the facts."""
    found = rows
    for i, key in enumerate(keys):
        unique = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_value{i}"), F.max(value).alias("_other")).where(F.col(f"_value{i}") == F.col("_other")).drop("_other")
        found = found.join(unique, key, "left")
    return found.withColumn(value, F.coalesce(*[f"_value{i}" for i in range(len(keys))])).drop(*[f"_value{i}" for i in range(len(keys))])


def overlapping_prompts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): pairs of (id, prompts) whose right side holds every prompt of the left one.

    Distinct prompts meet as rows, so only pairs that share one are formed.
    """
    a = left.select(F.col("id").alias("left_id"), F.array_distinct("prompts").alias("own")).where(F.size("own") > 0).select("left_id", F.size("own").alias("many"), F.explode("own").alias("prompt"))
    b = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct("prompts")).alias("prompt"))
    shared = a.join(b, "prompt").groupBy("left_id", "right_id", "many").agg(F.count("*").alias("shared"))
    return shared.where("shared = many").select("left_id", "right_id", "shared")


def in_header_order(headers: DataFrame, bodies: DataFrame, on: list[str], order: str) -> DataFrame:
    """Headers with what their bodies hold, missing bodies too, and position: the number of the header among those of its first key that have a body."""
    found = headers.join(bodies.withColumn("_has", F.lit(1)), on, "left")
    before = W.partitionBy(on[0]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("position", F.when(F.col("_has") == 1, F.count("_has").over(before))).drop("_has")


def without_rows(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of metadata that no conversation covers; rows with a null key stay."""
    return rows.join(known.select(*on).distinct(), on, "left_anti")
