"""Roll-ups: best rows, merged evidence, votes, pooled rates and pairwise clustering scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_duplicates(rows: DataFrame, keys: list[str], best: list[Column], keep: list[str], unions: dict[str, Column]) -> DataFrame:
    """One row per key: columns ``keep`` of the best row (ascending ``best``), and the sorted distinct union of others.

    Partial aggregation everywhere; ties of ``best`` are broken by ``keep``.
    """
    top = F.min(F.struct(*[b.alias(f"_{i}") for i, b in enumerate(best)], *keep)).alias("_top")
    merged = rows.groupBy(*keys).agg(top, F.count("*").alias("merged"), *[F.sort_array(F.collect_set(c)).alias(n) for n, c in unions.items()])
    return merged.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in keep], "merged", *unions)


def merged_bags(rows: DataFrame, keys: list[str], bag: str, order: str) -> DataFrame:
    """Property bags of a key merged name by name: the distinct values in order of first appearance."""
    flat = rows.select(*keys, F.col(order).alias("_o"), F.explode(bag).alias("name", "value"))
    first = flat.groupBy(*keys, "name", "value").agg(F.min("_o").alias("_o"))
    listed = first.groupBy(*keys, "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "value"))), lambda s: s["value"]).alias("values"))
    return listed


def zero_filled_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Histogram over a fixed domain; values that never occur are counted as zero, others are left out."""
    spark = rows.sparkSession
    base = spark.createDataFrame([(d,) for d in domain], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return base.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def pairwise_grouping(rows: DataFrame, scope: list[str], gold: str, predicted: str) -> DataFrame:
    """Pairwise precision and recall of a clustering per scope, without forming any pair.

    Pairs within a group of n are n(n-1)/2; pairs together in both clusterings come from the groups of their intersection.  Rows
    without a gold group are left out; rows without a predicted group pair with nothing.
    """
    known = rows.where(F.col(gold).isNotNull())
    pairs = lambda: F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")

    def total(by: list[str], name: str) -> DataFrame:
        usable = known.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
        return usable.groupBy(*scope, *by).agg(F.count("*").alias("n")).groupBy(*scope).agg(pairs().alias(name))

    out = total([gold], "gold_pairs").join(total([predicted], "predicted_pairs"), scope, "left").join(total([gold, predicted], "joint_pairs"), scope, "left")
    filled = out.select(*scope, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gold_pairs", "predicted_pairs", "joint_pairs")])
    return filled.select(
        "*",
        F.try_divide("joint_pairs", "predicted_pairs").alias("precision"),
        F.try_divide("joint_pairs", "gold_pairs").alias("recall"),
    )


def pooled_rates(rows: DataFrame, outer: str, inner: str, hit: str) -> DataFrame:
    """Numerator, denominator and rate per ``inner`` and pooled over each ``outer``: counts are pooled, never rates."""
    sets = rows.groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], outer, inner)
    return sets.agg(
        F.grouping(inner).cast("int").alias("pooled"), F.count_if(hit).alias("hits"), F.count("*").alias("total")
    ).select(outer, inner, "pooled", "hits", "total", F.try_divide("hits", "total").alias("rate"))


def majority(rows: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent non-null value per key; ties go to the smaller value."""
    counts = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col(vote).alias("v"))).alias("_m")).select(
        *keys, F.col("_m.v").alias(vote), (-F.col("_m.a")).alias("votes")
    )
