"""Scoring findings against gold rows: unambiguous assignment, recall, scoped precision, computability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unambiguous_pairs(candidates: DataFrame, gold: str, finding: str) -> DataFrame:
    """Pairs whose gold row and finding each have exactly one partner; a duplicate on either side matches nothing."""
    pairs = candidates.select(gold, finding).dropDuplicates()
    g = Window.partitionBy(gold)
    f = Window.partitionBy(finding)
    counted = pairs.withColumn("_g", F.count("*").over(g)).withColumn("_f", F.count("*").over(f))
    return counted.where("_g = 1 AND _f = 1").select(gold, finding)


def strongest_pairs(candidates: DataFrame, gold: str, finding: str, strength: str) -> DataFrame:
    """Gold rows with several findings are blocked; of the rest each finding goes to its strongest gold row (smaller id on ties)."""
    pairs = candidates.groupBy(gold, finding).agg(F.max(strength).alias(strength))
    single = pairs.withColumn("_g", F.count("*").over(Window.partitionBy(gold))).where("_g = 1")
    best = single.withColumn("_r", F.row_number().over(Window.partitionBy(finding).orderBy(F.desc(strength), gold)))
    return best.where("_r = 1").select(gold, finding, strength)


def scores(gold: DataFrame, findings: DataFrame, pairs: DataFrame, scope: list[str], gold_id: str, finding_id: str, in_scope: Column) -> DataFrame:
    """Per scope: gold, matched, recall, findings in the exhaustive scope, precision and whether each is computable.

    A rate with an empty denominator is null and its state says why, never 0 or 1.
    """
    hit = gold.join(pairs.select(gold_id, F.lit(True).alias("_hit")), gold_id, "left")
    recall = hit.groupBy(*scope).agg(F.count("*").alias("gold"), F.count_if("_hit").alias("matched"))
    shown = findings.join(pairs.select(finding_id, F.lit(True).alias("_hit")), finding_id, "left").where(in_scope)
    precision = shown.groupBy(*scope).agg(F.count("*").alias("scoped"), F.count_if("_hit").alias("scoped_matched"))
    both = recall.join(precision, scope, "full").select(*scope, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gold", "matched", "scoped", "scoped_matched")])
    return both.select(
        "*",
        F.try_divide("matched", "gold").alias("recall"),
        F.try_divide("scoped_matched", "scoped").alias("precision"),
        F.when(F.col("gold") == 0, "no_gold").otherwise("computable").alias("recall_state"),
        F.when(F.col("scoped") == 0, "no_findings_in_scope").otherwise("computable").alias("precision_state"),
    )
