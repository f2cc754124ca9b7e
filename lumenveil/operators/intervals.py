"""Overlapping, nested and gapped intervals: continuous stretches and what lies between.

Sorting by start and comparing with the running maximum of earlier ends is a window
per entity, which one hot entity would turn into one huge task.  The window is therefore
run in two levels: inside blocks of ``block`` positions, then over one summary row per
block, whose prefix maxima are joined back.  No task sees more than one block of an entity
plus the entity's block summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenveil.workspace import Workspace


def merge_intervals(
    spans: DataFrame, keys: list[str], lo: str, hi: str, block: int = 1024
) -> DataFrame:
    """Longest covered stretches per entity.

    Closed integer intervals ``[lo, hi]``.  Stretches that touch (``hi + 1 == lo``) are one.
    Returns ``keys, from_pos, to_pos, prev_to``; ``prev_to`` is where the entity's
    previous stretch ends (null for its first), so gaps need no further sort.

    Defined cases: rows with a null bound, or ``hi < lo``, do not count; a null key is a key of its
    own; repeated rows change nothing; an empty input gives an empty result; other columns are ignored.
    """
    # one struct as key: equal structs have equal fields, nulls included, so joins on it need no null-safe
    # comparison and keep the partitioning of the windows before them
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    base = spans.select(key.alias("_k"), F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"))
    base = base.where("_lo IS NOT NULL AND _hi >= _lo").withColumn("_b", F.floor(F.col("_lo") / F.lit(block)).cast("long"))
    # one row per start: repeated and nested spans of a hot entity fold before the shuffle
    starts = base.groupBy("_k", "_b", "_lo").agg(F.max("_hi").alias("_hi"))

    inside = Window.partitionBy("_k", "_b").orderBy("_lo")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = starts.withColumn("_before", F.max("_hi").over(before))
    opens = F.col("_before").isNull() | (F.col("_lo") > F.col("_before") + 1)
    local = (
        seen.withColumn("_island", F.max(F.when(opens, F.col("_lo"))).over(inside))
        .groupBy("_k", "_b", "_island")
        .agg(F.max("_hi").alias("_hi"), F.min_by("_before", "_lo").alias("_before"))
    )

    # read twice below: written once, or the spans would be read and shuffled twice
    local = Workspace(spans.sparkSession, "intervals").put(local)
    blocks = local.groupBy("_k", "_b").agg(F.max("_hi").alias("_top"), F.max("_island").alias("_last"))
    over = Window.partitionBy("_k").orderBy("_b")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carry", F.max("_top").over(earlier))
    still_open = F.col("_carry").isNull() | (F.col("_last") > F.col("_carry") + 1)
    carried = blocks.select("_k", "_b", "_carry", F.max(F.when(still_open, F.col("_last"))).over(earlier).alias("_from"))

    new = F.col("_carry").isNull() | (F.col("_island") > F.col("_carry") + 1)
    return (
        local.join(carried, ["_k", "_b"])
        .select(
            "_k",
            F.when(new, F.col("_island")).otherwise(F.col("_from")).alias("_start"),
            "_hi",
            F.when(new, F.greatest("_carry", "_before")).alias("_prev"),
        )
        .groupBy("_k", "_start")
        .agg(F.max("_hi").alias("_end"), F.max("_prev").alias("_prev"))
        .select(
            *[F.col("_k").getField(f"k{i}").alias(c) for i, c in enumerate(keys)],
            F.col("_start").alias("from_pos"),
            F.col("_end").alias("to_pos"),
            F.col("_prev").alias("prev_to"),
        )
    )


def cover_and_gaps(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of :func:`merge_intervals` and the gaps between neighbours as ``piece`` rows."""
    covered = F.struct(F.lit("covered").alias("piece"), F.col("from_pos"), F.col("to_pos"))
    gap = F.struct(
        F.lit("gap").alias("piece"),
        (F.col("prev_to") + 1).alias("from_pos"),
        (F.col("from_pos") - 1).alias("to_pos"),
    )
    pieces = F.when(F.col("prev_to").isNull(), F.array(covered)).otherwise(F.array(covered, gap))
    return merged.select(*keys, F.inline(pieces))
