"""Histories of changing attributes by tree reduction.

Every observation is a unit interval.  Observations are put in order of (entity, time) by range
partitioning, which splits a hot entity over many partitions, and get a position.  Each round
groups ``fan`` neighbouring blocks of positions, merges neighbouring runs of equal payload, and sends only
the first and last run of a block upwards; runs between them are final.  The rounds are
logarithmic in the number of observations and their tables shrink by about ``fan`` each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenveil.workspace import Workspace

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (ties by the row itself), with partial aggregation.

    Null sorts first in ``order``.  Null keys form one group.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order + [c for c in rest if c not in order]])
    best = rows.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def periods(
    observations: DataFrame,
    entity: str,
    at: str,
    payload: str,
    fan_bits: int = 7,
) -> DataFrame:
    """Periods ``(entity, payload, valid_from, valid_to)`` in which an entity held one payload.

    ``observations`` has at most one row per (entity, at); ``at`` is BIGINT.  An observation equal to the
    payload in force starts no period.  ``valid_to`` is the next period's start, null for the last.
    Null entities or times are ignored; a null payload is a value of its own; an empty table gives no rows.
    """
    spark = observations.sparkSession
    ws = Workspace(spark, "history")
    base = observations.select(
        F.col(entity).alias("_e"), F.col(at).cast("long").alias("_from"), F.col(payload).alias("_p")
    ).where("_e IS NOT NULL AND _from IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(parts, "_e", "_from").sortWithinPartitions("_e", "_from")
    units = ws.put(
        ordered.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_to", F.lit(None).cast("long"))
    )
    row_bits = units.agg(F.max(F.col("_pos").bitwiseAND((1 << _POSITION_BITS) - 1))).first()[0]
    if row_bits is None:
        return units.select(F.col("_e").alias(entity), F.col("_p").alias(payload), F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"))
    shifts = list(range(fan_bits, row_bits.bit_length() + fan_bits, fan_bits))
    shifts = [min(s, _POSITION_BITS) for s in shifts if s < _POSITION_BITS + fan_bits]
    above = (parts - 1).bit_length()
    shifts += [_POSITION_BITS + s for s in range(fan_bits, above, fan_bits)] + [63]
    done: list[DataFrame] = []
    open_runs, seen = units, set()
    for shift in shifts:
        if shift in seen:
            continue
        seen.add(shift)
        last = shift == 63
        merged = _merge_round(open_runs, shift)
        closed = F.lit(True) if last else ~(F.col("_first") | F.col("_last"))
        merged = ws.put(merged.withColumn("_closed", closed))
        done.append(merged.where("_closed"))
        open_runs = merged.where("NOT _closed").select("_e", "_from", "_p", "_pos", "_to")
    ws.drop(units)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select(
        F.col("_e").alias(entity), F.col("_p").alias(payload), F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to")
    )


def _merge_round(runs: DataFrame, shift: int) -> DataFrame:
    """Merge neighbouring runs of equal payload inside blocks of ``2**shift`` positions."""
    block = F.lit(0).cast("long") if shift == 63 else F.shiftright("_pos", shift)
    rows = runs.withColumn("_b", block)
    w = Window.partitionBy("_e", "_b").orderBy("_pos")
    # a run whose end is known has its right neighbour in the finished table: nothing here continues it
    starts = F.lag("_pos").over(w).isNull() | F.lag("_to").over(w).isNotNull() | ~F.lag("_p").over(w).eqNullSafe(F.col("_p"))
    rows = rows.withColumn("_new", starts.cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    merged = rows.groupBy("_e", "_b", "_run").agg(
        F.min("_from").alias("_from"),
        F.min_by("_p", "_pos").alias("_p"),
        F.min("_pos").alias("_pos"),
        F.max_by("_to", "_pos").alias("_to"),
    )
    w2 = Window.partitionBy("_e", "_b").orderBy("_run")
    following = F.lead("_from").over(w2)
    return merged.select(
        "_e",
        "_from",
        "_p",
        "_pos",
        F.coalesce(F.col("_to"), following).alias("_to"),
        F.lag("_run").over(w2).isNull().alias("_first"),
        following.isNull().alias("_last"),
    )
