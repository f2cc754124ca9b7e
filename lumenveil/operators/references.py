"""References to records that are missing, deleted, or arrive later.

References are grouped by null mask: each subset of non-null key columns is anti-joined on just
those columns, under the declared match semantics of composite foreign keys (simple, partial,
full).  Liveness at the time of the reference is decided against the target's merged live periods.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.intervals import merge_intervals
from lumenveil.operators.joins import hot_keys, spread
from lumenveil.workspace import Workspace

DAY_US = 86_400_000_000


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[str],
    required: list[str],
    at: str,
    live_from: str,
    live_to: str,
    match: str = "simple",
) -> DataFrame:
    """References without a live target at their time, with the reason ``why``.

    ``refs`` has the columns ``keys`` and ``at`` (BIGINT microseconds) besides its own; ``targets`` has ``keys``,
    ``live_from`` and ``live_to`` (BIGINT, null end: still live).  ``required`` names the key columns without
    which a row refers to nothing.

    Match semantics for rows with other key columns null: ``simple`` - the reference counts as satisfied;
    ``partial`` - it is matched on its non-null columns; ``full`` - it is an orphan, ``why = 'incomplete'``.

    ``why``: ``missing`` (no row of that key), ``late`` (all its rows begin after ``at``), else ``deleted``.
    A reference without a time is only checked for ``missing``; a target without a beginning counts as always there.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    # the caller's columns travel in one struct, so none of their names can clash with the operator's
    own = [c for c in refs.columns if c.lower() != "why"]
    inner = {c: f"k{i}" for i, c in enumerate(keys)}
    some = refs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{at}`").cast("long").alias("at"), *[F.col(f"`{c}`").alias(k) for c, k in inner.items()]
    ).where(reduce(lambda a, b: a & b, [F.col(inner[c]).isNotNull() for c in required]))
    known = targets.select(
        *[F.col(f"`{c}`").alias(k) for c, k in inner.items()],
        F.coalesce(F.col(f"`{live_from}`").cast("long"), F.lit(-(1 << 62))).alias("lf"),
        F.col(f"`{live_to}`").cast("long").alias("lt"),
    )
    ws = Workspace(refs.sparkSession, "references")
    optional = [inner[c] for c in keys if c not in required]
    needed = [inner[c] for c in required]
    out: list[DataFrame] = []
    for mask in product([True, False], repeat=len(optional)):
        on = needed + [c for c, present in zip(optional, mask) if present]
        rows = some
        for c, present in zip(optional, mask):
            rows = rows.where(F.col(c).isNotNull() if present else F.col(c).isNull())
        if len(on) < len(keys):
            if match == "simple" or rows.isEmpty():
                continue
            if match == "full":
                out.append(rows.select("row", F.lit("incomplete").alias("why")))
                continue
        out.append(_orphans_of_mask(rows, known, on, ws))
    return reduce(DataFrame.unionByName, out).select(*[F.col("row").getField(c).alias(c) for c in own], "why")


def _orphans_of_mask(rows: DataFrame, targets: DataFrame, on: list[str], ws: Workspace) -> DataFrame:
    t = targets.select(*on, "lf", "lt").where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    # one row per key, so a hot key on the reference side never multiplies
    known = ws.put(t.groupBy(*on).agg(F.min("lf").alias("first"), F.min(F.when(F.col("lt").isNull(), F.col("lf"))).alias("open")))
    # references to a hot key are spread over several tasks
    hot = hot_keys(rows, on, ws)
    r, k, keys = spread(rows, known, on, ["at"], hot)
    missing = r.join(k.select(*keys), keys, "left_anti").select("row", F.lit("missing").alias("why"))
    found = r.where("at IS NOT NULL").join(k, keys).select("row", "at", "first", "open", *on)
    doubtful = found.where(F.col("open").isNull() | (F.col("at") < F.col("open")))
    closed = ws.put(merge_intervals(t.where("lt IS NOT NULL").withColumn("last", F.col("lt") - 1), on, "lf", "last", block=DAY_US))
    d, c, keys = spread(doubtful, closed.select(*on, "from_pos", "to_pos"), on, ["at"], hot)
    c = c.select(*[F.col(x).alias(f"t_{x}") for x in keys], "from_pos", "to_pos")
    alive = reduce(lambda a, b: a & b, [F.col(x) == F.col(f"t_{x}") for x in keys])
    alive = alive & (F.col("at") >= F.col("from_pos")) & (F.col("at") <= F.col("to_pos"))
    dead = d.join(c, alive, "left_anti")
    why = F.when(F.col("first") > F.col("at"), F.lit("late")).otherwise(F.lit("deleted"))
    return missing.unionByName(dead.select("row", why.alias("why")))
