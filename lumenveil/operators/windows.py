"""Ranking, carrying and framing over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import short_id


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; ``order`` must be total.  The limit is the feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def enclosing_header(lines: DataFrame, keys: list[str], header: Column) -> DataFrame:
    """Each line with the nearest header at or before it: ``header_line`` and ``header`` (null before the first).

    One file is one window; files are bounded, so no group is.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    mark = F.when(header.isNotNull() & (header != ""), F.struct(F.col("line_no").alias("n"), header.alias("h")))
    last = F.last(mark, ignorenulls=True).over(w)
    return lines.select("*", last["n"].alias("header_line"), last["h"].alias("header"))


def context_counts(lines: DataFrame, keys: list[str], flag: Column, reach: int = 15) -> DataFrame:
    """How many lines within ``reach`` lines of each line carry the flag."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-reach, reach)
    return lines.withColumn("nearby", F.sum(flag.cast("int")).over(w))


def running_depth(lines: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    """Nesting depth after each line."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(delta).over(w))


def stable_ids(rows: DataFrame, prefix: str, key: Column, order: list[Column]) -> DataFrame:
    """Content-derived ids that do not depend on row order; rows with one key get ``_2``, ``_3`` in total order."""
    based = rows.withColumn("_base", short_id(prefix, key))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    return based.withColumn("stable_id", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", n.cast("string")))).drop("_base")
