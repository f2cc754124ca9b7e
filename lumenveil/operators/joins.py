"""Joins beyond equality, each brought back to equi-joins on bounded blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenveil.workspace import Workspace


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(left, right)])


def hot_keys(rows: DataFrame, keys: list[str], ws: Workspace, least: int = 200_000, most: int = 100_000) -> DataFrame | None:
    """Keys of more than ``least`` rows, at most the ``most`` hottest of them; None if there is no such key."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    found = ws.put(found.orderBy(F.desc("_n")).limit(most).select(*keys))
    return None if found.isEmpty() else found


def spread(rows: DataFrame, lookup: DataFrame, keys: list[str], by: list[str], hot: DataFrame | None, copies: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(rows, lookup, join keys)`` with the rows of each hot key spread over ``copies`` parts and its lookup rows repeated in each.

    The join's result is the same, without the column ``_salt``; ``by`` are columns of ``rows`` that tell rows of one key apart.  Only the hot
    keys are broadcast, whose number ``hot_keys`` bounds.
    """
    if hot is None:
        return rows, lookup, keys
    marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(copies))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marks, keys, "left").withColumn("_salt", part).drop("_hot")
    right = lookup.join(marks, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left, right, [*keys, "_salt"]


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 256
) -> DataFrame:
    """Pairs of rows of one key whose closed integer spans overlap; right columns must not clash with left ones.

    Spans are cut into blocks of ``width`` positions and joined on (key, block), so a hot key is spread over its
    blocks.  A pair that shares several blocks is reported in the first of them only.  Null spans and null keys match nothing.
    """

    def blocks(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        lo, hi = F.col(span[0]).cast("long"), F.col(span[1]).cast("long")
        usable = df.where(lo.isNotNull() & (hi >= lo))
        return usable.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))

    a = blocks(left, left_span, "_block")
    b = blocks(right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]), right_span, "_rblock")
    on = _same([F.col(k) for k in keys], [F.col(f"_r_{k}") for k in keys]) & (F.col("_block") == F.col("_rblock"))
    on = on & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    first = F.greatest(F.floor(F.col(left_span[0]) / width), F.floor(F.col(right_span[0]) / width))
    return a.join(b, on).where(F.col("_block") == first).drop("_block", "_rblock", *[f"_r_{k}" for k in keys])


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], block: int = 86_400_000_000
) -> DataFrame:
    """Every left row with the columns ``take`` of the last right row of its key at or before it (null if none).

    Both sides are put on one line; inside blocks of ``block`` units a window carries the last right row forward, and the last row of
    each block is carried to later blocks over one summary row per block, so no task sees a whole hot key.
    Of right rows at one instant the greatest by ``take`` counts.  A null key or time on the left matches nothing.
    """
    fields = F.struct(F.col(right_at).cast("long").alias("_at"), *take)
    r = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).cast("long").alias("_at")).agg(F.max(fields).alias("_right"))
    l = left.select("*", F.col(left_at).cast("long").alias("_at"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"))  # noqa: E741
    both = l.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("_at") / F.lit(block)).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at", "_left")
    near = both.withColumn("_near", F.last("_right", ignorenulls=True).over(inside))
    tops = r.groupBy(*keys, F.floor(F.col("_at") / F.lit(block)).cast("long").alias("_b")).agg(F.max("_right").alias("_top"))
    # every block of either side, so that blocks without right rows inherit too
    marks = l.select(*keys, F.floor(F.col("_at") / F.lit(block)).cast("long").alias("_b")).dropDuplicates()
    known = marks.join(tops, [*keys, "_b"], "full")
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select(*keys, "_b", F.last("_top", ignorenulls=True).over(earlier).alias("_carried"))
    found = near.where("_left").join(carried, [*keys, "_b"], "left").withColumn("_got", F.coalesce("_near", "_carried"))
    return found.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in take])


def longest_prefix_join(files: DataFrame, sections: DataFrame, keys: list[str], path: str, directory: str, take: str) -> DataFrame:
    """Each file with ``take`` of the section whose directory is its nearest ancestor; null without one.

    A path is exploded into its ancestors (bounded by its depth) and joined on equality; ``""`` is the root.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = files.select(*keys, path, F.explode(ancestors).alias("_dir")).dropDuplicates()
    s = sections.select(*keys, F.col(directory).alias("_dir"), take).dropDuplicates()
    best = steps.join(s, [*keys, "_dir"]).groupBy(*keys, path).agg(F.max(F.struct(F.length("_dir").alias("n"), F.col(take).alias("v"))).alias("_best"))
    return files.join(best, [*keys, path], "left").select(*files.columns, F.col("_best.v").alias(take))


def nearest_span_join(hits: DataFrame, spans: DataFrame, keys: list[str], line: str, span: tuple[str, str], take: str) -> DataFrame:
    """Each hit with ``take`` of the span of its key that covers its line, else of the nearest one; null without any.

    Equally near spans are told apart by the shorter, then the smaller ``take``.  ``spans`` has few rows per key (the components of one
    file); keys with many hits stay spread because hits are never grouped by key.
    """
    lo, hi = span
    per = spans.groupBy(*keys).agg(F.collect_set(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(take).alias("v"))).alias("_spans"))

    def distance(s: Column) -> Column:
        at = F.col(line)
        return F.when(at < s["lo"], s["lo"] - at).when(at > s["hi"], at - s["hi"]).otherwise(0)

    ranked = F.array_min(F.transform("_spans", lambda s: F.struct(distance(s).alias("d"), (s["hi"] - s["lo"]).alias("w"), s["v"].alias("v"))))
    return hits.join(per, keys, "left").select(*hits.columns, ranked["v"].alias(take), ranked["d"].alias("distance"))


def first_match_join(rows: DataFrame, rules: DataFrame, matches: Column, order: str, take: list[str], key: list[str], block: int = 10_000) -> DataFrame:
    """Each row with ``take`` of the first rule by ``order`` that matches, null without one.

    Rules are broadcast in blocks of at most ``block``; a larger catalog is run block by block, and the first match over all blocks counts.
    """
    ws = Workspace(rows.sparkSession, "rules")
    numbered = ws.put(rules.withColumn("_block", F.pmod(F.xxhash64(*rules.columns), F.lit(-(-rules.count() // block) or 1))))
    sizes = numbered.groupBy("_block").count().agg(F.max("_block"), F.max("count")).first()
    if (sizes[1] or 0) > 4 * block:
        raise ValueError("rules repeat: more than four blocks of equal rows")
    found: DataFrame | None = None
    for k in range((sizes[0] or 0) + 1):
        part = rows.join(F.broadcast(numbered.where(F.col("_block") == k).drop("_block")), matches).groupBy(*key).agg(F.min(F.struct(order, *take)).alias("_first"))
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(*key).agg(F.min("_first").alias("_first"))
    return rows.join(found, key, "left").select(*rows.columns, *[F.col(f"_first.{c}").alias(c) for c in take])
