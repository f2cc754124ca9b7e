"""Groups of linked records by randomised graph contraction.

Each round every vertex hooks to the member of its closed neighbourhood that comes first under a
fresh hash order, edges are relabelled, deduplicated and loops dropped.  The expected number of
vertices with edges shrinks by a constant factor per round, so rounds are logarithmic.  The mappings of the
rounds are expanded backwards at the end.  A hot key never becomes a group in one task: it enters as a
star around its smallest member, which needs only a partial minimum and an equi-join that spreads the rows of hot keys; edges of hot vertices
are spread alike when they are relabelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.joins import hot_keys, spread
from lumenveil.workspace import Workspace

HOT = 200_000  # members of a key, or edges of a vertex, that one task may take


def star_edges(memberships: DataFrame, member: str, keys: list[str], ws: Workspace | None = None, hot: int = HOT) -> DataFrame:
    """Edges ``(a, b)`` from every member of a key to the key's smallest member.

    Members sharing a key end up connected with one edge each instead of all pairs.  Null keys must be
    filtered before; a key with one member gives no edge; repeated rows give one edge.
    """
    ws = ws or Workspace(memberships.sparkSession, "stars")
    # written once: the keys cost more to work out than to read
    rows = ws.put(memberships.select(F.col(member).alias("a"), *keys))
    sizes = ws.put(rows.groupBy(*keys).agg(F.min("a").alias("b"), F.max("a").alias("_top"), F.count("*").alias("_n")).where("b <> _top"))
    # repeated memberships are left to the last step: they are few, and edges are narrower than keys
    crowded = sizes.where(F.col("_n") > hot).select(*keys)
    left, right, on = spread(rows, sizes.select(*keys, "b"), keys, ["a"], None if crowded.isEmpty() else crowded)
    return left.join(right, on).where("a <> b").select("a", "b").dropDuplicates()


def contract(edges: DataFrame, ws: Workspace, max_rounds: int = 200, hot: int = HOT) -> DataFrame:
    """``(member, root)`` for every vertex of ``edges(a, b)``; vertices of one component share a root."""
    current = ws.put(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").dropDuplicates())
    mappings: list[DataFrame] = []
    for number in range(max_rounds):
        mapping = ws.put(_hook(current, number))
        most = mapping.agg(F.max("n")).first()[0]
        if most is None:
            break
        mappings.append(mapping)
        # at most twice the edges over ``hot`` vertices are hot
        crowded = mapping.where(F.col("n") > hot).select("v") if most > hot else None
        moved = current
        for end, to in (("a", "ra"), ("b", "rb")):
            left, right, on = spread(
                moved, mapping.select(F.col("v").alias(end), F.col("r").alias(to)), [end], ["a" if end == "b" else "b"], None if crowded is None else crowded.select(F.col("v").alias(end))
            )
            moved = left.join(right, on).drop("_salt")
        moved = moved.where("ra <> rb")
        # undirected: one orientation is enough
        relabelled = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        following = ws.put(relabelled.dropDuplicates())
        ws.drop(current)
        current = following
    else:
        raise RuntimeError("contraction did not end")
    if not mappings:
        return current.select(F.col("a").alias("member"), F.col("b").alias("root"))
    # expand backwards: what the last rounds decided is pushed down to the first round's vertices
    expanded = mappings[-1]
    for earlier in reversed(mappings[:-1]):
        later = expanded.select(F.col("v").alias("r"), F.col("r").alias("_root"))
        expanded = ws.put(
            earlier.join(later, "r", "left").select("v", F.coalesce("_root", "r").alias("r"))
        )
    return expanded.select(F.col("v").alias("member"), F.col("r").alias("root"))


def _hook(edges: DataFrame, number: int) -> DataFrame:
    """Each vertex with the first of itself and its neighbours in the hash order of this round, and how many neighbours it has."""
    both = F.inline(
        F.array(
            F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
            F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
        )
    )

    def order(c: str):
        return F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("w"))

    neighbours = edges.select(both).groupBy("v").agg(F.min(order("w")).alias("_n"), F.count("*").alias("n"))
    return neighbours.select("v", F.least("_n", order("v"))["w"].alias("r"), "n")


def linked_groups(edges: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``(group_id, member)`` for every member linked to another; the id is the group's smallest member.

    Defined cases: null ends, loops and repeated edges are ignored; an empty table gives no rows.
    """
    ws = ws or Workspace(edges.sparkSession, "groups")
    roots = contract(edges, ws)
    smallest = roots.groupBy("root").agg(F.min("member").alias("group_id"))
    return roots.join(smallest, "root").select("group_id", "member")
