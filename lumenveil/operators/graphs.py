"""Property graphs: edges, degrees, inserted edges and breadth-first distances."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.workspace import Workspace


def degrees(links: DataFrame, scope: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """In- and out-degree of every node that has a link; parallel links count once."""
    edges = links.select(*scope, F.col(source).alias("_s"), F.col(target).alias("_t")).dropDuplicates()
    ends = F.inline(F.array(F.struct(F.col("_s").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("_t").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    return edges.select(*scope, ends).groupBy(*scope, "node").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def insert_missing_edges(edges: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with those of ``wanted`` whose key is not there yet; ``synthetic`` tells them apart."""
    absent = wanted.join(edges.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return edges.withColumn("synthetic", F.lit(False)).unionByName(absent.withColumn("synthetic", F.lit(True)))


def distances(edges: DataFrame, starts: DataFrame, scope: list[str]) -> DataFrame:
    """Fewest edges from any start to each node reachable in its scope (directed), however far away.

    Every round is one equi-join of the frontier with the edges and one anti-join against what is known; rounds are written out, so a
    lost executor costs one round.  Every 32 rounds what is known becomes one table, so plans stay short on long chains.
    """
    ws = Workspace(edges.sparkSession, "bfs")
    steps = ws.put(edges.select(*scope, F.col("source").alias("_s"), F.col("target").alias("_t")).where("_s IS NOT NULL AND _t IS NOT NULL").dropDuplicates())
    known = frontier = ws.put(starts.select(*scope, F.col("node").alias("_n"), F.lit(0).alias("distance")).dropDuplicates())
    for d in count(1):
        reached = frontier.join(steps.withColumnRenamed("_s", "_n"), [*scope, "_n"]).select(*scope, F.col("_t").alias("_n")).dropDuplicates()
        frontier = ws.put(reached.join(known.select(*scope, "_n"), [*scope, "_n"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if d % 32 == 0:
            known = ws.put(known)
    return known.select(*scope, F.col("_n").alias("node"), "distance")


def node_link_document(nodes: DataFrame, links: DataFrame, scope: str) -> DataFrame:
    """Node-link JSON lines, one object per node and link, so the document of a huge graph is never one value."""
    n = nodes.select(scope, F.lit("node").alias("kind"), F.to_json(F.struct(*[c for c in nodes.columns if c != scope]), {"ignoreNullFields": "true"}).alias("json"))
    e = links.select(scope, F.lit("link").alias("kind"), F.to_json(F.struct(*[c for c in links.columns if c != scope]), {"ignoreNullFields": "true"}).alias("json"))
    return n.unionByName(e)
