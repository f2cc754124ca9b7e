"""Flows between typed components: roles from topology, rerouting through hubs, scoped filters, rewritten ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.graphs import insert_missing_edges


def typed_flows(flows: DataFrame, components: DataFrame, scope: list[str]) -> DataFrame:
    """``flows(scope, source, target, ...)`` with the type and subtype of both ends; flows with an unknown end drop out."""
    kinds = ("type", "sub_type")
    s = components.select(*scope, F.col("component").alias("source"), *[F.col(k).alias(f"source_{k}") for k in kinds])
    t = components.select(*scope, F.col("component").alias("target"), *[F.col(k).alias(f"target_{k}") for k in kinds])
    return flows.join(s, [*scope, "source"]).join(t, [*scope, "target"])


def roles_from_topology(flows: DataFrame, scope: list[str]) -> DataFrame:
    """What flows say about a component: ``receives`` from actors, ``hands_on`` to third parties, ``passes`` when it does both."""
    inbound = flows.where("source_type = 'actor'").select(*scope, F.col("target").alias("component"), F.lit(1).alias("received"), F.lit(0).alias("handed"))
    outbound = flows.where("target_type = 'third_party'").select(*scope, F.col("source").alias("component"), F.lit(0).alias("received"), F.lit(1).alias("handed"))
    sums = inbound.unionByName(outbound).groupBy(*scope, "component").agg(F.sum("received").alias("received"), F.sum("handed").alias("handed"))
    role = F.when((F.col("received") > 0) & (F.col("handed") > 0), "passes").when(F.col("received") > 0, "receives").otherwise("hands_on")
    return sums.withColumn("role", role)


def rewire_through_hub(flows: DataFrame, hubs: DataFrame, scope: list[str], bypass: Column) -> DataFrame:
    """Flows that bypass their scope's hub are led through it: the first half replaces the flow, the second is added where absent.

    ``flows(scope, source, target)`` and ``hubs(scope, hub)``, one hub per scope; scopes without a hub keep their flows.
    """
    joined = flows.join(hubs, scope, "left").withColumn("_by", F.coalesce(bypass & F.col("hub").isNotNull() & (F.col("source") != F.col("hub")) & (F.col("target") != F.col("hub")), F.lit(False)))
    kept = joined.where("NOT _by").select(*scope, "source", "target").dropDuplicates()
    first = joined.where("_by").select(*scope, "source", F.col("hub").alias("target"))
    second = joined.where("_by").select(*scope, F.col("hub").alias("source"), "target")
    return insert_missing_edges(kept, first.unionByName(second), [*scope, "source", "target"])


def rewrite_ends(flows: DataFrame, ids: DataFrame, scope: list[str]) -> DataFrame:
    """Both ends of every flow replaced through ``ids(scope, old, new)``; ends without an entry stay."""
    s = ids.select(*scope, F.col("old").alias("source"), F.col("new").alias("_s"))
    t = ids.select(*scope, F.col("old").alias("target"), F.col("new").alias("_t"))
    out = flows.join(s, [*scope, "source"], "left").join(t, [*scope, "target"], "left")
    return out.withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t")


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken check; a check that is null for a row does not hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(*key, F.explode(broken).alias("violation"))


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small report table as Markdown; the rows must be few, e.g. one per metric."""
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    for r in rows.select(columns).orderBy(*order).collect():
        lines.append("| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)
