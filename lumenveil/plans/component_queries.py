"""Queries over components and the flows between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import short_id
from lumenveil.functions.text import loose_id
from lumenveil.operators.graphs import degrees
from lumenveil.operators.history import latest
from lumenveil.operators.intervals import merge_intervals
from lumenveil.operators.topology import rewire_through_hub, rewrite_ends, roles_from_topology, typed_flows, violations
from lumenveil.operators.windows import top_per_group
from lumenveil.plans.code_queries import SECTIONS, file_sections
from lumenveil.plans.relation_queries import HITS_SQL, LINKS_SQL, hits, links
from lumenveil.tables import table


def components(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "components").select("scan_id", loose_id(F.col("component_id")).alias("component"), "name", "type", "sub_type", "confidence", "loaded_at")
    return latest(rows, ["scan_id", "component"], ["loaded_at"]).drop("loaded_at")


COMPONENTS_SQL = """
components_1 AS (
  SELECT scan_id, lower(trim(component_id)) AS component, name, type, sub_type, confidence FROM components
  QUALIFY row_number() OVER (PARTITION BY scan_id, lower(trim(component_id)) ORDER BY loaded_at DESC) = 1)"""


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct flows between components: what the topology of their data actions names, and links between component nodes."""
    actions = table(spark, folder, "components").select("scan_id", loose_id(F.col("component_id")).alias("source"), F.explode("data_actions").alias("a"))
    named = actions.select("scan_id", "source", loose_id(F.col("a.topology.related_component_id")).alias("target")).where("target IS NOT NULL")
    e = links(spark, folder).where("startswith(source, 'dp::cmp_') AND startswith(target, 'dp::cmp_')")
    linked = e.select("scan_id", F.expr("substring(source, 5)").alias("source"), F.expr("substring(target, 5)").alias("target"))
    return named.unionByName(linked).where("source <> target").dropDuplicates()


FLOWS_SQL = f"""{LINKS_SQL},
flows AS (
  SELECT DISTINCT scan_id, source, target FROM (
    SELECT scan_id, lower(trim(component_id)) AS source, nullif(lower(trim(a.topology.related_component_id)), '') AS target FROM (SELECT scan_id, component_id, unnest(data_actions) AS a FROM components)
    UNION ALL SELECT scan_id, substr(source, 5), substr(target, 5) FROM links WHERE starts_with(source, 'dp::cmp_') AND starts_with(target, 'dp::cmp_'))
  WHERE target IS NOT NULL AND source <> target)"""


def flow_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Flows counted by the types of their ends."""
    typed = typed_flows(flows(spark, folder), components(spark, folder), ["scan_id"])
    return typed.groupBy("source_type", "target_type").agg(F.count("*").alias("flows"), F.count_distinct("scan_id").alias("scans"))


TYPED_SQL = f"""{FLOWS_SQL}, {COMPONENTS_SQL},
typed AS (SELECT f.*, s.type AS source_type, s.sub_type AS source_sub_type, t.type AS target_type, t.sub_type AS target_sub_type FROM flows f
          JOIN components_1 s ON s.scan_id = f.scan_id AND s.component = f.source JOIN components_1 t ON t.scan_id = f.scan_id AND t.component = f.target)"""
MATRIX = f"WITH {TYPED_SQL} SELECT source_type, target_type, count(*) AS flows, count(DISTINCT scan_id) AS scans FROM typed GROUP BY ALL"


def topology_roles(spark: SparkSession, folder: str) -> DataFrame:
    return roles_from_topology(typed_flows(flows(spark, folder), components(spark, folder), ["scan_id"]), ["scan_id"])


ROLES = f"""WITH {TYPED_SQL}, u AS (SELECT scan_id, target AS component, 1 AS received, 0 AS handed FROM typed WHERE source_type = 'actor'
  UNION ALL SELECT scan_id, source, 0, 1 FROM typed WHERE target_type = 'third_party'),
s AS (SELECT scan_id, component, sum(received)::BIGINT AS received, sum(handed)::BIGINT AS handed FROM u GROUP BY ALL)
SELECT *, CASE WHEN received > 0 AND handed > 0 THEN 'passes' WHEN received > 0 THEN 'receives' ELSE 'hands_on' END AS role FROM s"""


def main_components(spark: SparkSession, folder: str) -> DataFrame:
    """The main asset of every scan: most flows, then the most confident, then the name."""
    c = components(spark, folder).where("type = 'asset'")
    d = degrees(flows(spark, folder), ["scan_id"]).select("scan_id", F.col("node").alias("component"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    ranked = c.join(d, ["scan_id", "component"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = top_per_group(ranked, ["scan_id"], [F.desc("degree"), F.desc_nulls_last("confidence"), F.asc("name"), F.asc("component")], 1)
    return top.select("scan_id", "component", "name", "degree")


MAIN_SQL = f"""{FLOWS_SQL}, {COMPONENTS_SQL},
degree AS (SELECT scan_id, component, count(*) AS degree FROM (SELECT scan_id, source AS component FROM flows UNION ALL SELECT scan_id, target FROM flows) GROUP BY ALL),
main AS (SELECT c.scan_id, c.component, c.name, coalesce(d.degree, 0) AS degree FROM components_1 c LEFT JOIN degree d USING (scan_id, component) WHERE c.type = 'asset'
  QUALIFY row_number() OVER (PARTITION BY c.scan_id ORDER BY coalesce(d.degree, 0) DESC, c.confidence DESC NULLS LAST, c.name, c.component) = 1)"""
MAIN = f"WITH {MAIN_SQL} SELECT * FROM main"


def rewired_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flows from actors straight to stores or queues led through the scan's main asset."""
    typed = typed_flows(flows(spark, folder), components(spark, folder), ["scan_id"])
    hubs = main_components(spark, folder).select("scan_id", F.col("component").alias("hub"))
    bypass = (F.col("source_type") == "actor") & F.col("target_sub_type").isin("database", "object_storage", "queue")
    return rewire_through_hub(typed, hubs, ["scan_id"], bypass)


REWIRED = f"""WITH {MAIN_SQL}, typed AS (SELECT f.*, s.type AS source_type, t.sub_type AS target_sub_type, m.component AS hub FROM flows f
  JOIN components_1 s ON s.scan_id = f.scan_id AND s.component = f.source JOIN components_1 t ON t.scan_id = f.scan_id AND t.component = f.target LEFT JOIN main m ON m.scan_id = f.scan_id),
b AS (SELECT *, coalesce(source_type = 'actor' AND target_sub_type IN ('database', 'object_storage', 'queue') AND hub IS NOT NULL AND source <> hub AND target <> hub, false) AS by_pass FROM typed),
k AS (SELECT DISTINCT scan_id, source, target FROM b WHERE NOT by_pass),
w AS (SELECT scan_id, source, hub AS target FROM b WHERE by_pass UNION SELECT scan_id, hub, target FROM b WHERE by_pass)
SELECT *, false AS synthetic FROM k UNION ALL SELECT w.*, true FROM w ANTI JOIN k USING (scan_id, source, target)"""


def canonical_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flows whose component ids are replaced by ids of the components' content (scan, type, name)."""
    key = F.concat_ws("|", "scan_id", "type", "name")
    ids = components(spark, folder).select("scan_id", F.col("component").alias("old"), short_id("cmp_", key).alias("new"))
    return rewrite_ends(flows(spark, folder), ids, ["scan_id"]).dropDuplicates()


CANONICAL = f"""WITH {FLOWS_SQL}, {COMPONENTS_SQL}, i AS (SELECT scan_id, component AS old, 'cmp_' || substr(sha256(scan_id || '|' || type || '|' || name), 1, 12) AS new FROM components_1)
SELECT DISTINCT f.scan_id, coalesce(s.new, f.source) AS source, coalesce(t.new, f.target) AS target FROM flows f
LEFT JOIN i s ON s.scan_id = f.scan_id AND s.old = f.source LEFT JOIN i t ON t.scan_id = f.scan_id AND t.old = f.target"""


def component_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Components that break the schema's constraints, counted by check."""
    c = table(spark, folder, "components")
    checks = {
        "id_form": F.col("component_id").rlike("^cmp_[0-9a-f]{12}$"),
        "known_type": F.col("type").isin("asset", "third_party", "actor"),
        "confidence_range": F.col("confidence").between(0, 1),
        "subtype_given": F.col("sub_type").isNotNull(),
        "lives_forward": F.col("removed_at").isNull() | (F.col("removed_at") > F.col("loaded_at")),
    }
    return violations(c, ["scan_id", "component_id"], checks).groupBy("violation").agg(F.count("*").alias("rows"))


VIOLATIONS = r"""
WITH v AS (SELECT unnest([CASE WHEN NOT coalesce(regexp_matches(component_id, '^cmp_[0-9a-f]{12}$'), false) THEN 'id_form' END, CASE WHEN NOT coalesce(type IN ('asset', 'third_party', 'actor'), false) THEN 'known_type' END,
  CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence_range' END, CASE WHEN sub_type IS NULL THEN 'subtype_given' END,
  CASE WHEN NOT coalesce(removed_at IS NULL OR removed_at > loaded_at, false) THEN 'lives_forward' END]) AS violation FROM components)
SELECT violation, count(*) AS "rows" FROM v WHERE violation IS NOT NULL GROUP BY 1
"""


def section_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per section of their file, with the section's share of its scan's hits."""
    s = file_sections(spark, folder)
    h = hits(spark, folder).groupBy("scan_id", "path").agg(F.count("*").alias("n"))
    per = s.join(h, ["scan_id", "path"]).groupBy("scan_id", "section").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))
    total = per.groupBy("scan_id").agg(F.sum("hits").alias("_all"))
    return per.join(total, "scan_id").select("scan_id", "section", "hits", "files", F.try_divide("hits", "_all").alias("share"))


SECTION_SIGNALS = f"WITH {HITS_SQL}, s AS ({SECTIONS}), h AS (SELECT scan_id, path, count(*) AS n FROM hits GROUP BY ALL), p AS (SELECT scan_id, section, sum(n)::BIGINT AS hits, count(*) AS files FROM s JOIN h USING (scan_id, path) GROUP BY ALL) SELECT *, hits::DOUBLE / (sum(hits) OVER (PARTITION BY scan_id))::DOUBLE AS share FROM p"


def consolidated_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of one signal in one file whose lines overlap or touch, merged into one finding."""
    h = hits(spark, folder)
    merged = merge_intervals(h, ["scan_id", "path", "signal_id"], "start_line", "end_line")
    return merged.select("scan_id", "path", "signal_id", F.col("from_pos").alias("from_line"), F.col("to_pos").alias("to_line"))


CONSOLIDATED = f"""WITH {HITS_SQL}, d AS (SELECT DISTINCT scan_id, path, signal_id, start_line AS lo, end_line AS hi FROM hits WHERE start_line IS NOT NULL AND end_line >= start_line),
m AS (SELECT *, max(hi) OVER (PARTITION BY scan_id, path, signal_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, path, signal_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT scan_id, path, signal_id, min(lo)::BIGINT AS from_line, max(hi)::BIGINT AS to_line FROM i GROUP BY scan_id, path, signal_id, g"""


QUERIES = {
    "flow_matrix": flow_matrix,
    "topology_roles": topology_roles,
    "main_components": main_components,
    "rewired_flows": rewired_flows,
    "canonical_flows": canonical_flows,
    "component_violations": component_violations,
    "section_signals": section_signals,
    "consolidated_hits": consolidated_hits,
}
SQL = {
    "flow_matrix": MATRIX,
    "topology_roles": ROLES,
    "main_components": MAIN,
    "rewired_flows": REWIRED,
    "canonical_flows": CANONICAL,
    "component_violations": VIOLATIONS,
    "section_signals": SECTION_SIGNALS,
    "consolidated_hits": CONSOLIDATED,
}
