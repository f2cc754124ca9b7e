"""Queries over findings, components and the code graph: joins, roll-ups, windows, graph completion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import camel_parts
from lumenveil.functions.text import loose_id, micros, relative_path
from lumenveil.operators.aggregates import majority, merge_duplicates, merged_bags, pairwise_grouping, pooled_rates, zero_filled_counts
from lumenveil.operators.evaluation import scores, strongest_pairs, unambiguous_pairs
from lumenveil.operators.graphs import degrees, distances, insert_missing_edges, node_link_document
from lumenveil.operators.history import latest
from lumenveil.operators.joins import asof_join, first_match_join, nearest_span_join, overlap_join
from lumenveil.operators.windows import stable_ids, top_per_group
from lumenveil.plans.general_queries import PATH_SQL
from lumenveil.tables import table


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per hit_id: where it stands, and its group and column in one spelling."""
    rows = table(spark, folder, "pii_hits").select(
        "hit_id", "scan_id", "repo", "signal_id", "category", "labels", relative_path(F.col("file_path")).alias("path"), "start_line", "end_line",
        *[F.regexp_replace(F.lower(c), "[^a-z0-9.:]", "").alias(a) for c, a in (("hit_group", "grp"), ("group_column", "col"))], "loaded_at",
    )
    rows = latest(rows, ["hit_id"], ["loaded_at"]).drop("loaded_at")
    return rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("grp", "col")})


HITS_SQL = f"""
hits AS (
  SELECT hit_id, scan_id, repo, signal_id, category, labels, {PATH_SQL.format(p='file_path')} AS path, start_line, end_line,
         nullif(regexp_replace(lower(hit_group), '[^a-z0-9.:]', '', 'g'), '') AS grp, nullif(regexp_replace(lower(group_column), '[^a-z0-9.:]', '', 'g'), '') AS col
  FROM pii_hits QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC) = 1)"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct usable evidence spans per file."""
    end = F.coalesce("end_line", "start_line")
    return table(spark, folder, "evidence_spans").where("start_line >= 1").select(
        "scan_id", "repo", relative_path(F.col("file_path")).alias("path"), F.least("start_line", end).alias("lo"), F.greatest("start_line", end).alias("hi"), "flow_type"
    ).dropDuplicates()


SPANS_SQL = f"""
spans AS (
  SELECT DISTINCT scan_id, repo, {PATH_SQL.format(p='file_path')} AS path, least(start_line, coalesce(end_line, start_line)) AS lo,
         greatest(start_line, coalesce(end_line, start_line)) AS hi, flow_type FROM evidence_spans WHERE start_line >= 1)"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    """One row per link_id with comparable ends; links without an end are left out."""
    rows = table(spark, folder, "graph_links").select(
        "link_id", "scan_id", "repo", loose_id(F.col("source")).alias("source"), loose_id(F.col("target")).alias("target"), "relation", "confidence", "confidence_score",
        relative_path(F.col("source_file")).alias("source_file"), F.regexp_extract("source_location", r"(\d+)", 1).try_cast("int").alias("line"), "recorded_at",
    )
    return latest(rows, ["link_id"], ["recorded_at"]).where("source IS NOT NULL AND target IS NOT NULL")


LINKS_SQL = f"""
links AS (
  SELECT link_id, scan_id, repo, nullif(lower(trim(source)), '') AS source, nullif(lower(trim(target)), '') AS target, relation, confidence, confidence_score,
         nullif({PATH_SQL.format(p='source_file')}, '') AS source_file, TRY_CAST(regexp_extract(source_location, '(\\d+)', 1) AS INT) AS line, recorded_at
  FROM graph_links WHERE nullif(trim(source), '') IS NOT NULL AND nullif(trim(target), '') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY recorded_at DESC) = 1)"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "graph_nodes").select(
        "scan_id", loose_id(F.col("node_id")).alias("node"), "label", "file_type", "dp_kind", relative_path(F.col("source_file")).alias("source_file"), "loaded_at"
    )
    return latest(rows.where("node IS NOT NULL"), ["scan_id", "node"], ["loaded_at"]).drop("loaded_at")


NODES_SQL = f"""
nodes AS (
  SELECT scan_id, lower(trim(node_id)) AS node, label, file_type, dp_kind, nullif({PATH_SQL.format(p='source_file')}, '') AS source_file FROM graph_nodes
  QUALIFY row_number() OVER (PARTITION BY scan_id, lower(trim(node_id)) ORDER BY loaded_at DESC) = 1)"""

# ---------------------------------------------------------------- joins


def hits_in_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data on a data flow's evidence: hits whose lines overlap a span of their file."""
    h = hits(spark, folder).select("hit_id", "scan_id", "path", "start_line", "end_line")
    s = spans(spark, folder).select("scan_id", "path", "lo", "hi", "flow_type")
    return overlap_join(h, s, ["scan_id", "path"], ("start_line", "end_line"), ("lo", "hi"))


HITS_IN_SPANS = f"WITH {HITS_SQL}, {SPANS_SQL} SELECT h.hit_id, h.scan_id, h.path, h.start_line, h.end_line, s.lo, s.hi, s.flow_type FROM hits h JOIN spans s ON s.scan_id = h.scan_id AND s.path = h.path AND h.start_line <= s.hi AND s.lo <= h.end_line"


def nearest_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each hit with the flow type of the covering or nearest span of its file and the distance in lines."""
    h = hits(spark, folder).select("hit_id", "scan_id", "path", "start_line")
    s = spans(spark, folder).where("flow_type IS NOT NULL")
    return nearest_span_join(h, s, ["scan_id", "path"], "start_line", ("lo", "hi"), "flow_type")


NEAREST = f"""WITH {HITS_SQL}, {SPANS_SQL}, d AS (
  SELECT h.hit_id, h.scan_id, h.path, h.start_line, s.flow_type, s.hi - s.lo AS w,
         CASE WHEN s.lo IS NULL THEN NULL WHEN h.start_line < s.lo THEN s.lo - h.start_line WHEN h.start_line > s.hi THEN h.start_line - s.hi ELSE 0 END AS distance
  FROM hits h LEFT JOIN (SELECT * FROM spans WHERE flow_type IS NOT NULL) s ON s.scan_id = h.scan_id AND s.path = h.path)
SELECT hit_id, scan_id, path, start_line, flow_type, distance FROM d QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY distance, w, flow_type) = 1"""


def events_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the last view of its user at or before it (as-of join)."""
    e = table(spark, folder, "events").withColumn("at", micros(F.col("ts")))
    purchases = e.where("event_type = 'purchase'").select("event_id", "user_id", "at", "value")
    views = e.where("event_type = 'view'").select("user_id", F.col("at").alias("view_at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(purchases, views, ["user_id"], "at", "view_at", ["view_id", "view_value"])


ASOF = """
WITH v AS (SELECT user_id, epoch_us(ts) AS at, max(struct_pack(event_id, value)) AS r FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, epoch_us(p.ts) AS at, p.value, v.r.event_id AS view_id, v.r.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON v.user_id = p.user_id AND v.at <= epoch_us(p.ts)
""".replace(" AS at", " AS t").replace("v.at", "v.t").replace("epoch_us(p.ts) AS t,", 'epoch_us(p.ts) AS "at",')

_VENDOR_HINTS = [(1, "payment", "payments"), (2, "billing", "payments"), (3, "mail", "messaging"), (4, "sms", "messaging"), (5, "message", "messaging"), (6, "audit", "analytics"), (7, "export", "storage")]


def component_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Components with the first catalog hint whose fragment their name contains (first-match join)."""
    rules = spark.createDataFrame(_VENDOR_HINTS, "position int, fragment string, hint string")
    c = table(spark, folder, "components").select(F.col("component_id"), "scan_id", F.lower("name").alias("name")).dropDuplicates()
    return first_match_join(c, rules, F.col("name").contains(F.col("fragment")), "position", ["fragment", "hint"], ["component_id", "scan_id", "name"])


HINTS = (
    "WITH r(position, fragment, hint) AS (VALUES " + ", ".join(map(str, _VENDOR_HINTS)) + "), c AS (SELECT DISTINCT component_id, scan_id, lower(name) AS name FROM components) "
    "SELECT c.component_id, c.scan_id, c.name, r.fragment, r.hint FROM c LEFT JOIN r ON contains(c.name, r.fragment) QUALIFY row_number() OVER (PARTITION BY c.component_id, c.scan_id, c.name ORDER BY r.position) = 1"
)


def unlinked_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes no link touches, by kind (anti-joins)."""
    n, e = nodes(spark, folder), links(spark, folder)
    free = n.join(e.select("scan_id", F.col("source").alias("node")), ["scan_id", "node"], "left_anti").join(
        e.select("scan_id", F.col("target").alias("node")), ["scan_id", "node"], "left_anti"
    )
    return free.groupBy(F.coalesce("dp_kind", "file_type").alias("kind")).agg(F.count("*").alias("nodes"))


UNLINKED = f"WITH {NODES_SQL}, {LINKS_SQL} SELECT coalesce(dp_kind, file_type) AS kind, count(*) AS nodes FROM nodes n WHERE NOT EXISTS (FROM links l WHERE l.scan_id = n.scan_id AND l.source = n.node) AND NOT EXISTS (FROM links l WHERE l.scan_id = n.scan_id AND l.target = n.node) GROUP BY 1"

# ---------------------------------------------------------------- aggregates


def merged_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of a scan that share type, subtype and the last word of their name, merged into the most confident."""
    c = table(spark, folder, "components").withColumn("kind", F.try_element_at(camel_parts(F.col("name")), F.lit(-1)))
    return merge_duplicates(
        c, ["scan_id", "type", "sub_type", "kind"], [-F.col("confidence")], ["name", "component_id", "confidence"], {"names": F.col("name")}
    ).withColumn("names", F.array_join("names", ","))


MERGED = r"""
WITH c AS (SELECT *, list_last(string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s.]+', ' ', 'g')), ' ')) AS kind FROM components)
SELECT scan_id, type, sub_type, kind, m.name AS name, m.component_id AS component_id, m.confidence AS confidence, merged, array_to_string(names, ',') AS names FROM (
  SELECT scan_id, type, sub_type, kind, min(struct_pack(o := -confidence, name, component_id, confidence)) AS m, count(*) AS merged, list_sort(list(DISTINCT name)) AS names FROM c GROUP BY ALL)
"""


def merged_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Links with the same ends and relation merged: best confidence, all locations; self-links are kept apart by place."""
    e = links(spark, folder)
    place = F.when(F.col("source") == F.col("target"), F.concat_ws(":", "source_file", "line"))
    return merge_duplicates(
        e.withColumn("place", place), ["scan_id", "source", "target", "relation", "place"], [-F.col("confidence_score")], ["link_id", "confidence_score"],
        {"locations": F.concat_ws(":", F.col("source_file"), F.col("line"))},
    ).withColumn("locations", F.array_join("locations", ","))


FLOWS = f"""WITH {LINKS_SQL}, e AS (SELECT *, concat_ws(':', source_file, line::VARCHAR) AS loc, CASE WHEN source = target THEN concat_ws(':', source_file, line::VARCHAR) END AS place FROM links)
SELECT scan_id, source, target, relation, place, m.link_id AS link_id, m.confidence_score AS confidence_score, merged, array_to_string(locations, ',') AS locations FROM (
 SELECT scan_id, source, target, relation, place, min(struct_pack(o := coalesce(-confidence_score, -1e308), link_id, confidence_score)) AS m, count(*) AS merged, list_sort(list(DISTINCT loc)) AS locations FROM e GROUP BY ALL)"""


def component_verbs(spark: SparkSession, folder: str) -> DataFrame:
    """Per component and verb the strongest assignment: asserted before candidate, then the most confident."""
    a = table(spark, folder, "components").select("scan_id", loose_id(F.col("component_id")).alias("component"), F.explode("data_actions").alias("a"))
    rank = F.when(F.col("a.status") == "asserted", 2).when(F.col("a.status") == "candidate", 1).otherwise(0)
    best = F.max(F.struct(rank.alias("rank"), F.col("a.confidence").alias("confidence"), F.col("a.assignment_id").alias("assignment_id"))).alias("b")
    out = a.groupBy("scan_id", "component", F.col("a.action").alias("action")).agg(best, F.count_distinct("a.assignment_id").alias("proposals"))
    return out.select("scan_id", "component", "action", "b.rank", "b.confidence", "b.assignment_id", "proposals")


VERBS = """
WITH a AS (SELECT scan_id, lower(trim(component_id)) AS component, unnest(data_actions) AS a FROM components)
SELECT scan_id, component, action, b.rank AS rank, b.confidence AS confidence, b.assignment_id AS assignment_id, proposals FROM (
  SELECT scan_id, component, a.action AS action, count(DISTINCT a.assignment_id) AS proposals,
         max(struct_pack(rank := CASE a.status WHEN 'asserted' THEN 2 WHEN 'candidate' THEN 1 ELSE 0 END, confidence := a.confidence, assignment_id := a.assignment_id)) AS b FROM a GROUP BY ALL)
"""


def grouping_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pairwise precision and recall of the column grouping of hits against their hit groups, per signal."""
    h = hits(spark, folder).where("grp IS NOT NULL").withColumns({"gold": F.concat_ws("|", "scan_id", "grp"), "predicted": F.when(F.col("col").isNotNull(), F.concat_ws("|", "scan_id", "col"))})
    return pairwise_grouping(h, ["signal_id"], "gold", "predicted")


GROUPING = f"""WITH {HITS_SQL}, h AS (SELECT signal_id, scan_id || '|' || grp AS gold, scan_id || '|' || col AS predicted FROM hits WHERE grp IS NOT NULL),
g AS (SELECT signal_id, sum(n * (n - 1) / 2) AS p FROM (SELECT signal_id, gold, count(*) AS n FROM h GROUP BY ALL) GROUP BY 1),
q AS (SELECT signal_id, sum(n * (n - 1) / 2) AS p FROM (SELECT signal_id, predicted, count(*) AS n FROM h WHERE predicted IS NOT NULL GROUP BY ALL) GROUP BY 1),
j AS (SELECT signal_id, sum(n * (n - 1) / 2) AS p FROM (SELECT signal_id, gold, predicted, count(*) AS n FROM h WHERE predicted IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT g.signal_id, g.p::BIGINT AS gold_pairs, coalesce(q.p, 0)::BIGINT AS predicted_pairs, coalesce(j.p, 0)::BIGINT AS joint_pairs,
       coalesce(j.p, 0)::DOUBLE / nullif(coalesce(q.p, 0)::DOUBLE, 0) AS precision, coalesce(j.p, 0)::DOUBLE / nullif(g.p::DOUBLE, 0) AS recall
FROM g LEFT JOIN q USING (signal_id) LEFT JOIN j USING (signal_id)"""


def resolution_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of hits with a group per category and signal, and pooled per category (grouping sets)."""
    return pooled_rates(hits(spark, folder).withColumn("grouped", F.col("grp").isNotNull()), "category", "signal_id", "grouped")


RATES = f"""WITH {HITS_SQL} SELECT category, signal_id, grouping(signal_id)::INT AS pooled, count_if(grp IS NOT NULL)::BIGINT AS hits, count(*) AS total,
 count_if(grp IS NOT NULL)::DOUBLE / count(*) AS rate FROM hits GROUP BY GROUPING SETS ((category), (category, signal_id))"""

_VERBS = ["collect", "store", "transform", "log", "delete", "display", "relay", "generate", "use", "combine", "disclose", "archive"]


def verb_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How often each verb of the fixed domain is assigned; unused verbs count zero."""
    a = table(spark, folder, "components").select(F.explode("data_actions").alias("a")).select(F.col("a.assignment_id").alias("id"), F.col("a.action").alias("action")).dropDuplicates()
    return zero_filled_counts(a, "action", _VERBS)


HISTOGRAM = f"WITH d(action) AS (VALUES {', '.join(f'({v!r})' for v in _VERBS)}), a AS (SELECT DISTINCT a.assignment_id, a.action FROM (SELECT unnest(data_actions) AS a FROM components)) SELECT d.action, count(a.action) AS n FROM d LEFT JOIN a ON a.action = d.action GROUP BY 1"


def file_signal(spark: SparkSession, folder: str) -> DataFrame:
    """The signal most hits of a file carry (majority vote, ties to the smaller name)."""
    return majority(hits(spark, folder), ["scan_id", "path"], "signal_id")


SIGNAL = f"WITH {HITS_SQL}, c AS (SELECT scan_id, path, signal_id, count(*) AS votes FROM hits GROUP BY ALL) SELECT scan_id, path, signal_id, votes FROM c QUALIFY row_number() OVER (PARTITION BY scan_id, path ORDER BY votes DESC, signal_id) = 1"


def merged_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Property bags of hits merged per file: every label by name with its values in order of first appearance."""
    bags = hits(spark, folder).select("scan_id", "path", "start_line", F.create_map(F.col("category"), F.col("signal_id")).alias("bag"))
    return merged_bags(bags, ["scan_id", "path"], "bag", "start_line").withColumn("values", F.array_join("values", ","))


BAGS = f"""WITH {HITS_SQL}, f AS (SELECT scan_id, path, category AS name, signal_id AS value, min(start_line) AS o FROM hits GROUP BY ALL)
SELECT scan_id, path, name, array_to_string(list(value ORDER BY o NULLS FIRST, value), ',') AS "values" FROM f GROUP BY scan_id, path, name"""

# ---------------------------------------------------------------- windows


def stable_link_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Content-derived ids of links; equal content gets numbered ids in total order."""
    e = links(spark, folder)
    key = F.to_json(F.array(F.lit("flow/v1"), F.col("scan_id").cast("string"), "source", "target", "relation"))
    return stable_ids(e, "flow_", key, [F.col("link_id")]).select("link_id", "stable_id")


STABLE = f"""WITH {LINKS_SQL}, k AS (SELECT link_id, 'flow_' || substr(sha256('["flow/v1","' || scan_id || '","' || source || '","' || target || '","' || relation || '"]'), 1, 12) AS base FROM links),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY link_id) AS n FROM k) SELECT link_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS stable_id FROM n"""


def top_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """The three most linked nodes of every scan (the limit is the feature)."""
    d = degrees(links(spark, folder), ["scan_id"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return top_per_group(d, ["scan_id"], [F.desc("degree"), F.asc("node")], 3)


HUBS = f"""WITH {LINKS_SQL}, e AS (SELECT DISTINCT scan_id, source, target FROM links),
d AS (SELECT scan_id, node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT scan_id, source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT scan_id, target, 0, 1 FROM e) GROUP BY ALL)
SELECT scan_id, node, out_degree, in_degree, in_degree + out_degree AS degree, row_number() OVER (PARTITION BY scan_id ORDER BY in_degree + out_degree DESC, node)::INT AS rank FROM d QUALIFY rank <= 3"""

# ---------------------------------------------------------------- graphs


def completed_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Links plus a containing link from its file to every node no link reaches, where that file has a node."""
    e = links(spark, folder).select("scan_id", "source", "target", "relation").dropDuplicates()
    n = nodes(spark, folder)
    owners = n.where("dp_kind IS NULL AND source_file IS NOT NULL").groupBy("scan_id", "source_file").agg(F.min(F.struct(F.length("node").alias("l"), "node"))["node"].alias("owner"))
    orphans = n.join(e.select("scan_id", F.col("target").alias("node")), ["scan_id", "node"], "left_anti")
    wanted = orphans.join(owners, ["scan_id", "source_file"]).where("owner <> node").select("scan_id", F.col("owner").alias("source"), F.col("node").alias("target"), F.lit("contains").alias("relation"))
    return insert_missing_edges(e, wanted, ["scan_id", "source", "target", "relation"])


COMPLETED = f"""WITH {LINKS_SQL}, {NODES_SQL}, e AS (SELECT DISTINCT scan_id, source, target, relation FROM links),
o AS (SELECT scan_id, source_file, min(struct_pack(l := length(node), node)) AS m FROM nodes WHERE dp_kind IS NULL AND source_file IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT n.scan_id, o.m.node AS source, n.node AS target, 'contains' AS relation FROM nodes n JOIN o USING (scan_id, source_file)
      WHERE o.m.node <> n.node AND NOT EXISTS (FROM e WHERE e.scan_id = n.scan_id AND e.target = n.node))
SELECT *, false AS synthetic FROM e UNION ALL SELECT w.*, true FROM w ANTI JOIN e USING (scan_id, source, target, relation)"""


def hub_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Fewest links from the busiest node of each scan to every node it reaches."""
    e = links(spark, folder).select("scan_id", "source", "target")
    d = degrees(e, ["scan_id"])
    start = top_per_group(d, ["scan_id"], [F.desc("out_degree"), F.asc("node")], 1).select("scan_id", "node")
    return distances(e, start, ["scan_id"])


DISTANCES = f"""WITH RECURSIVE {LINKS_SQL}, e AS (SELECT DISTINCT scan_id, source, target FROM links),
s AS (SELECT scan_id, source AS node FROM (SELECT scan_id, source, count(*) AS n FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, source) = 1),
r(scan_id, node, distance) AS (SELECT scan_id, node, 0 FROM s UNION SELECT r.scan_id, e.target, r.distance + 1 FROM r JOIN e ON e.scan_id = r.scan_id AND e.source = r.node WHERE r.distance < 40)
SELECT scan_id, node, min(distance)::INT AS distance FROM r GROUP BY scan_id, node"""


def graph_document(spark: SparkSession, folder: str) -> DataFrame:
    """The property graph as node-link JSON, one object per row."""
    n = nodes(spark, folder).select("scan_id", F.col("node").alias("id"), "label", "file_type", "dp_kind")
    e = links(spark, folder).select("scan_id", "source", "target", "relation", "confidence").dropDuplicates()
    return node_link_document(n, e, "scan_id")


# ---------------------------------------------------------------- evaluation


def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of evidence spans by personal-data hits and scoped precision of the hits, per repository.

    Gold: merged distinct spans; findings: hits of files that have spans.  A pair counts when gold and hit have no other partner.
    """
    gold = spans(spark, folder).select("repo", "scan_id", "path", "lo", "hi").dropDuplicates().withColumn("gold_id", F.concat_ws("|", "scan_id", "path", "lo", "hi"))
    found = hits(spark, folder).select(F.col("hit_id").alias("finding_id"), "repo", "scan_id", "path", "start_line", "end_line")
    pairs = overlap_join(found, gold.select("scan_id", "path", F.col("lo"), F.col("hi"), "gold_id"), ["scan_id", "path"], ("start_line", "end_line"), ("lo", "hi"))
    scoped = found.join(gold.select("scan_id", "path").dropDuplicates().withColumn("in_scope", F.lit(True)), ["scan_id", "path"], "left")
    return scores(gold, scoped, unambiguous_pairs(pairs, "gold_id", "finding_id"), ["repo"], "gold_id", "finding_id", F.col("in_scope"))


SCORES = f"""WITH {HITS_SQL}, {SPANS_SQL}, gold AS (SELECT DISTINCT repo, scan_id, path, lo, hi, scan_id || '|' || path || '|' || lo || '|' || hi AS gold_id FROM spans),
c AS (SELECT DISTINCT g.gold_id, h.hit_id FROM gold g JOIN hits h ON h.scan_id = g.scan_id AND h.path = g.path AND h.start_line <= g.hi AND g.lo <= h.end_line),
p AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY gold_id) = 1 AND count(*) OVER (PARTITION BY hit_id) = 1),
r AS (SELECT repo, count(*) AS gold, count(p.gold_id) AS matched FROM gold LEFT JOIN p USING (gold_id) GROUP BY repo),
s AS (SELECT h.repo, count(*) AS scoped, count(p.hit_id) AS scoped_matched FROM hits h SEMI JOIN (SELECT DISTINCT scan_id, path FROM gold) g ON g.scan_id = h.scan_id AND g.path = h.path LEFT JOIN p USING (hit_id) GROUP BY h.repo)
SELECT coalesce(r.repo, s.repo) AS repo, coalesce(gold, 0) AS gold, coalesce(matched, 0) AS matched, coalesce(scoped, 0) AS scoped, coalesce(scoped_matched, 0) AS scoped_matched,
  matched::DOUBLE / nullif(gold, 0) AS recall, scoped_matched::DOUBLE / nullif(scoped, 0) AS precision,
  CASE WHEN coalesce(gold, 0) = 0 THEN 'no_gold' ELSE 'computable' END AS recall_state, CASE WHEN coalesce(scoped, 0) = 0 THEN 'no_findings_in_scope' ELSE 'computable' END AS precision_state
FROM r FULL JOIN s ON r.repo = s.repo"""


def strongest_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Spans claimed by one hit only, each hit going to the span it overlaps most (3 exact, 2 overlapping)."""
    gold = spans(spark, folder).select("scan_id", "path", "lo", "hi").dropDuplicates().withColumn("gold_id", F.concat_ws("|", "scan_id", "path", "lo", "hi"))
    found = hits(spark, folder).select(F.col("hit_id").alias("finding_id"), "scan_id", "path", "start_line", "end_line")
    pairs = overlap_join(found, gold, ["scan_id", "path"], ("start_line", "end_line"), ("lo", "hi"))
    strength = F.when((F.col("start_line") == F.col("lo")) & (F.col("end_line") == F.col("hi")), 3).otherwise(2)
    return strongest_pairs(pairs.withColumn("strength", strength), "gold_id", "finding_id", "strength")


STRONGEST = f"""WITH {HITS_SQL}, {SPANS_SQL}, gold AS (SELECT DISTINCT scan_id, path, lo, hi, scan_id || '|' || path || '|' || lo || '|' || hi AS gold_id FROM spans),
c AS (SELECT g.gold_id, h.hit_id AS finding_id, max(CASE WHEN h.start_line = g.lo AND h.end_line = g.hi THEN 3 ELSE 2 END) AS strength FROM gold g JOIN hits h ON h.scan_id = g.scan_id AND h.path = g.path AND h.start_line <= g.hi AND g.lo <= h.end_line GROUP BY ALL),
s AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY gold_id) = 1)
SELECT gold_id, finding_id, strength FROM s QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY strength DESC, gold_id) = 1"""

QUERIES = {
    "hits_in_spans": hits_in_spans,
    "nearest_evidence": nearest_evidence,
    "events_asof": events_asof,
    "component_hints": component_hints,
    "unlinked_nodes": unlinked_nodes,
    "merged_components": merged_components,
    "merged_flows": merged_flows,
    "component_verbs": component_verbs,
    "grouping_scores": grouping_scores,
    "resolution_rates": resolution_rates,
    "verb_histogram": verb_histogram,
    "file_signal": file_signal,
    "merged_labels": merged_labels,
    "stable_link_ids": stable_link_ids,
    "top_hubs": top_hubs,
    "completed_graph": completed_graph,
    "hub_distances": hub_distances,
    "graph_document": graph_document,
    "evidence_scores": evidence_scores,
    "strongest_evidence": strongest_evidence,
}
SQL = {
    "hits_in_spans": HITS_IN_SPANS,
    "nearest_evidence": NEAREST,
    "events_asof": ASOF,
    "component_hints": HINTS,
    "unlinked_nodes": UNLINKED,
    "merged_components": MERGED,
    "merged_flows": FLOWS,
    "component_verbs": VERBS,
    "grouping_scores": GROUPING,
    "resolution_rates": RATES,
    "verb_histogram": HISTOGRAM,
    "file_signal": SIGNAL,
    "merged_labels": BAGS,
    "stable_link_ids": STABLE,
    "top_hubs": HUBS,
    "completed_graph": COMPLETED,
    "hub_distances": DISTANCES,
    "evidence_scores": SCORES,
    "strongest_evidence": STRONGEST,
}
