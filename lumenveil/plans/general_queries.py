"""Queries over changing attributes, intervals and references, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.text import loose_id, micros, relative_path, status_label
from lumenveil.operators.history import latest, periods
from lumenveil.operators.intervals import cover_and_gaps, merge_intervals
from lumenveil.operators.references import orphan_references
from lumenveil.tables import table


def status_observations(events: DataFrame) -> DataFrame:
    """One status per issue and instant: last recorded row of each event, then of each instant."""
    rows = events.select(
        "event_id",
        F.lower(F.regexp_extract("issue_id", r"(?i)^\s*CPRIV-([0-9a-f]{6})", 1)).alias("issue_key"),
        micros(F.col("occurred_at")).alias("at"),
        status_label(F.col("payload.to_status")).alias("status"),
        micros(F.col("recorded_at")).alias("recorded"),
    )
    current = latest(rows, ["event_id"], ["recorded"])
    usable = current.where("status IS NOT NULL AND issue_key <> '' AND at IS NOT NULL")
    return latest(usable, ["issue_key", "at"], ["recorded"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    history = periods(status_observations(table(spark, folder, "issue_events")), "issue_key", "at", "status")
    return history.select(
        "issue_key",
        "status",
        F.col("valid_from").alias("valid_from_us"),
        F.coalesce("valid_to", F.lit(-1)).cast("long").alias("valid_to_us"),
    )


P2_SQL = r"""
WITH rows AS (
  SELECT event_id, lower(regexp_extract(issue_id, '(?i)^\s*CPRIV-([0-9a-f]{6})', 1)) AS issue_key,
         epoch_us(occurred_at) AS ts, epoch_us(recorded_at) AS recorded,
         nullif(regexp_replace(regexp_replace(lower(regexp_replace(trim(payload.to_status), '([a-z0-9])([A-Z])', '\1_\2', 'g')),
                '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS status
  FROM issue_events),
cur AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY recorded DESC NULLS LAST, issue_key DESC, ts DESC, status DESC) = 1),
one AS (SELECT * FROM cur WHERE status IS NOT NULL AND issue_key <> '' AND ts IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY issue_key, ts ORDER BY recorded DESC NULLS LAST, event_id DESC, status DESC) = 1),
chg AS (SELECT * FROM one QUALIFY lag(status) OVER (PARTITION BY issue_key ORDER BY ts) IS DISTINCT FROM status)
SELECT issue_key, status, ts AS valid_from_us,
       coalesce(lead(ts) OVER (PARTITION BY issue_key ORDER BY ts), -1)::BIGINT AS valid_to_us
FROM chg
"""


def evidence_lines(spans: DataFrame) -> DataFrame:
    """Spans as closed line intervals per file; impossible starts drop out, swapped ends are put in order."""
    end = F.coalesce("end_line", "start_line")
    return spans.where("start_line >= 1").select(
        "scan_id",
        relative_path(F.col("file_path")).alias("file_path"),
        F.greatest(F.least("start_line", end), F.lit(1)).alias("lo"),
        F.greatest("start_line", end).alias("hi"),
    ).where("file_path IS NOT NULL")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["scan_id", "file_path"]
    merged = merge_intervals(evidence_lines(table(spark, folder, "evidence_spans")), keys, "lo", "hi")
    return cover_and_gaps(merged, keys).select(
        *keys, "piece", F.col("from_pos").cast("int").alias("from_line"), F.col("to_pos").cast("int").alias("to_line")
    )


#: Path normalisation in DuckDB; ``{p}`` is the path.
PATH_SQL = r"""array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(replace(trim({p}), chr(92), '/'), '/'), lambda x: [x])),
  lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END), '/')"""

P4_SQL = f"""
WITH s AS (
  -- distinct: two equal rows would tie, and the two windows below could order them differently
  SELECT DISTINCT scan_id, nullif({PATH_SQL.format(p='file_path')}, '') AS file_path,
         greatest(least(start_line, coalesce(end_line, start_line)), 1) AS lo,
         greatest(start_line, coalesce(end_line, start_line)) AS hi
  FROM evidence_spans WHERE start_line >= 1),
m AS (SELECT *, max(hi) OVER (PARTITION BY scan_id, file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM s WHERE file_path IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, file_path ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT scan_id, file_path, g, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY ALL),
n AS (SELECT *, lead(lo) OVER (PARTITION BY scan_id, file_path ORDER BY lo) AS nxt FROM c)
SELECT scan_id, file_path, 'covered' AS piece, lo::INT AS from_line, hi::INT AS to_line FROM n
UNION ALL SELECT scan_id, file_path, 'gap', (hi + 1)::INT, (nxt - 1)::INT FROM n WHERE nxt IS NOT NULL
"""


def graph_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(link mentions, node targets, topology mentions, component targets), ids made comparable."""
    ends = F.inline(
        F.array(
            F.struct(F.lit("source").alias("ref_field"), loose_id(F.col("source")).alias("target_id")),
            F.struct(F.lit("target").alias("ref_field"), loose_id(F.col("target")).alias("target_id")),
        )
    )
    links = table(spark, folder, "graph_links").select(
        F.lit("graph_links").alias("ref_table"),
        F.col("link_id").alias("ref_id"),
        "scan_id",
        micros(F.col("recorded_at")).alias("at"),
        ends,
    )
    components = table(spark, folder, "components")
    actions = components.select("scan_id", F.explode("data_actions").alias("d")).select(
        F.lit("components").alias("ref_table"),
        F.lit("related_component_id").alias("ref_field"),
        F.col("d.assignment_id").alias("ref_id"),
        "scan_id",
        micros(F.col("d.recorded_at")).alias("at"),
        loose_id(F.col("d.topology.related_component_id")).alias("target_id"),
    )

    def targets(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "scan_id",
            loose_id(F.col(name)).alias("target_id"),
            micros(F.col("loaded_at")).alias("live_from"),
            micros(F.col("removed_at")).alias("live_to"),
        ).where("target_id IS NOT NULL")

    return links, targets(table(spark, folder, "graph_nodes"), "node_id"), actions, targets(components, "component_id")


def dangling_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention without a live target: ref_table, ref_field, ref_id, at, why."""
    links, nodes, actions, components = graph_references(spark, folder)
    found = []
    for refs, targets in ((links, nodes), (actions, components)):
        found.append(
            orphan_references(
                refs, targets, ["scan_id", "target_id"], ["target_id"], "at", "live_from", "live_to", match="partial"
            ).select("ref_table", "ref_field", "ref_id", "at", "why")
        )
    # a redelivered row is the same mention
    return found[0].unionByName(found[1]).dropDuplicates()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return dangling_mentions(spark, folder).select("ref_table", "ref_field", "ref_id", "why").dropDuplicates()


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions without a live target per table, month of recorded_at and reason."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return dangling_mentions(spark, folder).groupBy("ref_table", month.alias("month"), "why").agg(
        F.count("*").alias("mentions")
    )


P5_BASE = r"""
WITH refs AS (
  SELECT 'graph_links' AS ref_table, 'source' AS ref_field, link_id AS ref_id, scan_id, recorded_at AS ts, nullif(lower(trim(source)), '') AS id FROM graph_links
  UNION SELECT 'graph_links', 'target', link_id, scan_id, recorded_at, nullif(lower(trim(target)), '') FROM graph_links
  UNION SELECT 'components', 'related_component_id', d.assignment_id, scan_id, d.recorded_at, nullif(lower(trim(d.topology.related_component_id)), '')
        FROM (SELECT scan_id, unnest(data_actions) AS d FROM components)),
targets AS (
  SELECT 'graph_links' AS ref_table, scan_id, lower(trim(node_id)) AS id, loaded_at, removed_at FROM graph_nodes
  UNION ALL SELECT 'components', scan_id, lower(trim(component_id)), loaded_at, removed_at FROM components),
why AS (
  SELECT r.ref_table, r.ref_field, r.ref_id, r.ts,
         CASE WHEN count(t.id) = 0 THEN 'missing' WHEN min(t.loaded_at) > r.ts THEN 'late' ELSE 'deleted' END AS why
  FROM refs r LEFT JOIN targets t ON t.ref_table = r.ref_table AND (r.scan_id IS NULL OR t.scan_id = r.scan_id) AND t.id = r.id
  WHERE r.id IS NOT NULL
  GROUP BY r.ref_table, r.ref_field, r.ref_id, r.ts, r.scan_id, r.id
  HAVING coalesce(bool_or(t.loaded_at <= r.ts AND (t.removed_at IS NULL OR r.ts < t.removed_at)), false) = false)
"""
# `why` groups by mention: r.ts is part of the key, so GROUP BY ALL keeps mentions apart
P5_SQL = P5_BASE + "SELECT DISTINCT ref_table, ref_field, ref_id, why FROM why"
P5_COUNTS_SQL = P5_BASE + "SELECT ref_table, strftime(make_timestamp(epoch_us(ts)), '%Y-%m') AS month, why, count(*) AS mentions FROM why GROUP BY ALL"

def status_references(spark: SparkSession, folder: str) -> DataFrame:
    """Events refer to an earlier event of their issue by (issue, from_status); without a from_status they are matched on the issue alone.

    A composite key with nulls: the first event of an issue has nothing before it, so it is an orphan; others without a from_status refer to any
    earlier status of the issue.
    """
    events = table(spark, folder, "issue_events").select(
        "event_id", "issue_id", status_label(F.col("payload.from_status")).alias("status"), status_label(F.col("payload.to_status")).alias("reached"), micros(F.col("occurred_at")).alias("at")
    ).where("event_id IS NOT NULL AND issue_id IS NOT NULL").dropDuplicates()
    targets = events.where("reached IS NOT NULL AND at IS NOT NULL").select("issue_id", F.col("reached").alias("status"), F.col("at").alias("live_from"), F.lit(None).cast("long").alias("live_to"))
    refs = events.select("event_id", "issue_id", "status", "at")
    return orphan_references(refs, targets, ["issue_id", "status"], ["issue_id"], "at", "live_from", "live_to", match="partial").select("event_id", "issue_id", "status", F.col("at").alias("at_us"), "why")


_STATUS = r"""nullif(regexp_replace(regexp_replace(lower(regexp_replace(trim({c}), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"""
STATUS_SQL = f"""
WITH e AS (SELECT DISTINCT event_id, issue_id, {_STATUS.format(c='payload.from_status')} AS status, {_STATUS.format(c='payload.to_status')} AS reached, epoch_us(occurred_at) AS at_us
           FROM issue_events WHERE event_id IS NOT NULL AND issue_id IS NOT NULL),
t AS (SELECT issue_id, reached, min(at_us) AS since FROM e WHERE reached IS NOT NULL AND at_us IS NOT NULL GROUP BY ALL),
j AS (SELECT e.*, (SELECT min(since) FROM t WHERE t.issue_id = e.issue_id AND (e.status IS NULL OR t.reached = e.status)) AS since FROM e)
SELECT event_id, issue_id, status, at_us, CASE WHEN since IS NULL THEN 'missing' ELSE 'late' END AS why FROM j WHERE since IS NULL OR at_us < since
"""

QUERIES = {"p5_partial": status_references, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts}
SQL = {"p5_partial": STATUS_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_counts": P5_COUNTS_SQL}
