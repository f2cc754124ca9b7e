"""Hits of one concept that belong together: shared group, shared column or shared declaration."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.text import relative_path
from lumenveil.llm.groups import linked_groups, star_edges
from lumenveil.plans.general_queries import PATH_SQL
from lumenveil.tables import table

#: Words that stand for no value (fixed values, compared after normalisation).
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "unresolved", "undefined", "tbd", "todo")


def loose_key(value: Column) -> Column:
    """Letter case, quoting marks, brackets, blanks and underscores put aside; placeholders are null."""
    key = F.translate(F.lower(value), " \t\n\r\f\x0b_\"'`´‘’“”[](){}<>", "")
    return F.when(key.isin(*PLACEHOLDERS) | (F.translate(key, string.punctuation, "") == ""), None).otherwise(key)


def declared_place(declaration: Column) -> tuple[Column, Column]:
    """(line, name) of a declaration in JSON; null for words, broken JSON and placeholders."""
    line = F.trim(F.get_json_object(declaration, "$.line")).try_cast("bigint")
    name = F.trim(F.get_json_object(declaration, "$.name"))
    usable = name.isNotNull() & ~F.lower(name).isin(*PLACEHOLDERS)
    return F.when(line >= 1, line), F.when(usable, name)


def hit_links(hits: DataFrame) -> DataFrame:
    """Star edges between hits that share a key within scan and signal."""
    line, name = declared_place(F.col("declaration"))
    hits = hits.where("hit_id IS NOT NULL AND scan_id IS NOT NULL AND signal_id IS NOT NULL")
    hits = hits.select("hit_id", "scan_id", F.trim("signal_id").alias("signal_id"), "file_path", "hit_group", "group_column", line.alias("line"), name.alias("name"))
    # null if any part is: only declared places need their path
    place = F.when(F.col("line").isNotNull() & F.col("name").isNotNull(), F.concat(relative_path(F.col("file_path")), F.lit("\u0000"), F.col("line").cast("string"), F.lit("\u0000"), F.col("name")))
    keys = F.inline(
        F.array(
            F.struct(F.lit("group").alias("kind"), loose_key(F.col("hit_group")).alias("key")),
            F.struct(F.lit("column").alias("kind"), loose_key(F.col("group_column")).alias("key")),
            F.struct(F.lit("place").alias("kind"), place.alias("key")),
        )
    )
    members = hits.select("hit_id", "scan_id", "signal_id", keys).where("key IS NOT NULL")
    return star_edges(members, "hit_id", ["scan_id", "signal_id", "kind", "key"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = linked_groups(hit_links(table(spark, folder, "pii_hits")))
    return groups.select(F.col("group_id").alias("group_hit_id"), F.col("member").alias("hit_id"))


P3_SQL = """
WITH RECURSIVE h AS (
  SELECT DISTINCT hit_id, scan_id, trim(signal_id) AS sig, file_path, hit_group, group_column, declaration FROM pii_hits
  WHERE hit_id IS NOT NULL AND scan_id IS NOT NULL AND signal_id IS NOT NULL),
n AS (
  SELECT hit_id, scan_id, sig, """ + PATH_SQL.format(p="file_path") + r""" AS path,
         regexp_replace(lower(hit_group), '[\s_"''`\[\](){}<>]+', '', 'g') AS g,
         regexp_replace(lower(group_column), '[\s_"''`\[\](){}<>]+', '', 'g') AS c,
         CASE WHEN json_valid(declaration) THEN TRY_CAST(json_extract_string(declaration, '$.line') AS BIGINT) END AS line,
         CASE WHEN json_valid(declaration) THEN trim(json_extract_string(declaration, '$.name')) END AS name
  FROM h),
k AS (
  SELECT hit_id, scan_id, sig, 'group' AS kind, g AS key FROM n
  UNION ALL SELECT hit_id, scan_id, sig, 'column', c FROM n
  UNION ALL SELECT hit_id, scan_id, sig, 'place', path || chr(0) || line || chr(0) || name FROM n
            WHERE path <> '' AND line >= 1 AND lower(name) NOT IN ({ph})),
u AS (SELECT * FROM k WHERE key IS NOT NULL AND lower(key) NOT IN ({ph}) AND NOT regexp_full_match(key, '[[:punct:]]*')),
e AS (SELECT DISTINCT u.hit_id AS a, m.b FROM u JOIN (SELECT scan_id, sig, kind, key, min(hit_id) AS b FROM u GROUP BY ALL) m
      USING (scan_id, sig, kind, key) WHERE u.hit_id <> m.b),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
SELECT least(a, min(b)) AS group_hit_id, a AS hit_id FROM reach GROUP BY a
""".replace("{ph}", ", ".join(f"'{p}'" for p in PLACEHOLDERS))
