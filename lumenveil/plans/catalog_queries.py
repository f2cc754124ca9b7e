"""Queries over declarations: stored columns, functions and their calls, code without comments, populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenveil.functions.comments import without_comments
from lumenveil.functions.conditions import apply_rules
from lumenveil.functions.lines import exploded_lines
from lumenveil.functions.text import micros
from lumenveil.operators.windows import enclosing_header, top_per_group
from lumenveil.plans.code_queries import FILES_SQL, ROW, delivered_files, delivered_lines, from_current
from lumenveil.shipping import ship_package
from lumenveil.tables import table

#: Headers that name a table or model, and lines that declare a stored column (language, pattern with one group).
_MODEL = {
    "python": r"^class\s+(\w+)",
    "java": r"\bclass\s+(\w+)",
    "csharp": r"\bclass\s+(\w+)",
    "go": r"^type\s+(\w+)\s+struct",
    "typescript": r"^export\s+(?:interface|class)\s+(\w+)|^export\s+const\s+(\w+)Schema",
}
_COLUMN = [
    ("python", "sqlalchemy", r"^\s+(\w+)\s*=\s*(?:mapped_column|Column)\("),
    ("java", "jpa", r"@Column\(\s*name\s*=\s*\"(\w+)\""),
    ("go", "struct_tag", r"`[^`]*json:\"(\w+)[,\"]"),
    ("csharp", "property", r"^\s+public\s+[\w<>?\[\]]+\s+(\w+)\s*\{\s*get;"),
    ("typescript", "schema_field", r"^\s+(\w+):\s*z\.\w+"),
]


def stored_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Declared columns with the model whose header stands above them, by file and line."""
    header = F.lit("")
    for language, pattern in _MODEL.items():
        groups = [F.nullif(F.regexp_extract("line", pattern, g), F.lit("")) for g in range(1, 1 + pattern.count("(\\w+)"))]
        header = F.when(F.col("language") == language, F.coalesce(*groups, F.lit(""))).otherwise(header)
    found = []
    for language, evidence, pattern in _COLUMN:
        name = F.regexp_extract("line", pattern, 1)
        found.append(F.when((F.col("language") == language) & (name != ""), F.struct(F.lit(evidence).alias("evidence"), name.alias("column"))))
    marks = delivered_lines(spark, folder).select("file_id", "line_no", *ROW, header.alias("name"), F.array_compact(F.array(*found)).alias("found"))
    placed = enclosing_header(from_current(marks.where("name <> '' OR size(found) > 0"), spark, folder), ["file_id"], F.col("name"))
    return placed.select("file_id", "line_no", F.col("header").alias("model"), F.inline("found"))


def _model_sql() -> str:
    parts = []
    for language, pattern in _MODEL.items():
        groups = ", ".join(f"nullif(regexp_extract(line, '{pattern}', {g}), '')" for g in range(1, 1 + pattern.count("(\\w+)")))
        parts.append(f"WHEN language = '{language}' THEN coalesce({groups}, NULL)")
    return "CASE " + " ".join(parts) + " END"


STORED = (
    FILES_SQL
    + f", m AS (SELECT file_id, line_no, language, line, last_value({_model_sql()} IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS model FROM lines), c AS ("
    + " UNION ALL ".join(
        f"SELECT file_id, line_no, model, '{e}' AS evidence, regexp_extract(line, '{p}', 1) AS \"column\" FROM m WHERE language = '{lang}'" for lang, e, p in _COLUMN
    )
    + ") SELECT * FROM c WHERE \"column\" <> ''"
)


def column_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct columns over all repositories: how many models and files declare each, by evidence."""
    return stored_columns(spark, folder).groupBy(F.lower("column").alias("column"), "evidence").agg(
        F.count_distinct("model").alias("models"), F.count_distinct("file_id").alias("files")
    )


CATALOG = STORED.replace("SELECT * FROM c WHERE", "SELECT lower(\"column\") AS \"column\", evidence, count(DISTINCT model) AS models, count(DISTINCT file_id) AS files FROM c WHERE") + " GROUP BY 1, 2"

_DEFINITION = r"^\s*(?:export\s+)?(?:public\s+)?(?:async\s+)?(?:function|def|func)\s+(\w+)\s*[<(]"
_CALL = r"(?:^|[^\w.])(?:await\s+|new\s+)?(\w+)\("


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = delivered_lines(spark, folder).select("scan_id", "path", "file_id", "line_no", *ROW, F.regexp_extract("line", _DEFINITION, 1).alias("name"))
    return from_current(rows.where("name <> ''"), spark, folder)


def unique_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose name is defined once in their scan: the ones a bare name can be resolved to."""
    d = definitions(spark, folder)
    n = F.count("*").over(Window.partitionBy("scan_id", "name"))
    return d.withColumn("_n", n).where("_n = 1").drop("_n")


UNIQUE = FILES_SQL + rf"""
, d AS (SELECT scan_id, path, file_id, line_no, regexp_extract(line, '{_DEFINITION}', 1) AS name FROM lines)
SELECT * FROM (SELECT * FROM d WHERE name <> '') QUALIFY count(*) OVER (PARTITION BY scan_id, name) = 1
"""


def nearest_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """For every name defined in several files of a scan, the three definitions nearest the first one by shared directories (top-k)."""
    d = definitions(spark, folder)
    first = d.groupBy("scan_id", "name").agg(F.min("path").alias("from_path"), F.count("*").alias("definitions")).where("definitions > 1")
    joined = d.join(first, ["scan_id", "name"])
    mine, theirs = F.split("path", "/"), F.split("from_path", "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(mine), F.size(theirs)) - 1), lambda n: F.slice(mine, F.lit(1), n) == F.slice(theirs, F.lit(1), n)))
    ranked = joined.withColumn("shared", F.when(F.least(F.size(mine), F.size(theirs)) > 1, shared).otherwise(0))
    top = top_per_group(ranked, ["scan_id", "name"], [F.desc("shared"), F.asc("path"), F.asc("line_no"), F.asc("file_id")], 3)
    return top.select("scan_id", "name", "path", "line_no", "shared", "rank")


NEAREST = FILES_SQL + rf"""
, d AS (SELECT * FROM (SELECT scan_id, path, file_id, line_no, regexp_extract(line, '{_DEFINITION}', 1) AS name FROM lines) WHERE name <> ''),
f AS (SELECT scan_id, name, min(path) AS from_path FROM d GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT d.*, len(list_filter(range(1, least(len(string_split(path, '/')), len(string_split(from_path, '/')))), lambda n: string_split(path, '/')[1:n] = string_split(from_path, '/')[1:n]))::INT AS shared
      FROM d JOIN f USING (scan_id, name))
SELECT scan_id, name, path, line_no, shared, row_number() OVER (PARTITION BY scan_id, name ORDER BY shared DESC, path, line_no, file_id)::INT AS rank FROM s QUALIFY rank <= 3
"""


def call_links(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by bare name linked to the function a scan defines under that name exactly once, counted per function."""
    rows = delivered_lines(spark, folder).select("scan_id", *ROW, F.explode(F.regexp_extract_all("line", F.lit(_CALL), F.lit(1))).alias("name"))
    rows = from_current(rows.groupBy("scan_id", "name", *ROW).agg(F.count("*").alias("n")), spark, folder)
    calls = rows.groupBy("scan_id", "name").agg(F.sum("n").alias("mentions"))
    return unique_definitions(spark, folder).join(calls, ["scan_id", "name"]).select("scan_id", "name", "path", "line_no", "mentions")


CALLS = FILES_SQL + rf"""
, d AS (SELECT * FROM (SELECT scan_id, path, file_id, line_no, regexp_extract(line, '{_DEFINITION}', 1) AS name FROM lines) WHERE name <> ''),
u AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY scan_id, name) = 1),
c AS (SELECT scan_id, name, count(*) AS mentions FROM (SELECT scan_id, unnest(regexp_extract_all(line, '{_CALL}', 1)) AS name FROM lines) GROUP BY ALL)
SELECT u.scan_id, u.name, u.path, u.line_no, c.mentions FROM u JOIN c USING (scan_id, name)
"""


def code_without_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Code lines per file once comments are blanked, beside all lines."""
    ship_package(spark)
    bare = delivered_files(spark, folder).select("file_id", "language", *ROW, without_comments(F.col("content"), F.col("language")).alias("content"))
    counted = exploded_lines(bare, ["file_id", "language", *ROW]).groupBy("file_id", "language", *ROW).agg(
        F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("code_lines")
    )
    return from_current(counted, spark, folder)


def component_population(spark: SparkSession, folder: str) -> DataFrame:
    """Components by type and subtype with all subtotals (cube)."""
    c = table(spark, folder, "components").select("component_id", "scan_id", "type", F.coalesce("sub_type", F.lit("none")).alias("sub_type")).dropDuplicates()
    return c.cube("type", "sub_type").agg(F.count("*").alias("components"), F.grouping_id().cast("int").alias("level")).select("type", "sub_type", "components", "level")


POPULATION = """
WITH c AS (SELECT DISTINCT component_id, scan_id, type, coalesce(sub_type, 'none') AS sub_type FROM components)
SELECT type, sub_type, count(*) AS components, grouping(type, sub_type)::INT AS level FROM c GROUP BY CUBE (type, sub_type)
"""

#: Flow kinds from a link's relation and file, tried in order (conditions as data).
_FLOW_RULES = [
    {"when": {"equals": ["relation", "flows_to"]}, "set": {"kind": {"const": "data"}}},
    {"when": {"allOf": [{"equals": ["relation", "calls"]}, {"regex": ["source_file", r"\.(go|java|cs)$"]}]}, "set": {"kind": {"const": "service_call"}}},
    {"when": {"anyOf": [{"equals": ["relation", "imports"]}, {"not": {"exists": "source_file"}}]}, "set": {"kind": {"const": "static"}}},
    {"when": {"notSet": "kind"}, "set": {"kind": {"lookup": ["relation", {"contains": "structure", "in_group": "structure", "calls": "call"}]}}},
]


def link_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Links by the kind an ordered list of rules gives them."""
    from lumenveil.plans.relation_queries import links

    kinds = apply_rules(links(spark, folder).select("link_id", "relation", "source_file"), _FLOW_RULES, ["kind"])
    return kinds.groupBy("kind", "relation").agg(F.count("*").alias("links"))


def _kinds_sql() -> str:
    from lumenveil.plans.relation_queries import LINKS_SQL

    return f"""WITH {LINKS_SQL}, k AS (SELECT relation, CASE WHEN relation = 'flows_to' THEN 'data' WHEN relation = 'calls' AND regexp_matches(coalesce(source_file, ''), '\\.(go|java|cs)$') THEN 'service_call'
 WHEN relation = 'imports' OR source_file IS NULL THEN 'static' WHEN relation IN ('contains', 'in_group') THEN 'structure' WHEN relation = 'calls' THEN 'call' END AS kind FROM links)
SELECT kind, relation, count(*) AS links FROM k GROUP BY ALL"""


def components_at_finish(spark: SparkSession, folder: str) -> DataFrame:
    """Components live when their scan finished (range join within the scan), with their confidence."""
    scans = table(spark, folder, "scan_payloads").groupBy("scan_id").agg(F.max(micros(F.col("finished_at"))).alias("at")).where("at IS NOT NULL")
    lived = table(spark, folder, "components").select("scan_id", "component_id", "confidence", micros(F.col("loaded_at")).alias("lo"), micros(F.col("removed_at")).alias("hi"))
    # one row per scan on the left: an equi-join with a residual range never multiplies
    live = (F.col("lo") <= F.col("at")) & (F.col("hi").isNull() | (F.col("at") < F.col("hi")))
    return lived.join(scans, "scan_id").where(live).select("scan_id", "component_id", "confidence")


AT_FINISH = """
WITH s AS (SELECT scan_id, max(epoch_us(finished_at)) AS t FROM scan_payloads GROUP BY scan_id)
SELECT c.scan_id, c.component_id, c.confidence FROM s JOIN components c ON c.scan_id = s.scan_id AND epoch_us(c.loaded_at) <= s.t AND (c.removed_at IS NULL OR s.t < epoch_us(c.removed_at))
"""

QUERIES = {
    "stored_columns": stored_columns,
    "column_catalog": column_catalog,
    "unique_definitions": unique_definitions,
    "nearest_definitions": nearest_definitions,
    "call_links": call_links,
    "code_without_comments": code_without_comments,
    "component_population": component_population,
    "link_kinds": link_kinds,
    "components_at_finish": components_at_finish,
}
SQL = {
    "stored_columns": STORED,
    "column_catalog": CATALOG,
    "unique_definitions": UNIQUE,
    "nearest_definitions": NEAREST,
    "call_links": CALLS,
    "component_population": POPULATION,
    "link_kinds": _kinds_sql(),
    "components_at_finish": AT_FINISH,
}
