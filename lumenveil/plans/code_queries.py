"""Queries over source files: lines, rules, shapes, imports, packages, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import camel_parts, identifier_tokens
from lumenveil.functions.lines import brace_delta, exploded_lines, is_comment_only
from lumenveil.functions.text import relative_path
from lumenveil.operators.history import latest
from lumenveil.operators.joins import longest_prefix_join
from lumenveil.operators.windows import context_counts, enclosing_header, running_depth
from lumenveil.plans.general_queries import PATH_SQL
from lumenveil.sources.rules import BARE_MAIL, CODE_SHAPES, PERSONAL_DATA_RULES, rule_hits, shape_hits
from lumenveil.tables import table
from lumenveil.workspace import Workspace


ROW = ["_file", "_row"]  # where a delivered row stands in the table


def delivered_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered row with its language in one spelling and its place in the table."""
    return table(spark, folder, "source_files").select(
        "file_id", "scan_id", "repo", relative_path(F.col("path")).alias("path"), F.lower(F.trim("language")).alias("language"), "content",
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
    )


def file_heads(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file_id, the last ingested, without its text: ids, path, language and place."""
    rows = table(spark, folder, "source_files").select(
        "file_id", "scan_id", "repo", relative_path(F.col("path")).alias("path"), F.lower(F.trim("language")).alias("language"), "ingested_at",
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
    )
    return latest(rows, ["file_id"], ["ingested_at", *ROW]).drop("ingested_at")


def from_current(found: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """What was taken from delivered rows, of each file's last row only.

    Texts are read where they lie; superseded rows are dropped from what was found in them, so no text is shuffled.
    """
    return found.join(file_heads(spark, folder).select(*ROW), ROW, "left_semi").drop(*ROW)


def delivered_lines(spark: SparkSession, folder: str) -> DataFrame:
    return exploded_lines(delivered_files(spark, folder), ["file_id", "scan_id", "repo", "path", "language", *ROW])


FILES_SQL = f"""
WITH files AS (
  SELECT file_id, scan_id, repo, {PATH_SQL.format(p='path')} AS path, lower(trim(language)) AS language, content FROM source_files
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1),
lines AS (
  SELECT file_id, scan_id, repo, path, language, unnest(regexp_split_to_array(content, '\\r?\\n')) AS line,
         generate_subscripts(regexp_split_to_array(content, '\\r?\\n'), 1)::INT AS line_no FROM files)
"""


def lines_by_language(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("line")
    per_file = delivered_lines(spark, folder).groupBy("language", "file_id", *ROW).agg(
        F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(is_comment_only(line)).alias("comments")
    )
    rows = from_current(per_file, spark, folder)
    return rows.groupBy("language").agg(
        F.count_distinct("file_id").alias("files"), F.sum("lines").alias("lines"), F.sum("blank").alias("blank"), F.sum("comments").alias("comments")
    )


LINES_BY_LANGUAGE = FILES_SQL + r"""
SELECT language, count(DISTINCT file_id) AS files, count(*) AS lines, count_if(trim(line, ' ') = '')::BIGINT AS blank,
       count_if(regexp_matches(trim(line, ' '), '^(//|#|/\*|\*|<!--|--)'))::BIGINT AS comments FROM lines GROUP BY language
"""


def personal_data_hits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per rule and line it matches."""
    return from_current(delivered_lines(spark, folder).select("file_id", "line_no", *ROW, F.inline(rule_hits(F.col("line")))), spark, folder)


def _rules_sql() -> str:
    parts = []
    for rule_id, category, label, pattern in PERSONAL_DATA_RULES:
        test = f"regexp_matches(line, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"
        if rule_id == "email":
            lists = "to|from|cc|bcc|reply_to|sender|recipients"
            kept = rf"regexp_replace(line, '(?i)\bmail(\s*)\.({lists})\b', ' \0 mail ', 'g')"
            test = rf"({test} OR regexp_matches(regexp_replace({kept}, '(?i)\bmail\b\s*(::|\(|\.)', '', 'g'), '(?i)\bmail\b'))"
        parts.append(f"SELECT file_id, line_no, '{rule_id}' AS rule_id, '{category}' AS category, '{label}' AS label, repo FROM lines WHERE {test}")
    return ", hits AS (" + "\nUNION ALL ".join(parts) + ")"


HITS = FILES_SQL + _rules_sql() + "\nSELECT file_id, line_no, rule_id, category, label FROM hits"


def personal_data_items(spark: SparkSession, folder: str) -> DataFrame:
    """Hits rolled up to one data item per rule."""
    hits = from_current(delivered_lines(spark, folder).select("file_id", "repo", "line_no", *ROW, F.inline(rule_hits(F.col("line")))), spark, folder)
    return hits.groupBy("rule_id", "category").agg(
        F.concat(F.lit("data_item:"), F.first("rule_id")).alias("item_key"),
        F.count("*").alias("occurrences"),
        F.count_distinct("file_id").alias("files"),
        F.count_distinct("repo").alias("repos"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
    )


ITEMS = FILES_SQL + _rules_sql() + """
SELECT rule_id, category, 'data_item:' || rule_id AS item_key, count(*) AS occurrences, count(DISTINCT file_id) AS files,
       count(DISTINCT repo) AS repos, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM hits GROUP BY rule_id, category
"""


def code_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes, database accesses, imports and log calls by line."""
    return from_current(delivered_lines(spark, folder).select("file_id", "line_no", *ROW, F.inline(shape_hits(F.col("line"), F.col("language")))), spark, folder)


SHAPES = (
    FILES_SQL
    + ", shapes AS ("
    + "\nUNION ALL ".join(
        f"SELECT file_id, line_no, '{k}' AS kind, '{d}' AS detail, regexp_extract(line, '{p.replace(chr(39), chr(39) * 2)}', 1) AS value FROM lines WHERE language IN ({', '.join(repr(x) for x in langs)})"
        for k, d, langs, p in CODE_SHAPES
    )
    + ")\nSELECT * FROM shapes WHERE value <> ''"
)


def identifier_words(spark: SparkSession, folder: str) -> DataFrame:
    """How often each word occurs in the identifiers of each language."""
    tokens = delivered_lines(spark, folder).select("language", *ROW, F.explode(identifier_tokens(F.col("line"))).alias("token"))
    tokens = from_current(tokens.groupBy("language", "token", *ROW).agg(F.count("*").alias("n")), spark, folder)
    # identical identifiers are counted before they are split
    counted = tokens.groupBy("language", "token").agg(F.sum("n").alias("n"))
    return counted.select("language", F.explode(camel_parts(F.col("token"))).alias("word"), "n").groupBy("language", "word").agg(F.sum("n").alias("n"))


WORDS = FILES_SQL + r"""
, t AS (SELECT language, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$-]*)', 1)) AS token FROM lines),
c AS (SELECT language, token, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT language, n, unnest(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(token, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
      '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-\s.]+', ' ', 'g'))), ' ')) AS word FROM c)
SELECT language, word, sum(n)::BIGINT AS n FROM w WHERE word <> '' GROUP BY ALL
"""

_HEADER = r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|static\s+|async\s+|final\s+)*(?:function|class|def|func|interface|type|namespace)\s+(\w+)"


def enclosing_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """For every line a personal-data rule matches, the nearest function or class header above it and its nesting depth."""
    line = F.col("line")
    marks = delivered_lines(spark, folder).select(
        "file_id", "line_no", *ROW, F.regexp_extract(line, _HEADER, 1).alias("name"), brace_delta(line).alias("delta"), (F.size(rule_hits(line)) > 0).alias("hit")
    )
    rows = enclosing_header(from_current(marks, spark, folder), ["file_id"], F.col("name"))
    return running_depth(rows, ["file_id"], F.col("delta")).where("hit").select("file_id", "line_no", "header_line", "header", F.col("depth").cast("int").alias("depth"))


SCOPES = FILES_SQL + _rules_sql() + rf"""
, h AS (SELECT file_id, line_no, nullif(regexp_extract(line, '{_HEADER}', 1), '') AS name,
        regexp_replace(line, '"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|`[^`]*`', '', 'g') AS bare FROM lines),
r AS (SELECT file_id, line_no,
        last_value(CASE WHEN name IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS header_line,
        last_value(name IGNORE NULLS) OVER w AS header,
        sum((length(bare) - length(replace(bare, '{{', ''))) - (length(bare) - length(replace(bare, '}}', '')))) OVER w AS depth
      FROM h WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT r.file_id, r.line_no, header_line, header, depth::INT AS depth FROM r SEMI JOIN hits USING (file_id, line_no)
"""


def context_density(spark: SparkSession, folder: str) -> DataFrame:
    """Per file, how dense personal data gets: the most matching lines within 15 lines of any matching line."""
    rows = from_current(delivered_lines(spark, folder).select("file_id", "line_no", *ROW, (F.size(rule_hits(F.col("line"))) > 0).alias("hit")), spark, folder)
    near = context_counts(rows, ["file_id"], F.col("hit"))
    return near.where("hit").groupBy("file_id").agg(F.max("nearby").alias("densest"), F.count("*").alias("hit_lines"))


DENSITY = FILES_SQL + _rules_sql() + """
, f AS (SELECT l.file_id, l.line_no, h.file_id IS NOT NULL AS hit FROM lines l LEFT JOIN (SELECT DISTINCT file_id, line_no FROM hits) h USING (file_id, line_no)),
n AS (SELECT file_id, hit, sum(hit::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS nearby FROM f)
SELECT file_id, max(nearby)::BIGINT AS densest, count(*) AS hit_lines FROM n WHERE hit GROUP BY file_id
"""


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Relative imports resolved to files of the same scan: the import graph."""
    known = file_heads(spark, folder).select("scan_id", "path", "language")
    source = delivered_lines(spark, folder).where(F.col("language").isin("typescript", "javascript"))
    spec = F.regexp_extract("line", r"(?:from\s+|require\(\s*)[\"'](\.{1,2}/[^\"']+)[\"']", 1)
    wanted = from_current(source.select("scan_id", "path", *ROW, spec.alias("spec")).where("spec <> ''"), spark, folder).dropDuplicates()
    wanted = Workspace(spark, "imports").put(wanted)  # read twice below, while the texts are read once
    folder_of = F.regexp_replace("path", "/?[^/]*$", "")
    target = relative_path(F.concat_ws("/", folder_of, F.col("spec")))
    tried = F.explode(F.array(*[F.concat(target, F.lit(e)) for e in ("", ".ts", ".js", "/index.ts", "/index.js")]))
    candidates = wanted.select("scan_id", "path", "spec", tried.alias("target"))
    hit = candidates.join(known.select("scan_id", F.col("path").alias("target")).dropDuplicates(), ["scan_id", "target"], "left_semi")
    resolved = hit.groupBy("scan_id", "path", "spec").agg(F.min(F.struct(F.length("target").alias("n"), "target"))["target"].alias("target"))
    return wanted.join(resolved, ["scan_id", "path", "spec"], "left")


IMPORTS = FILES_SQL + rf"""
, w AS (SELECT DISTINCT scan_id, path, regexp_extract(line, '(?:from\s+|require\(\s*)["''](\.{{1,2}}/[^"'']+)["'']', 1) AS spec FROM lines WHERE language IN ('typescript', 'javascript')),
t AS (SELECT scan_id, path, spec, {PATH_SQL.format(p="concat(regexp_replace(path, '/?[^/]*$', ''), '/', spec)")} AS base FROM w WHERE spec <> ''),
c AS (SELECT scan_id, path, spec, base || e AS target FROM t, (VALUES (''), ('.ts'), ('.js'), ('/index.ts'), ('/index.js')) AS x(e)),
h AS (SELECT c.* FROM c SEMI JOIN files f ON f.scan_id = c.scan_id AND f.path = c.target)
SELECT t.scan_id, t.path, t.spec, (SELECT min_by(target, length(target)) FROM h WHERE h.scan_id = t.scan_id AND h.path = t.path AND h.spec = t.spec) AS target FROM t
"""


def locked_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages pinned by lock files, from both JSON and YAML forms, with how many repositories pin each version."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    locks = delivered_files(spark, folder).where(name.isin("package-lock.json", "pnpm-lock.yaml"))
    json_form = F.transform(
        F.regexp_extract_all("content", F.lit(r"\"node_modules/([^\"]+)\":\s*\{\s*\"version\":\s*\"([^\"]+)\""), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, r"node_modules/([^\"]+)\"", 1).alias("package"), F.regexp_extract(m, r"\"version\":\s*\"([^\"]+)\"", 1).alias("version")),
    )
    yaml_form = F.transform(
        F.regexp_extract_all("content", F.lit(r"(?m)^  (@?[\w./-]+@\d[\w.+-]*):"), F.lit(1)),
        lambda m: F.struct(F.regexp_extract(m, "^(.+)@[^@]+$", 1).alias("package"), F.regexp_extract(m, "@([^@]+)$", 1).alias("version")),
    )
    found = from_current(locks.select("repo", *ROW, F.inline(F.when(F.col("path").endswith(".json"), json_form).otherwise(yaml_form))), spark, folder)
    return found.groupBy("package", "version").agg(F.count_distinct("repo").alias("repos"))


LOCKED = FILES_SQL + r"""
, j AS (SELECT repo, unnest(regexp_extract_all(content, '"node_modules/([^"]+)":\s*\{\s*"version":\s*"([^"]+)"', 0)) AS m FROM files WHERE path LIKE '%package-lock.json' AND regexp_matches(path, '(^|/)package-lock\.json$')),
y AS (SELECT repo, unnest(regexp_extract_all(content, '(?m)^  (@?[\w./-]+@\d[\w.+-]*):', 1)) AS m FROM files WHERE regexp_matches(path, '(^|/)pnpm-lock\.yaml$')),
p AS (SELECT repo, regexp_extract(m, 'node_modules/([^"]+)"', 1) AS package, regexp_extract(m, '"version":\s*"([^"]+)"', 1) AS version FROM j
      UNION ALL SELECT repo, regexp_extract(m, '^(.+)@[^@]+$', 1), regexp_extract(m, '@([^@]+)$', 1) FROM y)
SELECT package, version, count(DISTINCT repo) AS repos FROM p GROUP BY package, version
"""


def sections(listed: DataFrame) -> DataFrame:
    """Sections of a scan: directories with a manifest, and every top-level directory."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    manifest = F.col("path").rlike(r"(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|go\.mod|pom\.xml|pyproject\.toml|[^/]+\.csproj)$")
    by_manifest = listed.where(manifest).select("scan_id", directory.alias("dir"))
    top = listed.where(F.instr("path", "/") > 0).select("scan_id", F.substring_index("path", "/", 1).alias("dir"))
    return by_manifest.unionByName(top).dropDuplicates().withColumn("section", F.when(F.col("dir") == "", "root").otherwise(F.col("dir")))


def listed_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "scan_payloads").select("scan_id", F.explode("files_scanned").alias("_p"))
    return paths.select("scan_id", relative_path(F.col("_p")).alias("path")).where("path IS NOT NULL").dropDuplicates()


def file_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed path with its nearest section (longest prefix)."""
    listed = listed_paths(spark, folder)
    return longest_prefix_join(listed, sections(listed), ["scan_id"], "path", "dir", "section")


LISTED_SQL = f"WITH listed AS (SELECT DISTINCT scan_id, {PATH_SQL.format(p='p')} AS path FROM (SELECT scan_id, unnest(files_scanned) AS p FROM scan_payloads) WHERE p IS NOT NULL AND p <> '')"
SECTIONS = LISTED_SQL + r"""
, s AS (SELECT scan_id, regexp_replace(path, '/?[^/]*$', '') AS dir FROM listed WHERE regexp_matches(path, '(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|go\.mod|pom\.xml|pyproject\.toml|[^/]+\.csproj)$')
        UNION SELECT scan_id, split_part(path, '/', 1) FROM listed WHERE path LIKE '%/%')
SELECT l.scan_id, l.path, max_by(CASE WHEN s.dir = '' THEN 'root' ELSE s.dir END, length(s.dir)) AS section
FROM listed l LEFT JOIN s ON s.scan_id = l.scan_id AND (s.dir = '' OR starts_with(l.path, s.dir || '/')) GROUP BY l.scan_id, l.path
"""


def unread_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Listed paths without a source row, counted per section role and file ending (anti-join)."""
    listed = listed_paths(spark, folder)
    absent = listed.join(file_heads(spark, folder).select("scan_id", "path"), ["scan_id", "path"], "left_anti")
    return absent.groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ending")).agg(F.count("*").alias("paths"), F.count_distinct("scan_id").alias("scans"))


UNREAD = FILES_SQL + "," + LISTED_SQL[len("WITH "):] + r"""
SELECT regexp_extract(path, '\.([^./]+)$', 1) AS ending, count(*) AS paths, count(DISTINCT scan_id) AS scans
FROM (SELECT * FROM listed ANTI JOIN files USING (scan_id, path)) GROUP BY 1
"""

QUERIES = {
    "lines_by_language": lines_by_language,
    "personal_data_hits": personal_data_hits,
    "personal_data_items": personal_data_items,
    "code_shapes": code_shapes,
    "identifier_words": identifier_words,
    "enclosing_scopes": enclosing_scopes,
    "context_density": context_density,
    "import_edges": import_edges,
    "locked_packages": locked_packages,
    "file_sections": file_sections,
    "unread_paths": unread_paths,
}
SQL = {
    "lines_by_language": LINES_BY_LANGUAGE,
    "personal_data_hits": HITS,
    "personal_data_items": ITEMS,
    "code_shapes": SHAPES,
    "identifier_words": WORDS,
    "enclosing_scopes": SCOPES,
    "context_density": DENSITY,
    "import_edges": IMPORTS,
    "locked_packages": LOCKED,
    "file_sections": SECTIONS,
    "unread_paths": UNREAD,
}
