"""Queries of catalog detectors, identifier aliases and navigation over source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import camel_parts, identifier_tokens, service_key
from lumenveil.functions.lines import is_comment_only
from lumenveil.functions.text import is_contract_path, typed_flow_key
from lumenveil.operators.joins import longest_prefix_join
from lumenveil.operators.windows import enclosing_header
from lumenveil.plans.code_queries import FILES_SQL, LISTED_SQL, ROW, _HEADER, delivered_lines, file_heads, from_current, listed_paths, sections
from lumenveil.sources.aliases import ACTION_WORDS, ADDRESS_DECLARED, ALIASES, alias_rule
from lumenveil.sources.detectors import DETECTORS, detector_hits, group_count
from lumenveil.sources.files import LANGUAGE_BY_ENDING, MAX_FILE_BYTES, SKIPPED_DIRECTORIES, path_outcomes
from lumenveil.tables import table

KINDS = ("database", "auth", "config", "route", "external", "handler")


def detected(spark: SparkSession, folder: str, kinds: tuple[str, ...], *extra: str) -> DataFrame:
    lines = delivered_lines(spark, folder)
    hits = lines.select("file_id", "line_no", *extra, *ROW, F.inline(detector_hits(F.col("line"), F.col("language"), kinds)))
    return from_current(hits, spark, folder)


def _detector(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return detected(spark, folder, (kind,))

    query.__doc__ = f"Findings of kind {kind} by file and line, of every language's rules."
    return query


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _detected_sql(kinds: tuple[str, ...]) -> str:
    parts = []
    for kind, technology, languages, pattern in DETECTORS:
        if kind in kinds:
            groups = ", ".join(f"nullif(regexp_extract(line, '{_quoted(pattern)}', {g}), '')" for g in range(1, group_count(pattern) + 1))
            parts.append(f"SELECT file_id, line_no, scan_id, path, '{kind}' AS kind, '{technology}' AS technology, coalesce({groups}, NULL) AS value FROM lines WHERE language IN ({', '.join(repr(x) for x in languages)})")
    return "hit AS (SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


def detector_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Findings, files and distinct values per kind, technology and language."""
    rows = detected(spark, folder, KINDS, "language")
    return rows.groupBy("kind", "technology", "language").agg(F.count("*").alias("findings"), F.count_distinct("file_id").alias("files"), F.count_distinct("value").alias("values"))


TOTALS = FILES_SQL + ", " + _detected_sql(KINDS).replace("scan_id, path, '", "language, '") + "\nSELECT kind, technology, language, count(*) AS findings, count(DISTINCT file_id) AS files, count(DISTINCT value) AS \"values\" FROM hit GROUP BY ALL"


def section_apis(spark: SparkSession, folder: str) -> DataFrame:
    """One API node per section of a scan that declares routes: the section's routes, files and first path (longest prefix)."""
    routes = detected(spark, folder, ("route",), "scan_id", "path")
    listed = listed_paths(spark, folder)
    placed = longest_prefix_join(routes, sections(listed), ["scan_id"], "path", "dir", "section")
    return placed.where("section IS NOT NULL").groupBy("scan_id", "section").agg(F.count("*").alias("routes"), F.count_distinct("path").alias("files"), F.min("value").alias("first_route"))


_SECTION_CTE = r"""
s AS (SELECT scan_id, regexp_replace(path, '/?[^/]*$', '') AS dir FROM listed WHERE regexp_matches(path, '(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|go\.mod|pom\.xml|pyproject\.toml|[^/]+\.csproj)$')
      UNION SELECT scan_id, split_part(path, '/', 1) FROM listed WHERE path LIKE '%/%')"""
APIS = FILES_SQL + ", " + LISTED_SQL[len("WITH "):] + "," + _SECTION_CTE + ", " + _detected_sql(("route",)) + r"""
, p AS (SELECT h.scan_id, h.path, h.line_no, h.value, max_by(CASE WHEN s.dir = '' THEN 'root' ELSE s.dir END, length(s.dir)) AS section
        FROM hit h JOIN s ON s.scan_id = h.scan_id AND (s.dir = '' OR starts_with(h.path, s.dir || '/')) GROUP BY h.scan_id, h.path, h.file_id, h.line_no, h.value)
SELECT scan_id, section, count(*) AS routes, count(DISTINCT path) AS files, min(value) AS first_route FROM p GROUP BY ALL
"""


def route_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Client calls by literal path joined with the routes that declare it in the same scan; calls without one stay, with no route."""
    found = detected(spark, folder, ("route", "external"), "scan_id", "path")
    calls = found.where("kind = 'external'").select("scan_id", F.col("path").alias("caller"), F.regexp_replace("value", r"[?#].*$", "").alias("route")).groupBy("scan_id", "caller", "route").agg(F.count("*").alias("calls"))
    routes = found.where("kind = 'route'").groupBy("scan_id", F.col("value").alias("route")).agg(F.min("path").alias("declared_in"), F.count("*").alias("declarations"))
    return calls.join(routes, ["scan_id", "route"], "left")


ROUTE_CALLS = FILES_SQL + ", " + _detected_sql(("route", "external")) + r"""
, c AS (SELECT scan_id, path AS caller, regexp_replace(value, '[?#].*$', '') AS route, count(*) AS calls FROM hit WHERE kind = 'external' GROUP BY ALL),
r AS (SELECT scan_id, value AS route, min(path) AS declared_in, count(*) AS declarations FROM hit WHERE kind = 'route' GROUP BY ALL)
SELECT * FROM c LEFT JOIN r USING (scan_id, route)
"""


def alias_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers that stand for a personal-data rule by their last words, once per line."""
    line = F.col("line")
    tokens = delivered_lines(spark, folder).select("file_id", "line_no", "line", *ROW, F.explode(F.array_distinct(identifier_tokens(line))).alias("token"))
    hits = tokens.select("file_id", "line_no", *ROW, "token", alias_rule(F.col("token"), line).alias("rule_id")).where("rule_id IS NOT NULL")
    return from_current(hits, spark, folder)


_WORDS_SQL = r"""list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(token, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-\s.]+', ' ', 'g'))), ' '), lambda x: x <> '')"""
_ALIAS_CTE = rf"""
alias(name, rule_id) AS (VALUES {', '.join(f"('{a}', '{r}')" for a, r in ALIASES.items())}),
tok AS (SELECT DISTINCT file_id, line_no, line, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$-]*)', 1)) AS token FROM lines),
wrd AS (SELECT *, {_WORDS_SQL} AS w FROM tok),
ali AS (SELECT wrd.*, coalesce(a3.rule_id, a2.rule_id, a1.rule_id) AS rule_id FROM wrd
  LEFT JOIN alias a3 ON len(w) >= 3 AND a3.name = array_to_string(w[-3:], '_')
  LEFT JOIN alias a2 ON len(w) >= 2 AND a2.name = array_to_string(w[-2:], '_')
  LEFT JOIN alias a1 ON len(w) >= 1 AND a1.name = w[-1]),
hit AS (SELECT file_id, line_no, token, rule_id FROM ali WHERE rule_id IS NOT NULL AND NOT (len(w) > 1 AND w[1] IN ({', '.join(f"'{x}'" for x in ACTION_WORDS)}))
  AND NOT (rule_id = 'address' AND (len(w) > 1 OR NOT regexp_matches(line, '{ADDRESS_DECLARED}'))))"""
ALIAS_HITS = FILES_SQL + "," + _ALIAS_CTE + "\nSELECT * FROM hit"

#: Declarations of a name: variable, field or parameter forms of the languages; one group is the name.
DECLARATION = r"(?:\b(?:const|let|var|val)\s+|\b(?:String|string|int|long|varchar|text)\s+|^\s+(?:public\s+|private\s+|readonly\s+)*)([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:[:=;?]|$)"


def declaration_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Alias hits grouped by the declaration they belong to: the last declaration of the identifier at or above the hit in its file.

    Hits of one file, identifier and declaring line form a group; hits without a declaration above are grouped by their identifier alone.
    """
    line = F.col("line")
    marks = delivered_lines(spark, folder).select("file_id", "line_no", *ROW, F.regexp_extract(line, DECLARATION, 1).alias("token")).where("token <> ''")
    declared = from_current(marks, spark, folder).select("file_id", "token", "line_no", F.lit(None).cast("string").alias("rule_id"))
    both = declared.unionByName(alias_hits(spark, folder).select("file_id", "token", "line_no", "rule_id"))
    w = Window.partitionBy("file_id", "token").orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("declared_line", F.max(F.when(F.col("rule_id").isNull(), F.col("line_no"))).over(w)).where("rule_id IS NOT NULL")
    return placed.groupBy("file_id", "token", "rule_id", "declared_line").agg(F.count("*").alias("occurrences"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


GROUPS = FILES_SQL + "," + _ALIAS_CTE + rf"""
, d AS (SELECT file_id, regexp_extract(line, '{DECLARATION}', 1) AS token, line_no FROM lines),
g AS (SELECT h.*, (SELECT max(d.line_no) FROM d WHERE d.file_id = h.file_id AND d.token = h.token AND d.token <> '' AND d.line_no <= h.line_no) AS declared_line FROM hit h)
SELECT file_id, token, rule_id, declared_line, count(*) AS occurrences, min(line_no) AS first_line, max(line_no) AS last_line FROM g GROUP BY ALL
"""


def file_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and classes of every file with the lines they reach to: up to the next header, or the file's end."""
    lines = delivered_lines(spark, folder)
    marks = from_current(lines.select("file_id", "line_no", *ROW, F.regexp_extract("line", _HEADER, 1).alias("name")).where("name <> ''"), spark, folder)
    ends = from_current(lines.groupBy("file_id", *ROW).agg(F.max("line_no").alias("last")), spark, folder)
    w = Window.partitionBy("file_id").orderBy("line_no")
    rows = marks.withColumn("_next", F.lead("line_no").over(w)).join(ends, "file_id")
    return rows.select("file_id", "name", F.col("line_no").alias("from_line"), F.coalesce(F.col("_next") - 1, "last").alias("to_line"))


OUTLINE = FILES_SQL + rf"""
, h AS (SELECT file_id, line_no, regexp_extract(line, '{_HEADER}', 1) AS name, max(line_no) OVER (PARTITION BY file_id) AS last FROM lines)
SELECT file_id, name, line_no AS from_line, coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no) - 1, last)::INT AS to_line FROM h WHERE name <> ''
"""

_CALLED = r"([A-Za-z_]\w*)\("


def caller_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Who calls what inside one file: functions of the file called below another header of it, counted."""
    lines = delivered_lines(spark, folder)
    marks = lines.select("file_id", "line_no", *ROW, F.regexp_extract("line", _HEADER, 1).alias("name"), F.regexp_extract_all("line", F.lit(_CALLED), F.lit(1)).alias("called"))
    rows = enclosing_header(from_current(marks.where("name <> '' OR size(called) > 0"), spark, folder), ["file_id"], F.col("name"))
    calls = rows.where("header IS NOT NULL AND name = ''").select("file_id", F.col("header").alias("caller"), F.explode("called").alias("callee"))
    own = rows.where("name <> ''").select("file_id", F.col("name").alias("callee")).dropDuplicates()
    return calls.join(own, ["file_id", "callee"]).groupBy("file_id", "caller", "callee").agg(F.count("*").alias("calls"))


CALLERS = FILES_SQL + rf"""
, h AS (SELECT file_id, line_no, regexp_extract(line, '{_HEADER}', 1) AS name, regexp_extract_all(line, '{_CALLED}', 1) AS called FROM lines),
r AS (SELECT *, last_value(nullif(name, '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS caller FROM h),
c AS (SELECT file_id, caller, unnest(called) AS callee FROM r WHERE caller IS NOT NULL AND name = '')
SELECT file_id, caller, callee, count(*) AS calls FROM c SEMI JOIN (SELECT file_id, name AS callee FROM h WHERE name <> '') USING (file_id, callee) GROUP BY ALL
"""


def symbol_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Names a scan defines, with the lines and files of the scan that mention them."""
    lines = delivered_lines(spark, folder)
    named = from_current(lines.select("scan_id", *ROW, F.regexp_extract("line", _HEADER, 1).alias("name")).where("name <> ''"), spark, folder)
    tokens = lines.select("scan_id", "file_id", "line_no", *ROW, F.explode(F.array_distinct(identifier_tokens(F.col("line")))).alias("name"))
    # only mentions of defined names go on
    used = tokens.join(named.dropDuplicates(), ["scan_id", "name"], "left_semi")
    return from_current(used, spark, folder).groupBy("scan_id", "name").agg(F.count("*").alias("mentions"), F.count_distinct("file_id").alias("files"))


USES = FILES_SQL + rf"""
, n AS (SELECT DISTINCT scan_id, regexp_extract(line, '{_HEADER}', 1) AS name FROM lines),
t AS (SELECT DISTINCT scan_id, file_id, line_no, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$-]*)', 1)) AS name FROM lines)
SELECT scan_id, name, count(*) AS mentions, count(DISTINCT file_id) AS files FROM t SEMI JOIN (SELECT * FROM n WHERE name <> '') USING (scan_id, name) GROUP BY ALL
"""

_QUERIED = r"(?i)\b(?:from|into|update|join)\s+([a-z_]+_[a-z_]+)\b"


def queried_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables named in SQL text inside sources, with how often and where."""
    found = delivered_lines(spark, folder).select("repo", "file_id", "language", *ROW, F.explode(F.regexp_extract_all("line", F.lit(_QUERIED), F.lit(1))).alias("table"))
    return from_current(found, spark, folder).groupBy("language", F.lower("table").alias("table")).agg(F.count("*").alias("mentions"), F.count_distinct("file_id").alias("files"), F.count_distinct("repo").alias("repos"))


TABLES = FILES_SQL + rf"""
, t AS (SELECT repo, file_id, language, unnest(regexp_extract_all(line, '{_QUERIED}', 1)) AS tab FROM lines)
SELECT language, lower(tab) AS "table", count(*) AS mentions, count(DISTINCT file_id) AS files, count(DISTINCT repo) AS repos FROM t GROUP BY 1, 2
"""

_IMPORTED = r"(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)[\"'](@?[A-Za-z][^\"']*)[\"']"


def third_party_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Packages imported from outside the repository (not by relative path), scope and name only, per repository."""
    found = delivered_lines(spark, folder).where(F.col("language").isin("typescript", "javascript")).select("repo", "file_id", *ROW, F.regexp_extract("line", _IMPORTED, 1).alias("spec")).where("spec <> ''")
    package = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return from_current(found, spark, folder).groupBy("repo", package.alias("package")).agg(F.count("*").alias("imports"), F.count_distinct("file_id").alias("files"))


THIRD = FILES_SQL + rf"""
, t AS (SELECT repo, file_id, regexp_extract(line, '{_quoted(_IMPORTED)}', 1) AS spec FROM lines WHERE language IN ('typescript', 'javascript'))
SELECT repo, regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, count(*) AS imports, count(DISTINCT file_id) AS files FROM t WHERE spec <> '' GROUP BY 1, 2
"""

_URL = r"(https?://[^\s\"'`<>)\]]+)"


def url_services(spark: SparkSession, folder: str) -> DataFrame:
    """Literal URLs of documents by the service their host belongs to, and whether they are public."""
    urls = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_URL), F.lit(1))).alias("url"))
    urls = urls.withColumn("host", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).where("host <> ''")
    return urls.groupBy(service_key(F.col("host")).alias("service")).agg(F.count("*").alias("urls"), F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.lower("host")).alias("hosts"))


URLS = rf"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_quoted(_URL)}', 1)) AS url FROM documents),
h AS (SELECT doc_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM u),
s AS (SELECT doc_id, host, string_split(regexp_replace(host, '^www\.', ''), '.') AS l FROM h WHERE host <> '')
SELECT array_to_string(l[greatest(len(l) - 1, 1):], '.') AS service, count(*) AS urls, count(DISTINCT doc_id) AS documents, count(DISTINCT host) AS hosts FROM s GROUP BY 1
"""


def scan_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan does with each delivered path: read, or the first reason not to; budgets hold per scan, in path order."""
    rows = file_heads(spark, folder).join(table(spark, folder, "source_files").select("file_id", "size").groupBy("file_id").agg(F.max("size").alias("size")), "file_id")
    listing = rows.where("path IS NOT NULL").groupBy("scan_id", "path").agg(F.max("size").alias("size"))
    return path_outcomes(listing, max_files=40, max_total=60_000, scope=["scan_id"]).groupBy("reason", "language").agg(F.count("*").alias("paths"), F.sum("size").alias("bytes"))


OUTCOMES = FILES_SQL + rf"""
, ending(e, language) AS (VALUES {', '.join(f"('{e}', '{lang}')" for e, lang in LANGUAGE_BY_ENDING.items())}),
sz AS (SELECT file_id, max(size) AS size FROM source_files GROUP BY 1),
l AS (SELECT scan_id, path, max(size) AS size FROM files JOIN sz USING (file_id) WHERE path <> '' GROUP BY ALL),
r AS (SELECT l.*, ending.language, string_split(path, '/')[1:-2] AS dirs,
        CASE WHEN len(list_filter(string_split(path, '/')[1:-2], lambda d: d LIKE '.%' OR d IN ({', '.join(f"'{d}'" for d in SKIPPED_DIRECTORIES)}))) > 0 THEN 'ignored_by_repository_default_policy'
             WHEN regexp_matches(path, '(^|/)\.env(\.[^/]*)?$') THEN 'sensitive_path_exclusion'
             WHEN ending.language IS NULL THEN 'unsupported_file_type_or_language'
             WHEN size > {MAX_FILE_BYTES} THEN 'file_too_large' END AS first
      FROM l LEFT JOIN ending ON ending.e = lower(regexp_extract(path, '\.([^./]+)$', 1))),
b AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS total FROM r WINDOW w AS (PARTITION BY scan_id, first IS NULL ORDER BY path ROWS UNBOUNDED PRECEDING))
SELECT coalesce(first, CASE WHEN n > 40 THEN 'file_count_cap_reached' WHEN total > 60000 THEN 'total_byte_cap_reached' ELSE 'successfully_processed' END) AS reason, language,
       count(*) AS paths, sum(size)::BIGINT AS bytes FROM b GROUP BY ALL
"""


def link_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Typed keys of the code graph's links, taken apart again: how many links join each pair of kinds, and how many keys do not parse."""
    links = table(spark, folder, "graph_links").select("link_id", "source", "target").dropDuplicates()
    key = F.concat(F.lit("flow:asset:"), F.trim("source"), F.lit("->third_party:"), F.trim("target"))
    parts = links.select("link_id", typed_flow_key(key).alias("k"))
    return parts.groupBy(F.col("k.source_type").alias("source_type"), F.col("k.target_type").alias("target_type")).agg(F.count("*").alias("links"), F.count_distinct("k.source").alias("sources"), F.count_distinct("k.target").alias("targets"))


LINK_KEYS = r"""
WITH l AS (SELECT DISTINCT link_id, source, target FROM graph_links),
k AS (SELECT link_id, 'flow:asset:' || trim(source) || '->third_party:' || trim(target) AS key FROM l),
p AS (SELECT regexp_extract(key, '^flow:(asset|third_party|actor):(.+?)->(asset|third_party|actor):(.+)$', ['a', 's', 'b', 't']) AS k, regexp_matches(key, '^flow:(asset|third_party|actor):(.+?)->(asset|third_party|actor):(.+)$') AS ok FROM k)
SELECT CASE WHEN ok THEN k.a END AS source_type, CASE WHEN ok THEN k.b END AS target_type, count(*) AS links,
       count(DISTINCT CASE WHEN ok THEN k.s END) AS sources, count(DISTINCT CASE WHEN ok THEN k.t END) AS targets FROM p GROUP BY 1, 2
"""


def path_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of hit paths: how many keep the contract of relative forward-slash paths, by their ending."""
    paths = table(spark, folder, "pii_hits").select("hit_id", "file_path").dropDuplicates()
    return paths.groupBy(F.regexp_extract("file_path", r"\.([^./\\]+)$", 1).alias("ending"), is_contract_path(F.col("file_path")).alias("valid")).agg(F.count("*").alias("hits"))


CONTRACTS = r"""
WITH p AS (SELECT DISTINCT hit_id, file_path FROM pii_hits)
SELECT regexp_extract(file_path, '\.([^./\\]+)$', 1) AS ending,
       coalesce(NOT (regexp_matches(file_path, '^$|^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|//|/$') OR contains(file_path, chr(0))), false) AS valid, count(*) AS hits FROM p GROUP BY 1, 2
"""


def comment_words(spark: SparkSession, folder: str) -> DataFrame:
    """Text of comment lines without their marks: lines and words per language."""
    line = F.trim("line")
    text = F.trim(F.regexp_replace(line, r"^(//+|#+|/\*+|\*+/?|<!--|--+)|(\*/|-->)$", ""))
    found = delivered_lines(spark, folder).where(is_comment_only(F.col("line"))).select("language", *ROW, F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("n"))
    return from_current(found.groupBy("language", *ROW).agg(F.count("*").alias("lines"), F.sum("n").alias("words")), spark, folder).groupBy("language").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"))


COMMENTS = FILES_SQL + r"""
, c AS (SELECT language, trim(regexp_replace(trim(line, ' '), '^(//+|#+|/\*+|\*+/?|<!--|--+)|(\*/|-->)$', '', 'g'), ' ') AS t FROM lines WHERE regexp_matches(trim(line, ' '), '^(//|#|/\*|\*|<!--|--)'))
SELECT language, count(*) AS lines, sum(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')))::BIGINT AS words FROM c GROUP BY 1
"""


def component_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Component names in one spelling with the title to show, and how many components and scans carry them."""
    rows = table(spark, folder, "components").select("component_id", "scan_id", camel_parts(F.col("name")).alias("words")).where("size(words) > 0").dropDuplicates()
    title = F.array_join(F.transform("words", lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return rows.groupBy(F.array_join("words", "-").alias("slug"), title.alias("title")).agg(F.count_distinct("component_id").alias("components"), F.count_distinct("scan_id").alias("scans"))


TITLES = rf"""
WITH t AS (SELECT component_id, scan_id, {_WORDS_SQL.replace('(token,', '(name,')} AS w FROM components)
SELECT array_to_string(w, '-') AS slug, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS title, count(DISTINCT component_id) AS components, count(DISTINCT scan_id) AS scans
FROM t WHERE len(w) > 0 GROUP BY 1, 2
"""

QUERIES = {
    **{f"detected_{kind}": _detector(kind) for kind in KINDS},
    "detector_totals": detector_totals, "section_apis": section_apis, "route_calls": route_calls, "alias_hits": alias_hits, "declaration_groups": declaration_groups,
    "file_outline": file_outline, "caller_edges": caller_edges, "symbol_uses": symbol_uses, "queried_tables": queried_tables, "third_party_imports": third_party_imports,
    "url_services": url_services, "scan_outcomes": scan_outcomes, "link_keys": link_keys, "path_contracts": path_contracts, "comment_words": comment_words, "component_titles": component_titles,
}
SQL = {
    **{f"detected_{kind}": FILES_SQL + ", " + _detected_sql((kind,)) + "\nSELECT file_id, line_no, kind, technology, value FROM hit" for kind in KINDS},
    "detector_totals": TOTALS, "section_apis": APIS, "route_calls": ROUTE_CALLS, "alias_hits": ALIAS_HITS, "declaration_groups": GROUPS,
    "file_outline": OUTLINE, "caller_edges": CALLERS, "symbol_uses": USES, "queried_tables": TABLES, "third_party_imports": THIRD,
    "url_services": URLS, "scan_outcomes": OUTCOMES, "link_keys": LINK_KEYS, "path_contracts": CONTRACTS, "comment_words": COMMENTS, "component_titles": TITLES,
}
