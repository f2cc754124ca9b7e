"""Source trees as tables: every path with its outcome, the files that pass, and ignore rules.

Nothing is dropped on the way: a path that is not read keeps a row with the reason.  Budgets that depend on the order of a
directory walk are defined over the order of paths.
"""

from __future__ import annotations

import fnmatch
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenveil.functions.text import relative_path

#: File endings of the languages that are read (fixed values).
LANGUAGE_BY_ENDING = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "ipp": "cpp", "inl": "cpp", "h": "cpp",
    "cs": "csharp", "cshtml": "csharp", "razor": "csharp", "go": "go", "php": "php", "phtml": "php", "rs": "rust", "rb": "ruby", "swift": "swift", "prisma": "prisma",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "json": "json", "yaml": "yaml", "yml": "yaml", "tf": "terraform", "tfvars": "terraform",
}
#: Directories that are never entered (fixed values), besides hidden ones.
SKIPPED_DIRECTORIES = (
    "node_modules", "venv", ".venv", "site-packages", "vendor", "test", "tests", "__tests__", "__stories__", "e2e", "storybook-static", ".git", "dist", "build", ".next", "out",
    "coverage", ".vscode", ".idea", "obj", "cmake-build-debug", "cmake-build-release", "target",
)
MAX_FILE_BYTES = 2 * 1024 * 1024


def file_language(path: Column) -> Column:
    """Language by file ending; null when the ending is not read."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_ENDING.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_sensitive(path: Column) -> Column:
    """Environment files: ``.env`` and ``.env.*``."""
    return path.rlike(r"(^|/)\.env(\.[^/]*)?$")


def in_skipped_directory(path: Column) -> Column:
    directories = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(directories, lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRECTORIES))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; ``dir/**`` also covers ``dir`` itself."""
    pattern = pattern.strip().lstrip("./")
    if pattern.endswith("/**"):
        return glob_regex(pattern[:-3])[:-1] + "(/.*)?$"
    out = ["^"]
    at = 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out.append("(.*/)?")
            at += 3
        elif pattern.startswith("**", at):
            out.append(".*")
            at += 2
        elif pattern[at] == "*":
            out.append("[^/]*")
            at += 1
        elif pattern[at] == "?":
            out.append("[^/]")
            at += 1
        else:
            out.append(re.escape(pattern[at]))
            at += 1
    return "".join(out) + "$"


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of all ``.gitignore`` files: ``base, position, negated, dir_only, regex`` (the last matching rule of a path decides)."""
    rows = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select(
        F.regexp_replace("path", r"/?\.gitignore$", "").alias("base"), F.posexplode(F.split("content", r"\r?\n")).alias("position", "raw")
    )
    rows = rows.withColumn("rule", F.trim("raw")).where("rule <> '' AND NOT startswith(rule, '#')")
    bare = F.regexp_replace("rule", "^!", "")
    body = F.regexp_replace(F.regexp_replace(bare, "^/", ""), "/$", "")
    quoted = F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1")
    steps = [(r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(.*/)?"), ("\u0002", ".*")]
    regex = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1].replace("$", r"\$")), steps, quoted)
    return rows.select(
        "base", "position", F.col("rule").startswith("!").alias("negated"), bare.endswith("/").alias("dir_only"), F.concat(F.lit("^"), regex, F.lit("$")).alias("regex")
    )


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` with ``ignored``: the last matching rule by (depth of its directory, position), tried on the path and its directories.

    A path meets the rules of its ancestors through an equi-join on directories, so rules of other directories cost nothing.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = paths.select("path", F.explode(ancestors).alias("base")).join(rules, "base")
    below = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    inner = F.split(below, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(inner)), lambda n: F.array_join(F.slice(inner, F.lit(1), n), "/"))
    matched = met.withColumn("_tried", own).withColumn(
        "_hit", F.exists(F.col("_tried"), lambda p: F.rlike(p, F.col("regex")) & (~F.col("dir_only") | (p != below)))
    )
    last = matched.where("_hit").groupBy("path").agg(
        F.max_by(~F.col("negated"), F.struct(F.size(F.split("base", "/")), F.length("base"), "position")).alias("ignored")
    )
    return paths.join(last, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def path_outcomes(listing: DataFrame, exclude: list[str] | None = None, max_files: int = 20_000, max_total: int = 200 * 1024 * 1024, scope: list[str] | None = None) -> DataFrame:
    """``listing(path, size)`` with language and ``reason``: the first that applies, ``successfully_processed`` for files to read.

    ``ignored`` (as :func:`ignored_paths` gives it) is used where the listing has it.

    Budgets hold within each value of ``scope`` (one scan): files beyond ``max_files`` in path order, and files whose running size in path order passes ``max_total``.
    """
    patterns = [glob_regex(p) for p in exclude or []]
    excluded = reduce(lambda a, b: a | b, [F.col("path").rlike(p) for p in patterns], F.lit(False))
    rows = listing.withColumn("language", file_language(F.col("path")))
    ignored = F.coalesce(F.col("ignored"), F.lit(False)) if "ignored" in listing.columns else F.lit(False)
    reason = (
        F.when(in_skipped_directory(F.col("path")), "ignored_by_repository_default_policy")
        .when(is_sensitive(F.col("path")), "sensitive_path_exclusion")
        .when(excluded, "excluded_by_configured_policy")
        .when(ignored, "ignored_by_repository_default_policy")
        .when(F.col("language").isNull(), "unsupported_file_type_or_language")
        .when(F.col("size") > MAX_FILE_BYTES, "file_too_large")
    )
    rows = rows.withColumn("_first", reason)
    w = Window.partitionBy(*(scope or []), F.col("_first").isNull()).orderBy("path")
    budgeted = rows.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("size").over(w))
    late = F.when(F.col("_n") > max_files, "file_count_cap_reached").when(F.col("_sum") > max_total, "total_byte_cap_reached").otherwise("successfully_processed")
    return budgeted.withColumn("reason", F.coalesce("_first", late)).drop("_first", "_n", "_sum")


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``files(path, name, content, language, size)`` of a directory tree, paths relative to it.

    Bytes that are no UTF-8 are replaced.  A single file gives one row; anything else raises.
    """
    if "://" not in root and not os.path.exists(root):
        raise FileNotFoundError(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern != "*":
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.load(root)
    base = root if "://" in root else "file:" + os.path.abspath(root if os.path.isdir(root) else os.path.dirname(root))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    path = relative_path(F.substring(plain, F.lit(len(re.sub("^file:/+", "file:/", base.rstrip("/"))) + 2), F.length(plain)))
    return raw.select(
        path.alias("path"), F.regexp_extract(path, "([^/]+)$", 1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), file_language(path).alias("language"), F.col("length").alias("size")
    )


def schema_file_kind(path: Column) -> Column:
    """Kind of a schema or migration file: prisma, sql, rails, laravel; null for others."""
    return (
        F.when(path.rlike(r"\.prisma$"), "prisma")
        .when(path.rlike(r"(^|/)db/(schema\.rb|migrate/[^/]+\.rb)$"), "rails")
        .when(path.rlike(r"(^|/)database/migrations/[^/]+\.php$"), "laravel")
        .when(path.rlike(r"\.sql$"), "sql")
    )


def matches_any(path: str, patterns: list[str]) -> bool:
    """Driver-side test of one path, for options rather than data."""
    return any(re.match(glob_regex(p), path) or fnmatch.fnmatch(path, p) for p in patterns)
