"""Declared packages of manifests, with the lines they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.functions.lines import exploded_lines

#: Manifest kinds (fixed values): ecosystem, file name pattern, section that must enclose a line (or none), line pattern with the name.
LINE_FORMS: list[tuple[str, str, str | None, str]] = [
    ("python", r"(^|/)requirements[^/]*\.txt$", None, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[<>=!~;@]|$)"),
    ("python", r"(^|/)Pipfile$", r"^\[(?:dev-)?packages\]", r"^\s*\"?([A-Za-z0-9][A-Za-z0-9._-]*)\"?\s*="),
    ("python", r"(^|/)pyproject\.toml$", r"^\[tool\.poetry(?:\.group\.[\w-]+)?\.(?:dev-)?dependencies\]", r"^\s*\"?([A-Za-z0-9][A-Za-z0-9._-]*)\"?\s*="),
    ("go", r"(^|/)go\.mod$", None, r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]{2,}/\S+)\s+v\d"),
    ("jvm", r"(^|/)build\.gradle(\.kts)?$", None, r"^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt|annotationProcessor)\s*\(?\s*[\"']([^\"':]+:[^\"':]+)"),
    ("dotnet", r"\.(cs|fs|vb)proj$", None, r"<PackageReference\s+[^>]*Include=\"([^\"]+)\""),
    ("dotnet", r"(^|/)packages\.config$", None, r"<package\s+[^>]*id=\"([^\"]+)\""),
    ("dotnet", r"(^|/)paket\.dependencies$", None, r"^\s*nuget\s+(\S+)"),
    ("cpp", r"(^|/)conanfile\.(txt|py)$", None, r"^\s*(?:self\.requires\(\s*[\"'])?([a-z0-9_.+-]+)/[\w.\[\]<>=^~*-]+"),
    ("cpp", r"(^|/)CMakeLists\.txt$", None, r"(?:find_package|FetchContent_Declare|CPMAddPackage)\s*\(\s*(?:NAME\s+)?\"?([A-Za-z0-9_.+-]+)"),
    ("ruby", r"(^|/)Gemfile$", None, r"^\s*gem\s+[\"']([^\"']+)[\"']"),
    ("jvm", r"(^|/)libs\.versions\.toml$", r"^\[libraries\]", r"module\s*=\s*\"([^\"]+)\""),
]
#: JSON manifests (fixed values): ecosystem, file name pattern, objects whose keys are package names.
JSON_FORMS: list[tuple[str, str, tuple[str, ...]]] = [
    ("node", r"(^|/)package\.json$", ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")),
    ("php", r"(^|/)composer\.json$", ("require", "require-dev")),
]


def _section_of(files: DataFrame) -> DataFrame:
    """Lines with the last ``[section]`` header at or above them."""
    from lumenveil.operators.windows import enclosing_header

    lines = exploded_lines(files, ["repo", "path"])
    return enclosing_header(lines, ["repo", "path"], F.regexp_extract("line", r"^\s*(\[[^\]\"']+\])\s*$", 1))


def declared_packages(files: DataFrame) -> DataFrame:
    """``(repo, path, ecosystem, package, line_no)``, each package once per manifest at its first line."""
    lines = _section_of(files.where(_is_manifest(F.col("path"))))
    found = []
    for ecosystem, name, section, pattern in LINE_FORMS:
        hit = F.col("path").rlike(name)
        if section is not None:
            hit = hit & F.col("header").rlike(section)
        value = F.regexp_extract("line", pattern, 1)
        found.append(F.when(hit & (value != ""), F.struct(F.lit(ecosystem).alias("ecosystem"), value.alias("package"))))
    plain = lines.where(~F.trim("line").rlike(r"^(#|//)")).select("repo", "path", "line_no", F.inline(F.array_compact(F.array(*found))))
    both = plain
    for ecosystem, name, objects in JSON_FORMS:
        maps = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{o}"), "map<string,string>")), F.array().cast("array<string>")) for o in objects]
        keys = files.where(F.col("path").rlike(name)).select("repo", "path", F.explode(F.array_distinct(F.flatten(F.array(*maps)))).alias("package"))
        at = exploded_lines(files.where(F.col("path").rlike(name)), ["repo", "path"]).select("repo", "path", "line_no", F.regexp_extract("line", r"^\s*\"([^\"]+)\"\s*:", 1).alias("package"))
        placed = keys.join(at.where("package <> ''"), ["repo", "path", "package"], "left")
        both = both.unionByName(placed.select("repo", "path", "line_no", F.lit(ecosystem).alias("ecosystem"), "package"))
    return both.groupBy("repo", "path", "ecosystem", "package").agg(F.min("line_no").alias("line_no"))


def _is_manifest(path: Column) -> Column:
    names = [n for _, n, _, _ in LINE_FORMS]
    return path.rlike("|".join(f"(?:{n})" for n in names))


def pom_packages(files: DataFrame) -> DataFrame:
    """``groupId:artifactId`` of the dependencies of Maven manifests."""
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    deps = files.where(F.col("path").rlike(r"(^|/)pom\.xml$")).select("repo", "path", F.explode(blocks).alias("_d"))
    group, artifact = F.regexp_extract("_d", r"<groupId>\s*([^<\s]+)", 1), F.regexp_extract("_d", r"<artifactId>\s*([^<\s]+)", 1)
    return deps.select("repo", "path", F.lit("jvm").alias("ecosystem"), F.concat_ws(":", group, artifact).alias("package")).where("package <> ':'").dropDuplicates()


def database_of_connection(value: Column) -> Column:
    """Database engine a connection string or URI names; null when none is known."""
    low = F.lower(value)
    forms = [("postgresql", r"postgres|npgsql|host=.*port=5432"), ("mysql", "mysql|mariadb"), ("sqlserver", r"sqlserver|data source=|initial catalog="), ("sqlite", "sqlite|\\.db\\b"), ("mongodb", "mongodb"), ("redis", "redis"), ("oracle", "oracle")]
    out = F.lit(None).cast("string")
    for engine, pattern in reversed(forms):
        out = F.when(low.rlike(pattern), engine).otherwise(out)
    return out
