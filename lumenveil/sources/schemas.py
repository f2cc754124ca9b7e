"""Stored columns declared in schema and migration files, read line by line under the table header above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.functions.lines import exploded_lines
from lumenveil.operators.windows import enclosing_header
from lumenveil.sources.files import schema_file_kind

#: Per kind: pattern of a table header, pattern of a column line with name and type, first words that begin no column (fixed values).
_FORMS: dict[str, tuple[str, str, str]] = {
    "sql": (
        r"(?i)^\s*(?:create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table(?:\s+only)?)\s+[\"`\[]?(?:\w+[\"`\]]?\.[\"`\[]?)?(\w+)",
        r"(?i)^\s*(?:,\s*)?(?:add\s+(?:column\s+)?)?[\"`\[]?(\w+)[\"`\]]?\s+((?:var)?char|text|citext|n?varchar|int\w*|bigint|smallint|serial|bigserial|uuid|bool\w*|date\w*|time\w*|numeric|decimal|real|double|float|json\w*|bytea|blob)\b",
        r"(?i)^\s*(?:primary|foreign|unique|constraint|check|index|key|create|alter|drop|\))",
    ),
    "prisma": (r"^\s*model\s+(\w+)\s*\{", r"^\s+(\w+)\s+(\w+)(?:\[\])?\??", r"^\s*(?:@@|//|\}|model\b|enum\b)"),
    "rails": (r"create_table\s+[:\"'](\w+)|add_column\s+[:\"'](\w+)", r"^\s*t\.(?!index|timestamps|references)\w+\s+[:\"'](\w+)|add_column\s+[:\"']\w+[\"']?,\s*[:\"'](\w+)", r"^\s*#"),
    "laravel": (r"Schema::(?:create|table)\(\s*['\"](\w+)", r"\$table->(?!index|timestamps|foreign|dropColumn|primary|unique)\w+\(\s*['\"](\w+)", r"^\s*//"),
}


def schema_columns(files: DataFrame) -> DataFrame:
    """``(repo, path, kind, table_name, column, type, line_no)`` of files whose path names a schema or migration; scratch tables are left out."""
    known = files.withColumn("kind", schema_file_kind(F.col("path"))).where("kind IS NOT NULL")
    lines = exploded_lines(known, ["repo", "path", "kind"])
    header = F.lit("")
    for kind, (pattern, _, _) in _FORMS.items():
        groups = [F.nullif(F.regexp_extract("line", pattern, g), F.lit("")) for g in range(1, 1 + pattern.count("(\\w+)"))]
        header = F.when(F.col("kind") == kind, F.coalesce(*groups, F.lit(""))).otherwise(header)
    placed = enclosing_header(lines, ["repo", "path"], header)
    found = []
    for kind, (_, pattern, skip) in _FORMS.items():
        names = [1, 2] if kind == "rails" else [1]
        name = F.coalesce(*[F.nullif(F.regexp_extract("line", pattern, g), F.lit("")) for g in names], F.lit(""))
        typed = F.lower(F.nullif(F.regexp_extract("line", pattern, 2), F.lit(""))) if kind in ("sql", "prisma") else F.lit(None).cast("string")
        hit = (F.col("kind") == kind) & (name != "") & ~F.col("line").rlike(skip)
        found.append(F.when(hit, F.struct(name.alias("column"), typed.alias("type"))))
    rows = placed.where("header IS NOT NULL AND NOT endswith(header, '_scratch')")
    return rows.select("repo", "path", "kind", F.col("header").alias("table_name"), F.inline(F.array_compact(F.array(*found))), "line_no")
