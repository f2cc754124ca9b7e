"""Lines of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded_lines(files: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """One row per line: ``keys, line_no, line``; line ends differ, a trailing empty line counts.

    A null text has no lines; an empty one has one empty line.
    """
    lines = F.posexplode(F.split(F.col(text), r"\r?\n", -1)).alias("_at", "line")
    return files.where(F.col(text).isNotNull()).select(*keys, lines).select(*keys, (F.col("_at") + 1).alias("line_no"), "line")


def brace_delta(line: Column) -> Column:
    """Opening minus closing braces outside of string literals."""
    bare = F.regexp_replace(line, r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`]*`", "")
    return F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))


def is_comment_only(line: Column) -> Column:
    return F.trim(line).rlike(r"^(//|#|/\*|\*|<!--|--)")
