"""Terraform files: top-level blocks by brace depth, and references between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenveil.functions.lines import brace_delta, exploded_lines
from lumenveil.operators.joins import first_match_join
from lumenveil.operators.windows import running_depth

_HEADER = r"^\s*(resource|data|module|provider|variable|output|locals)\s*(?:\"([^\"]+)\"\s*)?(?:\"([^\"]+)\"\s*)?\{"
#: First parts of an expression that name no resource (fixed values).
_RESERVED = ("var", "local", "each", "count", "self", "path", "terraform", "data", "module")


def terraform_blocks(files: DataFrame) -> DataFrame:
    """``(repo, path, kind, type, name, address, start_line, end_line, body)`` of the top-level blocks; an unclosed block ends with its file."""
    lines = exploded_lines(files.where(F.col("path").rlike(r"\.tf$")), ["repo", "path"]).where(~F.trim("line").rlike("^(#|//)"))
    deep = running_depth(lines, ["repo", "path"], brace_delta(F.col("line")))
    opens = (F.col("depth") - brace_delta(F.col("line")) == 0) & F.col("line").rlike(_HEADER)
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    inside = deep.withColumn("_block", F.sum(opens.cast("int")).over(w)).withColumn("_before", F.col("depth") - brace_delta(F.col("line")))
    grouped = inside.where(F.col("_block") > 0).groupBy("repo", "path", "_block").agg(
        F.min_by("line", "line_no").alias("_head"),
        F.min("line_no").alias("start_line"),
        F.max(F.when((F.col("depth") > 0) | (F.col("_before") > 0), F.col("line_no"))).alias("_last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("body"),
    )
    kind, first, second = (F.regexp_extract("_head", _HEADER, g) for g in (1, 2, 3))
    address = (
        F.when(kind == "resource", F.concat_ws(".", first, second)).when(kind == "data", F.concat_ws(".", F.lit("data"), first, second)).otherwise(F.concat_ws(".", kind, F.nullif(first, F.lit(""))))
    )
    return grouped.select(
        "repo", "path", kind.alias("kind"), F.nullif(first, F.lit("")).alias("type"), F.nullif(second, F.lit("")).alias("name"), address.alias("address"), "start_line",
        F.coalesce("_last", "start_line").alias("end_line"), "body",
    )


def terraform_references(blocks: DataFrame) -> DataFrame:
    """``(repo, source, target)`` between addresses that both exist in the repository."""
    mentioned = F.array_distinct(
        F.concat(
            F.regexp_extract_all("body", F.lit(r"(?<![\w.\"/-])((?:data\.)?[a-z][a-z0-9]*_[a-z0-9_]+\.[A-Za-z_][\w-]*)"), F.lit(1)),
            F.regexp_extract_all("body", F.lit(r"(?<![\w.])(module\.[A-Za-z_][\w-]*)"), F.lit(1)),
        )
    )
    rows = blocks.select("repo", F.col("address").alias("source"), F.explode(mentioned).alias("target"))
    rows = rows.where(~F.substring_index("target", ".", 1).isin(*[r for r in _RESERVED if r not in ("data", "module")]))
    return rows.join(blocks.select("repo", F.col("address").alias("target")), ["repo", "target"], "left_semi").where("source <> target").dropDuplicates().select("repo", "source", "target")


def resource_hints(blocks: DataFrame, hints: DataFrame) -> DataFrame:
    """Resources with the first hint (by ``position``) whose ``prefix`` begins their type; ``hints`` is a catalog."""
    resources = blocks.where("kind = 'resource'").select("repo", "address", "type")
    return first_match_join(resources, hints, F.col("type").startswith(F.col("prefix")), "position", ["subtype"], ["repo", "address", "type"])
