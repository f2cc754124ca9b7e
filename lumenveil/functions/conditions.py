"""Conditions and assignments given as data, compiled to Column expressions.

A condition is ``{"always": true}``, ``{"exists": col}``, ``{"notSet": col}``, ``{"equals": [col, value]}``, ``{"regex": [col, pattern]}``,
``{"anyOf": [...]}``, ``{"allOf": [...]}`` or ``{"not": cond}``.  A rule is ``{"when": cond, "set": {name: spec}}`` where a spec is
``{"const": v}``, ``{"from": col}`` or ``{"lookup": [col, {key: value}]}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_condition(spec: dict) -> Column:
    """A condition as a boolean Column that is never null."""
    (kind, arg), = spec.items()
    if kind == "always":
        return F.lit(bool(arg))
    if kind == "exists":
        return F.col(arg).isNotNull()
    if kind == "notSet":
        return F.col(arg).isNull()
    if kind == "equals":
        return F.col(arg[0]).eqNullSafe(F.lit(arg[1]))
    if kind == "regex":
        return F.coalesce(F.col(arg[0]).rlike(arg[1]), F.lit(False))
    if kind == "anyOf":
        return reduce(lambda a, b: a | b, map(compile_condition, arg), F.lit(False))
    if kind == "allOf":
        return reduce(lambda a, b: a & b, map(compile_condition, arg), F.lit(True))
    if kind == "not":
        return ~compile_condition(arg)
    raise ValueError(f"unknown condition {kind}")


def _value(spec: dict) -> Column:
    (kind, arg), = spec.items()
    if kind == "const":
        return F.lit(arg).cast("string")
    if kind == "from":
        return F.col(arg).cast("string")
    if kind == "lookup":
        column, table = arg
        if not table:
            return F.lit(None).cast("string")
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(column))
    raise ValueError(f"unknown value {kind}")


def apply_rules(rows: DataFrame, rules: list[dict], names: list[str]) -> DataFrame:
    """``rows`` with the properties ``names``: rules run in order and see what earlier ones set; a set value is kept."""
    out = rows
    for name in names:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    for rule in rules:
        hit = compile_condition(rule["when"])
        out = out.withColumns({n: F.when(hit & F.col(n).isNull(), _value(v)).otherwise(F.col(n)) for n, v in rule["set"].items()})
    return out
