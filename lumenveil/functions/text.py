"""Normalisation of paths, identifiers and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column) -> Column:
    """Path relative to the root: forward slashes, no empty, ``.`` or ``..`` part.

    ``..`` at the root has nothing to remove and vanishes.  A path without parts
    (null, blank, ``.``) is null.
    """
    slashed = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.aggregate(
        F.split(slashed, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    resolved = F.when(slashed.rlike(r"(^|/)(\.{0,2})(/|$)"), F.array_join(parts, "/")).otherwise(slashed)
    return F.nullif(resolved, F.lit(""))


def status_label(value: Column) -> Column:
    """Lower case with single underscores between words; null when nothing is left."""
    camel = F.regexp_replace(F.trim(value), "([a-z0-9])([A-Z])", "$1_$2")
    joined = F.regexp_replace(F.lower(camel), r"[\s_\-]+", "_")
    return F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(""))


def loose_id(value: Column) -> Column:
    """Identifier with outer blanks and letter case put aside; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 UTC as BIGINT."""
    return F.unix_micros(ts.cast("timestamp"))


def is_contract_path(path: Column) -> Column:
    """Relative path with forward slashes only: not empty or absolute, no drive letter, NUL, ``..`` or empty segment."""
    bad = path.rlike(r"^$|^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|//|/$") | path.contains("\u0000")
    return F.coalesce(~bad, F.lit(False))


def typed_flow_key(key: Column) -> Column:
    """Ends of ``flow:type:key->type:key`` as a struct; null for anything else."""
    pattern = r"^flow:(asset|third_party|actor):(.+?)->(asset|third_party|actor):(.+)$"
    parts = [F.regexp_extract(key, pattern, g) for g in range(1, 5)]
    fields = F.struct(*[p.alias(n) for p, n in zip(parts, ("source_type", "source", "target_type", "target"))])
    return F.when(key.rlike(pattern), fields)


def same_file(a: Column, b: Column) -> Column:
    """Whether two spellings name one file: equal, or one ends in a slash and the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
