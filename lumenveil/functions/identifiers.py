"""Identifier, URL and id expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_parts(token: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or dashed identifier; acronyms stay whole."""
    broken = F.regexp_replace(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(F.trim(F.regexp_replace(broken, r"[_\-\s.]+", " "))), " ")
    return F.filter(words, lambda w: w != "")


def lookup_keys(token: Column) -> Column:
    """Distinct spellings under which a catalog may know an identifier: normalised, squashed, snake, and its words."""
    plain = F.translate(F.lower(F.trim(token)), "-", "_")
    parts = camel_parts(token)
    snake = F.array_join(parts, "_")
    return F.array_distinct(F.concat(F.array(plain, F.replace(plain, F.lit("_"), F.lit("")), snake, F.array_join(parts, "")), parts))


def identifier_tokens(line: Column) -> Column:
    """Identifiers of a line in order of appearance."""
    return F.regexp_extract_all(line, F.lit(r"([A-Za-z_$][A-Za-z0-9_$-]*)"), F.lit(1))


def ascii_word(pattern: str) -> str:
    """A pattern with word bounds that treat only ASCII letters, digits and underscore as word characters.

    A bound at the start of the pattern, a group or an alternative must precede a word character, any other must follow one, so each is
    a single look-around.
    """
    opening = re.sub(r"(^|[(|])\\b", r"\1(?<![A-Za-z0-9_])", pattern)
    return opening.replace(r"\b", "(?![A-Za-z0-9_])")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def service_key(host: Column) -> Column:
    """Last two labels of a host without ``www.``; a single label stays."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def is_external_url(url: Column) -> Column:
    """Literal http(s) URLs with a dotted, public host; no templates, no private addresses."""
    host = url_host(url)
    private = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|.*\.(local|internal|test|invalid|example)$)"
    return F.coalesce(url.rlike(r"^https?://") & ~url.rlike(r"[{}$<>%]") & host.contains(".") & ~host.rlike(private), F.lit(False))


def short_id(prefix: str, key: Column) -> Column:
    """``prefix`` and the first twelve hex digits of the key's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 12))
