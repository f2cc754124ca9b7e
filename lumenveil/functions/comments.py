"""Source text with its comments blanked; lines and offsets stay."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SLASH = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(//[^\n]*|/\*.*?(?:\*/|\Z))", re.S)
_HASH = re.compile(r"(\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(\#[^\n]*)", re.S)
_DOCSTRING = re.compile(r"(?:^|:)\s*$")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blank_comments(text: str, language: str) -> str:
    """Comments of one text as spaces; strings are left alone, docstrings of Python are comments."""
    if language in ("python", "yaml", "ruby"):

        def hash_style(m: re.Match) -> str:
            if m.group(2):
                return _blank(m.group())
            if m.group(1) and language == "python":
                before = text[: m.start()].rstrip(" \t")
                line = before.rpartition("\n")[2]
                if line.strip() == "" and _DOCSTRING.search(before.rstrip() or ""):
                    return _blank(m.group())
            return m.group()

        return _HASH.sub(hash_style, text)
    if language in ("json",):
        return text
    return _SLASH.sub(lambda m: _blank(m.group()) if m.group(1) else m.group(), text)


def without_comments(content: Column, language: Column) -> Column:
    """Arrow-batched: comment marks inside strings need a lexer, which no built-in expression is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([None if t is None else blank_comments(t, lang or "") for t, lang in zip(texts, languages)], dtype="object")

    return run(content, language)
