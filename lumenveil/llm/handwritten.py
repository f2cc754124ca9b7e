"""Which files of a scan nobody wrote by hand in that repository.

Every file gets evidence for five labels (hand-written, generated, minified, vendored, blob) from its path and
its whole content, strong or weak.  Belief propagation over the directory tree then combines it with what parents and siblings say: an
upward pass sums each directory's messages, a downward pass gives every node what the rest of the tree knows.  So a file without a notice of
its own counts as vendored in a vendor directory whose other files carry foreign notices, and as hand-written in one whose files do not.
A tree has no cycles, so one pass each way is exact.  Passes go level by level, each level one
aggregation or equi-join, so a directory with a third of all files is summed in partial aggregates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.text import relative_path
from lumenveil.operators.history import latest
from lumenveil.shipping import ship_package
from lumenveil.tables import table
from lumenveil.workspace import Workspace

_REMEMBERED = 100_000  # texts whose marks a task remembers
LABELS = ("hand", "generated", "minified", "vendored", "blob")

#: P(label of child | label of directory): rows are the directory's label.
COMPATIBILITY = (
    (0.88, 0.04, 0.03, 0.03, 0.02),
    (0.12, 0.82, 0.02, 0.02, 0.02),
    (0.12, 0.02, 0.82, 0.02, 0.02),
    (0.12, 0.02, 0.02, 0.82, 0.02),
    (0.12, 0.02, 0.02, 0.02, 0.82),
)
#: Prior log weight of a hand-written root.
ROOT = (3.0, 0.0, 0.0, 0.0, 0.0)

#: Log evidence: a name that says what a file is; a notice, or a text of that shape; a notice amid the code; a directory that often holds such files;
#: a text without any notice; a text that reads like code; a path without a text.  Against hand-written siblings (log 0.04 / 0.88) only the first two stand alone.
NAMED, CLEAR, AMID, HINT, PLAIN, READABLE, UNREAD = 8.0, 5.5, 0.3, 0.7, -2.5, -4.0, -1.0

# ---------------------------------------------------------------- evidence from content

_LEAD = re.compile(
    r"\s*(?:(?://|\#|--|;;|%)[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?:<{7}|={7}|>{7}|\|{7})[^\n]*|\"\"\".*?(?:\"\"\"|\Z))", re.S
)
_DECORATION = re.compile(r"(?m)^[ \t]*(?://+!?|\#+!?|--|;;+|%|/\*+!?|\*+/?|<!--)|\*/|-->|\"\"\"")

_NO_EDIT = (
    r"(?:do not|don'?t|never|must not|please|instead|not be|nicht|ne pas|no editar|no modificar|will be (?:lost|overwritten)|to (?:refresh|regenerate|update)|by hand|manual(?:ly)?)"
)
_GENERATED = [
    re.compile(p, re.I | re.S)
    for p in (
        r"@generated\b|<auto-?generated\b|\bauto-?generated>",
        r"\b(?:code|file|class|module|source|document|header|script|types?|bindings|schema|package)\s+(?:(?:is|was|has been|are|were)\s+)?(?:auto(?:matically)?[- ]?|machine[- ]?)?generated\b(?:\s+(?:automatically|code|by|from|with|using|file)\b|\s*[.,;:-])",
        r"\b(?:auto[- ]?generated|automatically generated|machine[- ]generated)\s*(?:file|code|source|by|from|with|using|output|[:;.-])",
        r"\b(?:generated|produced|written|created|emitted|built|compiled)\s+(?:automatically\s+)?(?:by|from|with|using)\b.{1,160}?\b" + _NO_EDIT,
        r"\b(?:generated|produced|written|created|emitted)\s+by\b[^\n]{1,60}?\b(?:tool|compiler|generator|v(?:ersion)?\.?\s?\d|\d+\.\d+)",
        r"\bautomatisch\b.{0,80}\b(?:erzeugt|generiert|erstellt)|\b(?:erzeugt|generiert|erstellt)\b.{0,80}\bnicht\s+(?:bearbeiten|ändern|editieren)",
        r"\bgénérée?s?\s+(?:automatiquement|par)|\bautomatiquement\s+générée?",
        r"\bgenerad[oa]s?\s+(?:automáticamente|por)|\bautomáticamente\s+generad[oa]",
    )
]
_VERSION = r"v?\d+(?:\.\d+)+(?:[-+.\w]*)?"
_PROJECT = r"@?[A-Za-z][\w.+-]*(?:/[\w.+-]+)?"
_FOREIGN = [
    re.compile(p, re.I)
    for p in (
        rf"@(?:license|preserve)\s+({_PROJECT})\s+{_VERSION}",
        rf"(?m)^\s*({_PROJECT})(?:\.js)?\s+{_VERSION}\s*(?:-|–|\||,|$)",
        r"(?:copyright|\(c\)|©)\s*(?:\(c\)\s*|©\s*)?\d{4}(?:\s*[-–,]\s*(?:\d{4}|present))?,?\s+(?:by\s+)?(?:the\s+)?([\w.+-]+)\s+(?:authors|contributors|team|project|developers|maintainers|foundation)",
        rf"(?:see|from|part of|copied from|taken from|vendored from|bundled with)\s+(?:the\s+)?({_PROJECT})\s+(?:project|library|package|repository)\b",
        rf"\b({_PROJECT})\b[^\n]{{0,40}}\b(?:bundled|vendored)\s+copy\b",
    )
]
_DATA_STRING = re.compile(r"\"[^\"\s]{56,}\"|'[^'\s]{56,}'|`[^`\s]{56,}`")
_NUMBER = re.compile(r"-?\b(?:0x[0-9A-Fa-f]{1,16}|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\b\s*[,\])}]*[\s\[({]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_COMMENT = re.compile(r"(?m)/\*.*?\*/|^\s*(?://|\#)[^\n]*$", re.S)
_DATA_LANGUAGES = ("json", "yaml", "yml", "toml", "xml", "csv", "markdown")


#: Lines that may stand before a file's notice.
_PROLOGUE = re.compile(r"\s*(?:package\s+[\w.]+\s*;?|(['\"])use strict\1\s*;?|<\?(?:php|xml[^\n]*)|<!DOCTYPE[^>\n]*>|namespace\s+[\w.\\]+\s*;|from __future__[^\n]*|---)[ \t]*(?=\n|\Z)")
_LATER = re.compile(r"(?m)^[ \t]*(?://|\#|--|;;)[^\n]*|^[ \t]*/\*(?s:.*?)\*/")


def leading_comment(text: str) -> str:
    """The comments before the first line of code but a package or mode line, without their marks."""
    return _head(text)[0]


def _head(text: str) -> tuple[str, int]:
    at, parts = 0, []
    while (m := _LEAD.match(text, at) or _PROLOGUE.match(text, at)) is not None and m.end() > at:
        if m.re is _LEAD:
            parts.append(m.group().strip())
        at = m.end()
    return _DECORATION.sub(" ", "\n".join(parts)), at


@lru_cache(maxsize=65_536)
def _own(project: str, repo: str) -> bool:
    """Whether a project named in a header is the repository itself; a name spelled nearly alike is."""
    name = project.lower().strip("@.")
    return any(name == part or SequenceMatcher(None, name, part).ratio() >= 0.75 for part in (repo or "").lower().split("/") if part)


def content_marks(text: str, language: str) -> tuple[float, float, float, tuple[str, ...]]:
    """(generated, minified, blob, projects named in notices) of a whole text, whatever repository it is in."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    head, code_at = _head(text)
    generated = PLAIN
    minified = blob = READABLE
    if any(p.search(re.sub(r"\s+", " ", head)) for p in _GENERATED):
        generated = CLEAR
    elif "enerat" in text or "GENERAT" in text:
        later = re.sub(r"\s+", " ", _DECORATION.sub(" ", "\n".join(_LATER.findall(text, code_at))))
        if any(p.search(later) for p in _GENERATED):
            generated = AMID
    named = dict.fromkeys(m.group(1) for p in _FOREIGN for m in p.finditer(head) if m.group(1).lower() not in _COMMON_WORDS)
    solid = len(text) - text.count(" ") - text.count("\n") - text.count("\t")
    if solid and (language or "").strip().lower() not in _DATA_LANGUAGES:
        data = sum(len(s) for s in _DATA_STRING.findall(text))
        rest = _STRING.sub("", text) if data * 2 < solid else ""
        numbers = sum(len(s.rstrip()) for s in _NUMBER.findall(rest))
        if data > 0.5 * solid or numbers > 0.55 * solid:
            blob = CLEAR
        else:
            bare = _STRING.sub('""', _COMMENT.sub("", text))
            longest = [line for line in bare.split("\n") if len(line) > 160]
            wide = sum(map(len, longest))
            blank = sum(line.count(" ") for line in longest)
            code = len(bare.strip())
            if code and wide > 0.6 * code and blank < 0.14 * wide and wide > 200:
                minified = CLEAR
    return generated, minified, blob, tuple(named)


def content_evidence(text: str, language: str, repo: str) -> tuple[float, float, float, float, float]:
    """Log evidence for the five labels from a whole text; hand-written is the reference at zero."""
    generated, minified, blob, named = content_marks(text, language)
    return 0.0, generated, minified, CLEAR if any(not _own(p, repo) for p in named) else PLAIN, blob


#: Words that stand before a version or "project" without naming a foreign project.
_COMMON_WORDS = frozenset("version release revision since api schema python node java go the this our same parent".split())

# ---------------------------------------------------------------- evidence from paths

_LOCK_NAMES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml pnpm-lock.yml composer.lock cargo.lock poetry.lock pdm.lock uv.lock "
    "pipfile.lock gemfile.lock go.sum packages.lock.json podfile.lock mix.lock pubspec.lock bun.lock bun.lockb deno.lock flake.lock .terraform.lock.hcl"
).split()
_GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|\.pb(\.gw|\.validate)?\.go|\.pb\.(cc|h)|_grpc\.pb\.go|\.(g|g\.i|designer)\.cs|\.(g|freezed)\.dart|\.generated\.\w+|[._-]generated\.\w+|\.gen\.\w+|_gen\.go|^zz_generated\..*)$"
_GENERATED_DIR = r"(^|/)(__generated__|_generated_?|generated|generated[-_](sources?|src|code)|auto[-_]?gen(erated)?|codegen[-_]out)/"
_MINIFIED_NAME = r"([.-]min\.(js|mjs|cjs|css)|\.bundle\.js|[.-](?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f]|\d{8})[0-9a-f]{8,40}(\.chunk)?\.(js|mjs|css))$"
_VENDORED_DIR = (
    r"(^|/)(node_modules|bower_components|jspm_packages|web_modules|third[-_]?party|3rd[-_]?party|vendored|site-packages|dist-packages|pods|carthage)/[^/]+"
    r"|(^|/)vendor/[a-z0-9-]+(\.[a-z0-9-]+)+/"
    r"|(^|/)(external|externals|extern|deps|vendor|contrib|libs?)/[\w.+-]*[A-Za-z][\w.+]*-v?\d+(\.\d+)+[\w.-]*/"
)


#: Directories that often hold such files, and as often the project's own.
_GENERATED_HINT = r"(^|/)(gen|build|target|out|dist|api|stubs?|bindings|migrations)/"
_MINIFIED_HINT = r"(^|/)(public|static|dist|assets|js|wwwroot)/"
_VENDORED_HINT = r"(^|/)(vendor|external|externals|extern|deps|contrib|libs?|plugins|assets|thirdparty)/"


def path_evidence(path: Column) -> list[Column]:
    """Log evidence for the five labels from a path alone."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    generated = name.isin(*_LOCK_NAMES) | name.rlike(_GENERATED_NAME) | low.rlike(_GENERATED_DIR)
    def weight(sure: Column, hint: str) -> Column:
        return F.when(sure, F.lit(NAMED)).when(low.rlike(hint), F.lit(HINT)).otherwise(F.lit(0.0))

    return [
        F.lit(0.0), weight(generated, _GENERATED_HINT), weight(name.rlike(_MINIFIED_NAME), _MINIFIED_HINT), weight(low.rlike(_VENDORED_DIR), _VENDORED_HINT), F.lit(0.0)
    ]


# ---------------------------------------------------------------- propagation


def _message(prefix: str) -> list[Column]:
    """What a node with beliefs ``prefix0..4`` tells a directory of each label."""
    b = [F.col(f"{prefix}{t}") for t in range(5)]
    top = F.greatest(*b)
    return [
        top + F.log(reduce(lambda x, y: x + y, [F.lit(COMPATIBILITY[s][t]) * F.exp(b[t] - top) for t in range(5)])) for s in range(5)
    ]


def propagate(files: DataFrame, keys: list[str], path: str, evidence: list[str], ws: Workspace) -> DataFrame:
    """Exact posterior of every file: ``keys, path, label, hand`` (``hand``: probability of hand-written).

    ``files`` has one row per (keys, path) with log evidence in five columns.  Directories get no rows of their own: each
    level of them is the aggregate of the level below.
    """
    nodes = files.select(
        *keys,
        F.col(path).alias("_path"),
        F.lit(True).alias("_file"),
        (F.size(F.split(F.col(path), "/")) - 1).alias("_depth"),
        *[F.col(e).cast("double").alias(f"b{t}") for t, e in enumerate(evidence)],
    )
    nodes = ws.put(nodes)
    deepest = nodes.agg(F.max("_depth")).first()[0]
    none = nodes.where("false")
    if deepest is None:
        return none.select(*keys, F.col("_path").alias(path), F.lit("").alias("label"), F.lit(0.0).alias("hand"))
    parent = F.when(F.instr("_path", "/") > 0, F.regexp_replace("_path", "/[^/]*$", "")).otherwise("")
    up: list[DataFrame] = []
    directories = none
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("_depth") == depth).unionByName(directories)
        level = level.withColumn("_parent", parent)
        level = ws.put(level.select("*", *[m.alias(f"m{s}") for s, m in enumerate(_message("b"))]))
        up.append(level)
        directories = level.groupBy(*keys, "_parent").agg(*[F.sum(f"m{s}").alias(f"b{s}") for s in range(5)]).select(
            *keys,
            F.col("_parent").alias("_path"),
            F.lit(False).alias("_file"),
            F.lit(depth - 1).alias("_depth"),
            *[f"b{s}" for s in range(5)],
        )
    # the root: its own prior is the message from above
    above = directories.select(*keys, F.col("_path").alias("_parent"), *[(F.col(f"b{s}") + F.lit(ROOT[s])).alias(f"p{s}") for s in range(5)])
    results: list[DataFrame] = []
    for level in reversed(up):
        joined = level.join(above, [*keys, "_parent"])
        # the directory's belief without this child's own message
        cavity = [F.col(f"p{s}") - F.col(f"m{s}") for s in range(5)]
        top = F.greatest(*cavity)
        down = [
            top + F.log(reduce(lambda x, y: x + y, [F.lit(COMPATIBILITY[s][t]) * F.exp(cavity[s] - top) for s in range(5)])) for t in range(5)
        ]
        full = ws.put(
            joined.select(*keys, "_path", "_file", *[(F.col(f"b{t}") + down[t]).alias(f"f{t}") for t in range(5)])
        )
        results.append(full.where("_file"))
        above = full.where("NOT _file").select(*keys, F.col("_path").alias("_parent"), *[F.col(f"f{s}").alias(f"p{s}") for s in range(5)])
    everything = reduce(DataFrame.unionByName, results)
    f = [F.col(f"f{t}") for t in range(5)]
    top = F.greatest(*f)
    total = reduce(lambda x, y: x + y, [F.exp(c - top) for c in f])
    best = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(F.array(*f), top).cast("int"))
    return everything.select(*keys, F.col("_path").alias(path), best.alias("label"), (F.exp(f[0] - top) / total).alias("hand"))


def file_evidence(listed: DataFrame, sources: DataFrame) -> DataFrame:
    """``(scan_id, file_path, e0..e4)`` of every listed path, with the evidence of its content where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}  # marks of texts met before
        for b in batches:
            rows = []
            for text, language, repo in zip(b.column("content").to_pylist(), b.column("language").to_pylist(), b.column("repo").to_pylist()):
                if text is None:
                    rows.append((0.0, *[UNREAD] * 4))
                    continue
                key = (hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), language)
                marks = seen.get(key)
                if marks is None:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    marks = seen[key] = content_marks(text, language)
                rows.append((0.0, marks[0], marks[1], CLEAR if any(not _own(p, repo) for p in marks[3]) else PLAIN, marks[2]))
            yield pa.record_batch(
                [b.column("scan_id"), b.column("file_path"), b.column("ingested_at"), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(5)]],
                ["scan_id", "file_path", "ingested_at", *[f"c{k}" for k in range(5)]],
            )

    texts = sources.where("scan_id IS NOT NULL").select(
        F.col("scan_id").cast("long"), relative_path(F.col("path")).alias("file_path"), F.col("content").cast("string"), F.col("language").cast("string"), F.col("repo").cast("string"),
        F.col("ingested_at").cast("timestamp"),
    ).where("file_path IS NOT NULL")
    seen = texts.mapInArrow(run, "scan_id long, file_path string, ingested_at timestamp, c0 double, c1 double, c2 double, c3 double, c4 double")
    current = latest(seen, ["scan_id", "file_path"], ["ingested_at"])
    joined = listed.join(current, ["scan_id", "file_path"], "left")
    marks = path_evidence(F.col("file_path"))
    return joined.select("scan_id", "file_path", *[(F.coalesce(f"c{k}", F.lit(UNREAD if k else 0.0)) + marks[k]).alias(f"e{k}") for k in range(5)])


def file_labels(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """``(scan_id, file_path, label, hand)`` of every path the scans read.

    Defined cases: redelivered scans and paths count once; of several rows of one path the last ingested counts; a path without
    content is judged by path and neighbours; null scans, null paths and null lists are left out; empty tables
    give no rows; other columns are not read.
    """
    ship_package(payloads.sparkSession)
    ws = Workspace(payloads.sparkSession, "labels")
    listed = payloads.where("scan_id IS NOT NULL").select(F.col("scan_id").cast("long"), F.explode("files_scanned").alias("_raw"))
    listed = listed.select("scan_id", relative_path(F.col("_raw")).alias("file_path")).where("file_path IS NOT NULL").dropDuplicates()
    return propagate(file_evidence(listed, sources), ["scan_id"], "file_path", [f"e{k}" for k in range(5)], ws)


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    return file_labels(table(spark, folder, "scan_payloads"), table(spark, folder, "source_files")).withColumn("hand", F.round("hand", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = file_labels(table(spark, folder, "scan_payloads"), table(spark, folder, "source_files"))
    return labels.where("label <> 'hand'").select("scan_id", "file_path")
