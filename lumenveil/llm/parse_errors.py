"""Source files that are no valid text of their language.

Each text is read by the error-correcting chart parser of its language and flagged if its repair costs anything; that much needs only the
chart's zero-cost level.  The repair itself, with its least cost, is worked out for the flagged texts alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm.syntax.languages import LANGUAGES, NAMES, language_of, parser, tokens
from lumenveil.operators.history import latest
from lumenveil.shipping import ship_package
from lumenveil.tables import table
from lumenveil.workspace import Workspace

_EXTENSIONS = {
    "json": "json", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "mts": "typescript", "cts": "typescript", "java": "java", "cs": "csharp", "go": "go", "yaml": "yaml", "yml": "yaml",
}
_MARKER = re.compile(r"^(<{7}|={7}|>{7}|\|{7})(\s|$)")


def grammar_name(language: Column, path: Column) -> Column:
    """The grammar's language; blanks and case aside, by the file's extension where no language is given."""
    key = F.regexp_replace(F.lower(language), r"\s+", "")
    spelled = F.create_map(*[F.lit(x) for pair in ({**NAMES, **{n: n for n in LANGUAGES}}).items() for x in pair])
    ending = F.create_map(*[F.lit(x) for pair in _EXTENSIONS.items() for x in pair])
    return F.when(F.coalesce(key, F.lit("")) == "", F.element_at(ending, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))).otherwise(
        F.element_at(spelled, key)
    )


def rejected(language: str, text: str) -> bool:
    """Whether the text's repair costs anything: the chart is searched at cost zero only, where it needs no edits."""
    return not parser(language).parses(tokens(language, text))


def diagnose(language: str, text: str) -> tuple[int, bool, str, str | None, list[int]]:
    """(cost, whether the cost is only a lower bound (never), kind, language it parses as, lines of edits) of a rejected text.

    ``conflict``: edits lie on merge markers.  ``mismatch``: the text parses as another language, or every fifth token is edited.
    ``truncation``: the text can go on at its end, or all edits lie there.  ``local``: anything else.
    """
    parsed = tokens(language, text)
    repair = parser(language).repair(parsed)
    cut = parser(language).stop(parsed) == len(parsed.kinds) - 1
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = sorted({e.line for e in repair.edits})
    other = next((o for o in LANGUAGES if o not in (language, "yaml") and parser(o).parses(tokens(o, text))), None)
    if any(_MARKER.match(lines[n - 1]) for n in at if 0 < n <= len(lines)):
        kind = "conflict"
    elif other is not None:
        kind = "mismatch"
    elif cut or all(e.last for e in repair.edits):
        kind = "truncation"
    elif not repair.complete or 5 * repair.cost > len(parsed.kinds):
        kind = "mismatch"
    else:
        kind = "local"
    return repair.cost, not repair.complete, kind, other, at


_REMEMBERED = 200_000  # verdicts a task remembers, 16 bytes of digest each


def judged_files(sources: DataFrame, with_text: bool = False) -> DataFrame:
    """``(file_id, repo, language, digest, broken, ingested_at)`` of every delivered row; ``content`` of broken ones if wanted.

    Texts are judged where they are read, so no text is shuffled; a task parses a text that it meets again, as copies do, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts: dict[bytes, bool] = {}
        for b in batches:
            digests, broken, kept = [], [], []
            for language, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                digest, bad = None, False
                if text is not None and language is not None:
                    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=language.encode()).digest()
                    known = verdicts.get(digest)
                    if known is None:
                        if len(verdicts) >= _REMEMBERED:
                            verdicts.clear()
                        known = verdicts[digest] = rejected(language, text)
                    bad = known
                digests.append(digest)
                broken.append(bad)
                kept.append(text if bad else None)
            columns = [b.column(0), b.column(1), b.column(2), b.column(4), pa.array(digests, pa.binary()), pa.array(broken, pa.bool_())]
            names = ["file_id", "repo", "language", "ingested_at", "digest", "broken"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "content"]
            yield pa.record_batch(columns, names)

    rows = sources.where("file_id IS NOT NULL").select(
        F.col("file_id").cast("long"), F.col("repo").cast("string"), grammar_name(F.col("language"), F.col("path")).alias("language"), F.col("content").cast("string"), F.col("ingested_at").cast("timestamp")
    )
    schema = "file_id long, repo string, language string, ingested_at timestamp, digest binary, broken boolean"
    return rows.mapInArrow(run, schema + ", content string" if with_text else schema)


def broken_files(sources: DataFrame) -> DataFrame:
    """``(file_id, repo, language, digest, broken)`` per file.

    Defined cases: redelivered rows count once (the last ingested); a null text, an unknown language and a null file_id are never
    flagged; an empty text is judged by its grammar (an empty JSON file is broken, an empty script is not); an empty
    table gives no rows; other columns are not read.
    """
    ship_package(sources.sparkSession)
    return latest(judged_files(sources), ["file_id"], ["ingested_at"]).drop("ingested_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_files(table(spark, folder, "source_files")).where("broken").select("file_id")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, broken files and their rate per repository and language."""
    return broken_files(table(spark, folder, "source_files")).groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if("broken").alias("broken"), F.round(F.avg(F.col("broken").cast("double")), 6).alias("rate")
    )


def repairs(sources: DataFrame) -> DataFrame:
    """Cost, kind and edited lines of the repair of every broken file; only broken texts are shuffled, each once."""
    ship_package(sources.sparkSession)
    ws = Workspace(sources.sparkSession, "parse")
    judged = ws.put(judged_files(sources, with_text=True))
    broken = latest(judged.drop("content"), ["file_id"], ["ingested_at"]).where("broken").select("file_id", "repo", "language", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [diagnose(language, text) for language, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.bool_()),
                    pa.array([f[2] for f in found], pa.string()),
                    pa.array([f[3] for f in found], pa.string()),
                    pa.array([f[4] for f in found], pa.list_(pa.int32())),
                ],
                ["language", "digest", "cost", "at_least", "kind", "parses_as", "lines"],
            )

    wanted = broken.select("language", "digest").dropDuplicates()
    texts = judged.where("broken").join(wanted, ["language", "digest"], "left_semi").groupBy("language", "digest").agg(F.any_value("content").alias("content"))
    found = texts.select("language", "digest", "content").mapInArrow(
        run, "language string, digest binary, cost int, at_least boolean, kind string, parses_as string, lines array<int>"
    )
    return broken.join(found, ["language", "digest"]).drop("digest")


def p1_repairs(spark: SparkSession, folder: str) -> DataFrame:
    return repairs(table(spark, folder, "source_files"))
