"""Reading level of documents from vocabulary coverage and sentence complexity.

Words of all English prose are ranked by their frequency in the corpus.  The coverage rank of a document is the size of the
smallest frequency-ranked vocabulary that covers a fixed share of its words; it asks how far down the frequency list a
reader must know words to follow the text.  Together with sentence complexity it is calibrated in SQL
against raters' levels: the sums of products of the normal equations are one aggregate over the labelled
documents, and the level of every document is one SQL expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenveil.llm.words import LOOKALIKES, _INVISIBLE, word_batch
from lumenveil.shipping import ship_package
from lumenveil.tables import table
from lumenveil.workspace import Workspace


@dataclass(frozen=True)
class LevelRule:
    """``share`` of a document's words to cover; ``head`` most frequent words held in memory (12 bytes each, a fixed
    bound; documents that need rarer words go through a join); a sentence is hard when its words have more than
    ``hard_letters`` letters on average; a run of more than ``long_sentence`` words without a stop is read as
    sentences of ``piece`` words; documents with fewer than ``min_words`` words of prose get no level; below ``min_labels``
    rated documents nothing is calibrated and all levels are null, below ``full_labels`` only coverage rank and hard share enter; a level of ``demanding`` or more counts as 4 or 5.
    """

    share: float = 0.6
    head: int = 65_536
    hard_letters: float = 5.2
    long_sentence: int = 45
    piece: int = 25
    min_words: int = 8
    min_labels: int = 4
    full_labels: int = 40
    demanding: float = 3.5


#: Frequent words found in one of the languages only (fixed values).
STOPWORDS = {
    "en": "the of and to is that it for was with as be by this are from at or have an they which you were but not has been we there when who will more no if out so what up into than them can only other its about these two may then do first any my now such our over even most after also did many before must through your how".split(),
    "de": "der und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen das so zum war haben nur oder aber vor zur bis mehr durch ohne bitte wirklich wir".split(),
    "fr": "le la les et des du une est dans que qui par pour sur pas plus avec ce il sont cette au aux ne ces ont été être nous vous mais ou elle leur sans sous entre aussi avant après fichier".split(),
    "es": "el los las del y una que por con para se su lo como más pero sus al este ya entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante ni contra ese eso antes archivo".split(),
}

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_TAGGED = re.compile(r"(?is)<(pre|code|table|script|style)\b.*?(?:</\1>|\Z)")
_BREAK = re.compile(r"\n[ \t\r]*\n")
_STRUCTURE = re.compile(r"(?:[-*+•–]\s|\(?\d{1,3}[.)]\s|\(?[a-z][.)]\s|\||#|>|=====|-----| {4}|\t)")
_CODE = re.compile(r"[{};=<>]|\(\)|=>|::|^\s*(?:import|from|def|class|return|package|func|public|private|const|let|var)\b.*[;{:(\"']")
_IDENTIFIER = re.compile(r"[0-9_/\\@`]|[a-z][A-Z]|\w[.:]\w")


class _PlainWords(dict):
    """Remembers which words are identifiers, paths or numbers; forgets all when it holds 200,000."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        plain = self[word] = "" if _IDENTIFIER.search(word) else word
        return plain


_plain = _PlainWords()


def prose(text: str) -> str:
    """Running prose, one paragraph per line: no code, tables, lists, headings, quotations or identifiers."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text).translate(LOOKALIKES)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAGGED.sub("\n\n", text)
    kept = []
    for paragraph in _BREAK.split(text):
        lines = []
        for line in paragraph.split("\n"):
            if _STRUCTURE.match(line) or line.count("|") > 1:
                continue
            if _CODE.search(line) and len(_CODE.findall(line)) * 25 > len(line):
                continue
            lines.append(line)
        joined = " ".join(lines).strip()
        if joined.count(" ") >= 3:
            kept.append(" ".join([_plain[w] for w in joined.split()]))
    return "\n".join(kept)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(word_batch([" ".join(words)]).value)


def _split(b: np.ndarray) -> np.ndarray:
    """Bytes that end a sentence: a stop before white space, or a paragraph's end."""
    stop = (b == 46) | (b == 33) | (b == 63)
    after = np.append(b[1:], 10)
    return (stop & ((after == 32) | (after == 10))) | (b == 10)


def _features(ids: list, texts: list[str], rule: LevelRule) -> pa.RecordBatch:
    proses = [prose(t).lower() for t in texts]
    wb = word_batch(proses)
    raw = np.frombuffer(wb.buffer, np.uint8)
    n_docs = len(ids)
    if len(wb.start):
        sentence = np.cumsum(_split(raw))[wb.start]
        letters = wb.end - wb.start
        begins = np.flatnonzero(np.diff(sentence, prepend=-1))
        size = np.diff(np.append(begins, len(sentence)))
        place = np.arange(len(sentence)) - np.repeat(begins, size)
        cut = (np.repeat(size, size) > rule.long_sentence) & (place % rule.piece == 0)
        cut[begins] = True
        piece = np.cumsum(cut) - 1
        words = np.bincount(piece)
        mean = np.bincount(piece, weights=letters) / words
        owner = wb.text[np.flatnonzero(cut)]
        total = np.bincount(owner, weights=words, minlength=n_docs)
        hard = np.bincount(owner, weights=words * (mean > rule.hard_letters), minlength=n_docs)
        sentences = np.bincount(owner, minlength=n_docs)
        counts = {
            lang: np.bincount(wb.text[np.isin(wb.value, _hashes(w))], minlength=n_docs) for lang, w in STOPWORDS.items()
        }
    else:
        total = hard = sentences = np.zeros(n_docs)
        counts = {lang: np.zeros(n_docs) for lang in STOPWORDS}
    foreign = np.maximum.reduce([counts[c] for c in ("de", "fr", "es")])
    english = (counts["en"] > foreign) | ((counts["en"] == 0) & (foreign == 0) & (total > 0))
    bounds = np.append(np.searchsorted(wb.text, np.arange(n_docs)), len(wb.text)).astype(np.int32)
    safe = np.maximum(total, 1)
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()),
            pa.array(english),
            pa.array(total.astype(np.int32)),
            pa.array(np.log(np.maximum(safe / np.maximum(sentences, 1), 1))),
            pa.array(hard / safe),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(wb.value.view(np.int64))),
        ],
        ["doc_id", "english", "n_words", "sentence_log", "hard_share", "words"],
    )


def prose_features(documents: DataFrame, rule: LevelRule) -> DataFrame:
    """One row per document: language, sentence complexity and the hashes of its prose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            some_ids, some, size = [], [], 0
            for i, t in zip(ids, texts):
                some_ids.append(i)
                some.append(t or "")
                size += len(t or "")
                if size > 1 << 20:
                    yield _features(some_ids, some, rule)
                    some_ids, some, size = [], [], 0
            if some:
                yield _features(some_ids, some, rule)

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        run, "doc_id long, english boolean, n_words int, sentence_log double, hard_share double, words array<long>"
    )


def word_ranks(features: DataFrame) -> DataFrame:
    """``(word, rank)``: the size of the frequency-ranked vocabulary down to the word; equally frequent words share a rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counted = features.where("english").select("words").mapInArrow(count, "word long, n long")
    frequency = counted.groupBy("word").agg(F.sum("n").alias("n"))
    # a rank depends on the frequency alone: one row per distinct frequency is ranked
    steps = frequency.groupBy("n").agg(F.count("*").alias("_words"))
    ranked = steps.select("n", F.sum("_words").over(Window.orderBy(F.desc("n"))).alias("rank"))
    return frequency.join(ranked, "n").select("word", "n", "rank")


def coverage_ranks(features: DataFrame, ranks: DataFrame, rule: LevelRule, ws: Workspace) -> DataFrame:
    """``features`` with ``coverage_rank``, the smallest vocabulary covering ``rule.share`` of the words."""
    spark = features.sparkSession
    head = ranks.where(F.col("rank") <= rule.head).select("word", "rank").toArrow()
    word = head.column("word").to_numpy()
    order = np.argsort(word)
    held = spark.sparkContext.broadcast((word[order], head.column("rank").to_numpy()[order]))
    share = rule.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = held.value
        for b in batches:
            words = b.column(5)
            flat = words.flatten().to_numpy(zero_copy_only=False)
            offset = words.offsets.to_numpy() - words.offsets[0].as_py()
            row = np.searchsorted(known, flat)
            row[row == len(known)] = 0
            r = np.where(known[row] == flat, rank[row], np.iinfo(np.int64).max) if len(known) else np.full(len(flat), np.iinfo(np.int64).max)
            found, rest = [], []
            for lo, hi in zip(offset[:-1].tolist(), offset[1:].tolist()):
                if hi == lo:
                    found.append(None)
                    rest.append(None)
                    continue
                k = max(0, int(np.ceil(share * (hi - lo))) - 1)
                v = int(np.partition(r[lo:hi], k)[k])
                beyond = v == np.iinfo(np.int64).max
                found.append(None if beyond else v)
                rest.append(flat[lo:hi] if beyond else None)
            yield pa.record_batch(
                [*b.columns[:5], pa.array(found, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                ["doc_id", "english", "n_words", "sentence_log", "hard_share", "coverage_rank", "rest"],
            )

    columns = "doc_id long, english boolean, n_words int, sentence_log double, hard_share double"
    mapped = ws.put(features.mapInArrow(run, f"{columns}, coverage_rank long, rest array<long>"))  # two branches read it
    # documents that need words beyond the head: exact, by a join on the words
    own = mapped.where("rest IS NOT NULL").select("doc_id", F.explode("rest").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    placed = own.join(ranks.select("word", "rank"), "word", "left")
    by_rank = placed.groupBy("doc_id", "rank").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("doc_id").orderBy(F.col("rank").asc_nulls_last())
    reached = by_rank.withColumn("_upto", F.sum("c").over(w)).withColumn("_all", F.sum("c").over(Window.partitionBy("doc_id")))
    deep = reached.where(F.col("_upto") >= F.ceil(F.lit(share) * F.col("_all"))).groupBy("doc_id").agg(F.min("rank").alias("_deep"))
    return mapped.drop("rest").join(deep, "doc_id", "left").withColumn("coverage_rank", F.coalesce("coverage_rank", "_deep")).drop("_deep")


def agreed_levels(labels: DataFrame) -> DataFrame:
    """``(doc_id, agreed)``: median of the raters' levels; repeated rows count once, levels outside 1 to 5 not at all."""
    usable = labels.where("level BETWEEN 1 AND 5 AND doc_id IS NOT NULL").select("doc_id", "rater", "level").dropDuplicates()
    return usable.groupBy("doc_id").agg(F.median("level").alias("agreed"))


def _terms() -> list[Column]:
    x = [F.log(F.col("coverage_rank").cast("double")), F.col("sentence_log"), F.col("hard_share")]
    return [F.lit(1.0), *x, *[c * c for c in x], x[1] * x[2]]


def calibrate(features: DataFrame, labels: DataFrame, rule: LevelRule) -> Column | None:
    """The level as an expression over the features: least squares by one SQL aggregate of sums of products."""
    known = features.where(F.col("english") & (F.col("n_words") >= rule.min_words) & F.col("coverage_rank").isNotNull())
    rows = known.join(agreed_levels(labels), "doc_id")
    terms = _terms()
    size = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(t * F.col("agreed")).alias(f"b{i}") for i, t in enumerate(terms)]
    got = rows.agg(F.count("*").alias("n"), *sums).first()
    if got["n"] < rule.min_labels:
        return None
    used = list(range(size)) if got["n"] >= rule.full_labels else [0, 1, 3]
    terms = [terms[i] for i in used]
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] for j in used] for i in used])
    b = np.array([got[f"b{i}"] for i in used])
    scale = np.sqrt(np.diag(a)) + 1e-12
    ridge = 1e-6 * np.eye(len(used))
    weights = np.linalg.solve(a / np.outer(scale, scale) + ridge, b / scale) / scale
    level = F.lit(0.0)
    for weight, term in zip(weights.tolist(), terms):
        level = level + F.lit(weight) * term
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), level))


def reading_levels(documents: DataFrame, labels: DataFrame, rule: LevelRule = LevelRule()) -> DataFrame:
    """``(doc_id, english, n_words, coverage_rank, sentence_words, hard_share, level)`` for every document.

    ``level`` runs from 1 (beginner) to 5 (specialist), null without enough English prose.  Defined cases: null, empty and
    prose-free texts have zero words and no level; a null doc_id is left out; repeated documents and labels repeat or
    change nothing; an empty table gives no rows; without enough labels all levels are null; other columns are not read.
    """
    ship_package(documents.sparkSession)
    ws = Workspace(documents.sparkSession, "reading")
    raw = ws.put(prose_features(documents, rule))
    ranks = ws.put(word_ranks(raw))
    features = ws.put(coverage_ranks(raw, ranks, rule, ws))
    ws.drop(raw)
    level = calibrate(features, labels, rule)
    usable = F.col("english") & (F.col("n_words") >= rule.min_words) & F.col("coverage_rank").isNotNull()
    return features.select(
        "doc_id",
        "english",
        "n_words",
        "coverage_rank",
        F.round(F.exp("sentence_log"), 2).alias("sentence_words"),
        F.round("hard_share", 4).alias("hard_share"),
        F.when(usable, F.lit(None).cast("double") if level is None else F.round(level, 3)).alias("level"),
    )


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_levels(spark, folder).where(F.col("level") >= LevelRule().demanding).select("doc_id")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and words per level and source of the corpus."""
    sources = table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    levels = p9_levels(spark, folder).select("doc_id", "n_words", F.round("level").cast("int").alias("level"))
    return sources.join(levels, "doc_id").groupBy("source", "level").agg(
        F.count("*").alias("documents"), F.sum("n_words").alias("words")
    )
