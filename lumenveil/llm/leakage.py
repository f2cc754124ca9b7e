"""Passages of held-out items inside a corpus, found by spaced-seed hashing.

Fixed masks ignore some positions of a window of words, so a misspelt, replaced, dropped or added word
spoils few of the windows around it.  The corpus is hashed once; a bitmap of the items' window hashes lets few windows
through, and those are joined with the items' windows.  Around a hit the words of the whole document are compared one by one with a tolerance
for single edits, and the length of the stretch decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm.words import masked_windows, mix, normalise, word_batch, words_of
from lumenveil.shipping import ship_package
from lumenveil.tables import table
from lumenveil.workspace import Workspace


@dataclass(frozen=True)
class LeakRule:
    """What counts as a leaked passage.

    ``min_words`` consecutive words of the item in one stretch; words inside runs of ``shared_run`` or more words
    that items of different wording have in common are not counted.  ``masks`` are the word positions each seed looks at.  A word replaced by a
    different one is passed over where ``flank`` matching words stand on either side of it: between fewer it is a template with other fillers.
    A document and an item are compared if windows of weight ``support`` stand in nearly one alignment, within ``min_words`` and two words of the
    document.  A window of ``solid`` words in a row weighs that much alone, and twenty words with two edits hold six in a row.  A window with gaps weighs
    one, and nothing where more than ``common`` wordings have it, as a template with other fillers in its gaps does.
    ``salt`` copies of each seed spread the corpus windows of a hot seed.
    """

    min_words: int = 20
    shared_run: int = 12
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6))
    flank: int = 8
    support: int = 8
    solid: int = 6
    common: int = 4
    salt: int = 8

    def weighted(self) -> list[tuple[int, tuple[int, ...], int]]:
        """(number, mask, weight) of all masks."""
        return [*((k, m, 1) for k, m in enumerate(self.masks)), (len(self.masks), tuple(range(self.solid)), self.support)]


_CHUNK = 1 << 20  # characters hashed at once
_MOST_BITS = 28  # a bitmap takes 32 MB at most, however many hashes it stands for


def _chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """Groups of whole texts of about ``_CHUNK`` characters, normalised."""
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts):
        if not t:
            continue
        some_ids.append(i)
        some.append(normalise(t))
        size += len(t)
        if size >= _CHUNK:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some


def _bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits set at the upper bits of ``h``, a thousand bits a hash as far as ``_MOST_BITS`` allow; summed up by the executors."""
    bits = min(_MOST_BITS, max(16, (1024 * max(count, 1)).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(place.alias("p")).selectExpr("p >> 6 AS w", "shiftleft(CAST(1 AS BIGINT), CAST(p & 63 AS INT)) AS m")
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return out.view(np.uint64)


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (len(bitmap).bit_length() + 5))
    return ((bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def item_classes(items: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """``(cls, words)`` of the distinct wordings and ``(cls, item_id)``: items of equal words are one class."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(words_of(normalise(t))) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["item_id", "words"])

    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates()
    named = ws.put(rows.mapInArrow(normal, "item_id long, words string").where("words <> ''"))
    # numbers are written out, so a lost executor cannot change them
    classes = ws.put(named.select("words").dropDuplicates().withColumn("cls", F.monotonically_increasing_id()))
    return classes, ws.put(named.join(classes, "words").select("cls", "item_id").dropDuplicates())


def shared_words(classes: DataFrame, run: int) -> DataFrame:
    """``(cls, words, common)``: a wording and the starts of its runs of ``run`` words that other wordings have too."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = tuple(range(run))
        for b in batches:
            ids, texts = np.asarray(b.column(0).to_numpy()), b.column(1).to_pylist()
            wb = word_batch(texts)
            at, h = masked_windows(wb, mask, 77)
            t = wb.text[at]
            first = np.searchsorted(wb.text, np.arange(len(texts)))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids[t]), pa.array((at - first[t]).astype(np.int32))], ["h", "cls", "pos"])

    grams = classes.select("cls", "words").mapInArrow(windows, "h long, cls long, pos int")
    common = grams.groupBy("h").agg(F.min("cls").alias("_a"), F.max("cls").alias("_b")).where("_a <> _b").select("h")
    where = grams.join(common, "h", "left_semi").groupBy("cls").agg(F.sort_array(F.collect_set("pos")).alias("common"))
    return classes.join(where, "cls", "left").select("cls", "words", "common")


def item_seeds(known: DataFrame, rule: LeakRule) -> DataFrame:
    """``(h, cls, pos, weight)`` of every window of a wording that weighs something, but for windows of shared words alone."""
    masks, run_length = rule.weighted(), rule.shared_run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, words, common in zip(*(b.column(c).to_pylist() for c in ("cls", "words", "common"))):
                wb = word_batch([words])
                own = np.ones(len(wb.value), bool)
                for p in common or ():
                    own[p : p + run_length] = False
                for k, mask, weight in masks:
                    at, h = masked_windows(wb, mask, k)
                    keep = own[at[:, None] + np.asarray(mask)].any(axis=1)  # at least one word looked at counts
                    at, h = at[keep], h[keep]
                    yield pa.record_batch(
                        [pa.array(h.view(np.int64)), pa.array(np.full(len(at), cls, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), weight, np.int32))],
                        ["h", "cls", "pos", "weight"],
                    )

    seeds = known.select("cls", "words", "common").mapInArrow(run, "h long, cls long, pos int, weight int")
    owners = seeds.select("h", "cls").dropDuplicates().groupBy("h").agg(F.count("*").alias("owners"))
    return seeds.join(owners, "h").where((F.col("weight") > 1) | (F.col("owners") <= rule.common)).drop("owners")


def corpus_windows(documents: DataFrame, bitmap: np.ndarray, rule: LeakRule) -> DataFrame:
    """``(h, doc_id, at)`` of the windows of all documents that the bitmap lets through, where they stand close enough to matter."""
    table_ = documents.sparkSession.sparkContext.broadcast(bitmap)
    masks, span, support = rule.weighted(), rule.min_words + 2, rule.support

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table_.value
        for b in batches:
            for ids, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wb = word_batch(texts)
                first = np.searchsorted(wb.text, np.arange(len(texts)))
                places, hashes, weights = [], [], []
                for k, mask, weight in masks:
                    at, h = masked_windows(wb, mask, k)
                    keep = np.flatnonzero(_passes(bits, h))
                    places.append(at[keep])
                    hashes.append(h[keep])
                    weights.append(np.full(len(keep), weight))
                at, h = np.concatenate(places), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                # windows in some stretch of ``span`` words that weigh ``support`` together
                before = np.concatenate([[0], np.cumsum(np.concatenate(weights)[order])])
                here = np.arange(len(at))
                beyond = np.searchsorted(at, at + span)
                dense = before[beyond] - before[here] >= support
                edges = np.zeros(len(at) + 1, np.int64)
                np.add.at(edges, here[dense], 1)
                np.add.at(edges, beyond[dense], -1)
                keep = np.cumsum(edges[:-1]) > 0
                at, h = at[keep], h[keep]
                t = wb.text[at]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.asarray(ids, np.int64)[t]), pa.array((at - first[t]).astype(np.int32))], ["h", "doc_id", "at"])

    return documents.mapInArrow(run, "h long, doc_id long, at int")


def _with_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents that a bitmap of the ids lets through; the rest is not shuffled."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(mix(b.column(0).to_numpy().astype(np.uint64)).view(np.int64))], ["h"])

    known = ids.select("doc_id")
    table_ = documents.sparkSession.sparkContext.broadcast(_bitmap(known.mapInArrow(hashed, "h long"), known.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table_.value
        for b in batches:
            yield b.filter(pa.array(_passes(bits, mix(b.column(0).to_numpy().astype(np.uint64)))))

    return documents.mapInArrow(run, "doc_id long, text string")


def same_word(a: str, b: str) -> bool:
    """Equal, or one letter added, dropped, replaced or swapped with its neighbour (words of 2 letters: only swapped)."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if la == lb == 2 and not (a.isdigit() or b.isdigit()):
        return a == b[::-1]
    if abs(la - lb) > 1 or min(la, lb) < 2 or max(la, lb) < 3 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


#: Words skipped in (item, document) where they part; the fewest first.
_SKIPS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0))


def _run(item: list[str], doc: list[str], i: int, d: int, step: int, most: int) -> int:
    """Matching words in a row from a pair of positions, counted up to ``most``."""
    n, m, score = len(item), len(doc), 0
    while score < most and 0 <= i < n and 0 <= d < m and same_word(item[i], doc[d]):
        score += 1
        i += step
        d += step
    return score


def extend(item: list[str], doc: list[str], i: int, d: int, step: int, flank: int = 8) -> tuple[int, int]:
    """Walk from a matching pair in one direction; the last matching position in the item and in the document.

    Misspelt, added and dropped words are passed over, and a replaced word with ``flank`` matching words in a row on either side.
    """
    last, n, m = (i, d), len(item), len(doc)
    since = 1 + _run(item, doc, i - step, d - step, -step, flank)  # matching words since the last replaced one
    while True:
        i += step
        d += step
        if not (0 <= i < n and 0 <= d < m):
            return last
        if same_word(item[i], doc[d]):
            last = (i, d)
            since += 1
            continue
        best, gain = None, 1
        for si, sd in _SKIPS:
            score = _run(item, doc, i + si * step, d + sd * step, step, 4)
            if score > gain + (si > 0 and sd > 0):
                best, gain = (si, sd), score
        if best is None and since >= flank and _run(item, doc, i + step, d + step, step, flank) >= flank:
            best, since = (1, 1), 0
        if best is None:
            return last
        i += (best[0] - 1) * step
        d += (best[1] - 1) * step


def stretches(item: list[str], common: set[int], doc: list[str], hits: list[tuple[int, int]], flank: int = 8) -> int:
    """Most item words in one stretch through any of the hits ``(pos, at)``, without wording that items share."""
    best = 0
    done: list[tuple[int, int, int, int]] = []
    for i, d in sorted(hits, key=lambda h: h[1]):
        if i >= len(item) or d >= len(doc) or not same_word(item[i], doc[d]):
            continue
        if any(a <= i <= b and x <= d <= y and abs((i - a) - (d - x)) <= 3 for a, b, x, y in done[-8:]):
            continue  # inside a stretch already measured
        a, x = extend(item, doc, i, d, -1, flank)
        b, y = extend(item, doc, i, d, 1, flank)
        done.append((a, b, x, y))
        best = max(best, sum(1 for k in range(a, b + 1) if k not in common))
    return best


def leaked_items(documents: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """``(doc_id, item_id, words)``: documents that hold a passage of an item, and its longest stretch there.

    Items of equal wording all leak where one does; only wording that differently worded items share does not count.

    Defined cases: null or empty texts hold nothing; a null id is ignored; repeated rows give one result; other columns
    are not read; with no items or no documents the result is empty.
    """
    spark = documents.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "leakage")
    classes, members = item_classes(items, ws)
    known = ws.put(shared_words(classes, rule.shared_run))
    seeds = ws.put(item_seeds(known, rule))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    windows = corpus_windows(texts, _bitmap(seeds, seeds.count()), rule)
    # a seed in a third of all documents is met by several tasks
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salt - 1))))
    met = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(rule.salt)).cast("int")).join(salted, ["h", "salt"])
    # one hit per alignment and 16 words of the item
    hits = met.groupBy("doc_id", "cls", (F.col("at") - F.col("pos")).alias("shift"), F.shiftright("pos", 4).alias("part")).agg(
        F.min("pos").alias("pos"), F.sum("weight").alias("n")
    )
    hits = ws.put(hits)
    # alignments within a few words of each other, in overlapping blocks of eight
    block = F.explode(F.array(2 * F.shiftright("shift", 3), 2 * F.shiftright(F.col("shift") + 4, 3) + 1)).alias("block")
    close = hits.select("doc_id", "cls", "n", block).groupBy("doc_id", "cls", "block").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.support)
    close = ws.put(close.select("doc_id", "cls").dropDuplicates())
    per_class = hits.join(close, ["doc_id", "cls"]).groupBy("doc_id", "cls").agg(F.collect_list(F.struct("pos", (F.col("shift") + F.col("pos")).alias("at"))).alias("hits"))
    wanted = per_class.join(known, "cls").groupBy("doc_id").agg(F.collect_list(F.struct("cls", "words", "common", "hits")).alias("candidates"))
    run_length, least, flank = rule.shared_run, rule.min_words, rule.flank

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, length = [], [], []
            for doc_id, text, candidates in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "candidates"))):
                doc = words_of(normalise(text))
                for c in candidates:
                    common = {p + q for p in c["common"] or () for q in range(run_length)}
                    n = stretches(c["words"].split(" "), common, doc, [(h["pos"], h["at"]) for h in c["hits"]], flank)
                    if n >= least:
                        ids.append(doc_id)
                        found.append(c["cls"])
                        length.append(n)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(length, pa.int32())], ["doc_id", "cls", "n"])

    read = _with_ids(texts, close.select("doc_id").dropDuplicates()).join(wanted, "doc_id").select("doc_id", "text", "candidates")
    leaks = read.mapInArrow(verify, "doc_id long, cls long, n int")
    return leaks.join(members, "cls").groupBy("doc_id", "item_id").agg(F.max("n").alias("words"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")
