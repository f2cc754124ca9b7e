"""Mixing sources to target weights by Poisson replication.

Every record gets a uniform number from a hash of its id and a seed.  Inverting a Poisson distribution at it gives the
record's number of copies: independent of all other records, the same on every run, and found without looking at
any other row.  The distribution's mean is the rate at which the source must repeat to give its share; it is cut at
the source's cap, and its parameter is solved so that the mean *after* the cut is the rate.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.text import status_label
from lumenveil.shipping import ship_package
from lumenveil.tables import table
from lumenveil.workspace import Workspace


def default_tokenizer() -> str:
    """Ranks of a public byte-level BPE; the file stays where it is installed."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Splitting rule that belongs to the default ranks (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixRule:
    """``total_tokens``: size of the mix; by default the largest that no source's cap forbids.  ``seed`` makes the draw.
    ``keep`` names further columns of the documents to carry along, e.g. the text."""

    total_tokens: int | None = None
    seed: int = 11
    tokenizer: str = field(default_factory=default_tokenizer)
    pattern: str = PATTERN
    keep: tuple[str, ...] = ("text",)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, rule: MixRule) -> DataFrame:
    """``(doc_id, source, tokens, keep...)`` of whole texts; null and empty texts have no tokens."""
    path, pattern, keep = rule.tokenizer, rule.pattern, rule.keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for b in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(counts, pa.int64()), *b.columns[3:]]
            yield pa.record_batch(columns, ["doc_id", "source", "tokens", *keep])

    rows = documents.select(
        F.col("doc_id").cast("long"), status_label(F.col("source")).alias("source"), F.col("text").cast("string").alias("_text"), *keep
    )
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join(["doc_id long", "source string", "tokens long", *[f"`{c}` {kinds[c]}" for c in keep]])
    return rows.mapInArrow(run, schema)


def _below(rate: float, cap: int) -> list[float]:
    """P(X = k) for k below the cap; in logarithms, so that no rate is too high."""
    if rate <= 0:
        return [1.0] + [0.0] * (cap - 1)
    k = np.arange(cap)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))])
    return np.exp(k * math.log(rate) - rate - factorials).tolist()


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson distribution with parameter ``rate`` cut at ``cap``."""
    p = _below(rate, cap)
    return sum(k * q for k, q in enumerate(p)) + cap * max(0.0, 1 - sum(p))


def parameter_for(mean: float, cap: int) -> float:
    """Poisson parameter whose distribution cut at ``cap`` has this mean; infinite when the mean is the cap."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap * (1 - 1e-12):
        return math.inf
    lo, hi = 0.0, 2.0 * cap + 64.0
    while capped_mean(hi, cap) < mean:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def steps(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k below the cap; a uniform number passes as many steps as its record gets copies."""
    rate = parameter_for(mean, cap)
    return [0.0] * cap if math.isinf(rate) else np.cumsum(_below(rate, cap)).tolist()


def source_plan(available: DataFrame, targets: DataFrame, rule: MixRule) -> list[dict]:
    """Rate and steps of each target source: one row per source, so it is small by nature."""
    wanted = targets.select(status_label(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    # of repeated targets the shares add up and the tightest cap holds
    wanted = wanted.groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("cap"),
    )
    rows = [r.asDict() for r in wanted.join(available, "source", "left").orderBy("source").collect()]
    usable = [r for r in rows if r["share"] > 0 and r["cap"] > 0 and (r["available"] or 0) > 0]
    reach = sum(r["share"] for r in usable)
    limit = min((r["cap"] * r["available"] * reach / r["share"] for r in usable), default=0.0)
    total = limit if rule.total_tokens is None else min(float(rule.total_tokens), limit)
    for r in rows:
        # shares of sources without text go to the others in proportion
        r["rate"] = total * r["share"] / reach / r["available"] if r in usable else 0.0
        r["steps"] = steps(r["rate"], r["cap"]) if r in usable else []
    return rows


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def mixture(documents: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """Drawn records ``(doc_id, copy, source, tokens, place, keep...)`` in global random order.

    ``copy`` counts a record's copies from 1; ``place`` is the hash that orders the mix, so partitions written in order are
    shuffled globally.  Defined cases: records of null or untargeted sources, without text, or of sources with share
    or cap zero are not drawn; a source without records gives nothing and its share goes to the others; records with the
    same doc_id are drawn alike and each of their rows counts; empty tables give no rows.
    """
    ship_package(documents.sparkSession)
    ws = Workspace(documents.sparkSession, "mixing")
    counted = ws.put(token_counts(documents, rule))
    available = counted.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = [(r["source"], r["steps"]) for r in source_plan(available, targets, rule) if r["steps"]]
    # one row per drawn source, with as many numbers as its cap
    chances = counted.sparkSession.createDataFrame(plan, "source string, _steps array<double>")
    draw = counted.where("tokens > 0").join(F.broadcast(chances), "source").withColumn("_u", uniform(F.col("doc_id"), rule.seed))
    draw = draw.withColumn("_copies", F.size(F.filter("_steps", lambda p: F.col("_u") >= p))).where("_copies > 0")
    copies = draw.select("doc_id", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"), "source", "tokens", *rule.keep)
    placed = copies.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(rule.seed + 1)))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "place").sortWithinPartitions("place")
    return ordered.select("doc_id", "copy", "source", "tokens", "place", *rule.keep)


def shares(documents: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """Per source: its target, what it has, its rate and cap, and what the draw reached."""
    from dataclasses import replace

    spark = documents.sparkSession
    drawn = mixture(documents, targets, replace(rule, keep=())).groupBy("source").agg(
        F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("drawn_records"), F.max("copy").alias("most_copies")
    )
    wanted = targets.select(status_label(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = wanted.join(drawn, "source", "full")
    all_ = joined.agg(F.sum("drawn_tokens").alias("_all"))
    return joined.join(F.broadcast(all_)).select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("drawn_records", F.lit(0)).alias("drawn_records"),
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide(F.col("drawn_tokens"), F.col("_all")), F.lit(0.0)).alias("reached_share"),
    )


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
