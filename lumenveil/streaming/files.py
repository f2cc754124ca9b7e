"""Continuous re-evaluation of changed files.

A folder of file tables is read as a stream; every micro-batch replaces what is known of its own (repo, path) keys only, so the work
follows the change and not the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenveil.functions.lines import exploded_lines
from lumenveil.operators.history import latest
from lumenveil.sources.rules import rule_hits


def file_hits(files: DataFrame) -> DataFrame:
    """Personal-data hits of files with the stable key of each occurrence."""
    hits = exploded_lines(files, ["repo", "path"]).select("repo", "path", "line_no", F.inline(rule_hits(F.col("line"))))
    return hits.withColumn("occurrence", F.concat_ws(":", F.lit("occurrence"), "rule_id", "path", "line_no"))


def changed_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def stream_hits(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's hits under its batch number; the last batch of a (repo, path) is the current one."""

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch.select("repo", "path", "content", "ingested_at"), ["repo", "path"], ["ingested_at"])
        seen = newest.select("repo", "path", F.lit(number).alias("batch"))
        file_hits(newest).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/hits/batch={number}")
        seen.drop("batch").write.mode("overwrite").parquet(f"{target}/files/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_hits(spark: SparkSession, target: str) -> DataFrame:
    """Hits of the last batch that saw each file; files whose last version has none drop out."""
    files = spark.read.parquet(f"{target}/files").groupBy("repo", "path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/hits").join(files, ["repo", "path", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and key with a watermark; works on streams and tables alike."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.window(at, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
