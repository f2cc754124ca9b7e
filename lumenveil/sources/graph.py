"""Property graphs in node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string>"
LINK = "struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,source_location:string>"


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a node-link document; ``links`` and ``edges`` are both accepted."""
    schema = f"nodes array<{NODE}>, links array<{LINK}>, edges array<{LINK}>"
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.inline("nodes")).where("id IS NOT NULL").dropDuplicates(["id"])
    links = doc.select(F.inline(F.coalesce("links", "edges"))).where("source IS NOT NULL AND target IS NOT NULL")
    return nodes, links


def write_node_link(document: DataFrame, path: str) -> None:
    """Rows of ``node_link_document`` as JSON lines, partitioned by kind."""
    document.write.mode("overwrite").partitionBy("kind").text(path) if document.columns == ["kind", "json"] else document.select("kind", "json").write.mode("overwrite").partitionBy("kind").text(path)
