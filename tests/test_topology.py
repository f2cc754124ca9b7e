from pyspark.sql import functions as F

from lumenveil.operators.topology import markdown, rewire_through_hub, rewrite_ends, roles_from_topology, typed_flows, violations
from lumenveil.plans.component_queries import flows

COMPONENTS = [(1, "a", "actor", None), (1, "h", "asset", "api"), (1, "d", "asset", "database"), (1, "t", "third_party", None)]


def frames(spark, pairs):
    c = spark.createDataFrame(COMPONENTS, "scan int, component string, type string, sub_type string")
    f = spark.createDataFrame([(1, s, t) for s, t in pairs] + [(2, "a", "d")], "scan int, source string, target string")
    return c, f


def test_roles(spark):
    c, f = frames(spark, [("a", "h"), ("h", "t"), ("a", "d"), ("h", "nowhere")])
    typed = typed_flows(f, c, ["scan"])
    assert typed.count() == 3
    assert {r["component"]: r["role"] for r in roles_from_topology(typed, ["scan"]).collect()} == {"h": "passes", "d": "receives"}


def test_rewire(spark):
    c, f = frames(spark, [("a", "d"), ("a", "h"), ("h", "t")])
    hubs = spark.createDataFrame([(1, "h")], "scan int, hub string")
    out = rewire_through_hub(typed_flows(f, c, ["scan"]), hubs, ["scan"], (F.col("source_type") == "actor") & (F.col("target_sub_type") == "database"))
    assert {(r["source"], r["target"], r["synthetic"]) for r in out.collect()} == {("a", "h", False), ("h", "t", False), ("h", "d", True)}


def test_rewrite_and_checks(spark):
    _, f = frames(spark, [("a", "d")])
    ids = spark.createDataFrame([(1, "a", "A")], "scan int, old string, new string")
    assert {(r["scan"], r["source"], r["target"]) for r in rewrite_ends(f, ids, ["scan"]).collect()} == {(1, "A", "d"), (2, "a", "d")}
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, c double")
    got = violations(rows, ["id"], {"range": F.col("c").between(0, 1), "given": F.col("c").isNotNull()}).collect()
    assert {(r["id"], r["violation"]) for r in got} == {(2, "range"), (3, "range"), (3, "given")}
    assert markdown(rows.limit(1), ["id", "c"], ["id"]).splitlines()[2] == "| 1 | 0.5 |"


def test_flows_keep_long_component_ids(spark, data, tmp_path):
    a, b = "cmp_" + "a" * 150, "cmp_" + "b" * 150
    link = spark.read.parquet(f"{data}/graph_links.parquet").limit(1)
    link.withColumn("source", F.lit(f"dp::{a}")).withColumn("target", F.lit(f"dp::{b}")).write.parquet(f"{tmp_path}/graph_links.parquet")
    spark.read.parquet(f"{data}/components.parquet").limit(0).write.parquet(f"{tmp_path}/components.parquet")
    assert [(r["source"], r["target"]) for r in flows(spark, str(tmp_path)).collect()] == [(a, b)]
