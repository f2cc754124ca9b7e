from pyspark.sql import functions as F

from lumenveil.operators.joins import hot_keys, spread
from lumenveil.operators.references import orphan_references
from lumenveil.workspace import Workspace


def test_rows_of_a_hot_key_are_spread_and_the_join_stays_the_same(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(0, 30_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.createDataFrame([(7, 14)], "k long, w long"))
    hot = hot_keys(rows, ["k"], Workspace(spark, "t"), least=5_000)
    assert [r["k"] for r in hot.collect()] == [7]
    left, right, on = spread(rows, lookup, ["k"], ["v"], hot)
    parts = left.where("k = 7").groupBy("_salt").count().agg(F.count("*"), F.max("count")).first()
    assert parts[0] == 64 and parts[1] < 400
    joined = left.join(right, on)
    assert sorted(map(tuple, joined.select("k", "v", "w").collect())) == sorted(map(tuple, rows.join(lookup, "k").select("k", "v", "w").collect()))
    assert left.join(right, on, "left_anti").count() == rows.join(lookup, "k", "left_anti").count()
    assert hot_keys(rows, ["k"], Workspace(spark, "t")) is None


def test_hot_keys_are_bounded(spark):
    rows = spark.range(1_000).select((F.col("id") % 10).alias("k"))
    assert hot_keys(rows, ["k"], Workspace(spark, "t"), least=5, most=4).count() == 4


def test_partial_nulls_follow_the_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", "x", 5), (2, "a", None, 5), (3, "b", None, 5), (4, "a", "y", 5), (5, None, "x", 5), (6, "a", None, 0)], "id long, p string, q string, at long")
    targets = spark.createDataFrame([("a", "x", 1, None), ("a", "z", 2, 3), (None, "y", 1, None)], "p string, q string, f long, t long")

    def found(match):
        return {(r["id"], r["why"]) for r in orphan_references(refs, targets, ["p", "q"], ["p"], "at", "f", "t", match=match).collect()}

    assert found("simple") == {(4, "missing")}
    assert found("partial") == {(3, "missing"), (4, "missing"), (6, "late")}
    assert found("full") == {(2, "incomplete"), (3, "incomplete"), (4, "missing"), (6, "incomplete")}
